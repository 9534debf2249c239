"""Choices by page layout against plain Python over whole pages."""

import random
import re

from folioframe.operators import choices
from folioframe.operators.sequences import parse_choices

ANCHOR, LETTER, HEADER = (re.compile(p) for p in (r"\s*(\d+)\s*[.．]\s*A\s*", r"\s*(?:\d+\s*[.．]\s*)?([ABCD])\s*", r"\s*(\d+)[.．]\s*(?![ABCD])"))


def rows_of(lines):
    rows = []
    for line in sorted(lines, key=lambda l: (l[1], l[0], l[2])):
        row = next((r for r in rows if abs(r[0][1] - line[1]) < choices.ROW), None)
        if row is None:
            rows.append(row := [])
        row.append(line)
    return [sorted(r, key=lambda l: (l[0], l[1], l[2])) for r in rows]


def parts_of(row, question):
    out = []
    for _, _, t in row:
        if m := LETTER.match(t):
            out.append([question, m[1], t[m.end():], 1])
        elif out:
            out[-1][2] += t
            out[-1][3] += 1
    return out


def read(lines):
    """One page of (x, y, text)."""
    anchors, out = [l for l in lines if ANCHOR.match(l[2])], []
    if not anchors:
        question = None
        for row in rows_of(lines):
            if head := next((m for l in row if (m := HEADER.match(l[2]))), None):
                question = int(head[1])
            elif question is not None:
                out += parts_of(row, question)
    elif any(sum(bool(LETTER.match(l[2])) and abs(l[1] - a[1]) < choices.ROW for l in lines) >= 3 for a in anchors):
        for a in anchors:
            near = sorted((l for l in lines if abs(l[1] - a[1]) < choices.ROW), key=lambda l: (l[0], l[1], l[2]))
            out += parts_of(near, int(ANCHOR.match(a[2])[1]))
    else:
        xs = sorted({int(a[0] * 10 + 0.5) / 10 for a in anchors})
        mid = (xs[0] + xs[-1]) / 2 if len(xs) > 1 else 1
        for side in ([l for l in lines if l[0] < mid], [l for l in lines if l[0] >= mid]):
            question = None
            for row in rows_of(side):
                start = next((l for l in row if LETTER.match(l[2])), None)
                if start is None:
                    continue
                if m := ANCHOR.match(start[2]):
                    question = int(m[1])
                if question is None:
                    continue
                m = LETTER.match(start[2])
                taken = [l for l in row if l[0] >= start[0] and not re.fullmatch("[一_—-]", l[2])]
                out.append([question, m[1], "".join(l[2][m.end():] if l is start else l[2] for l in taken), len(taken)])
    return sorted(map(tuple, out))


def check_pages(spark, pages):
    df = spark.createDataFrame([(p, *l) for p, lines in pages.items() for l in lines] + [(0, None, 0.1, "A x"), (0, 0.1, float("nan"), "B x"), (0, 0.1, 0.1, None)],
                               "page int, x double, y double, line string")
    got = {}
    for r in choices.page_choices(df, ["page"], "line", "x", "y").collect():
        got.setdefault(r.page, []).append((r.question, r.letter, r.answer, r.pieces))
    want = {p: read(lines) for p, lines in pages.items()}
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}
    return want


def test_layouts(spark):
    across = [(0.1, 0.2, "1. A apple"), (0.3, 0.201, "B"), (0.35, 0.202, "bread"), (0.6, 0.199, "C cheese"), (0.1, 0.3, "2．A x"), (0.4, 0.3, "B y")]
    columns = [(0.1, 0.2, "1. A one"), (0.1, 0.23, "B two"), (0.2, 0.231, "—"), (0.3, 0.23, "more"), (0.1, 0.26, "note"), (0.6, 0.2, "2. A left"), (0.6, 0.23, "B"), (0.7, 0.229, "right")]
    plain = [(0.1, 0.1, "1. x"), (0.1, 0.12, "Apple"), (0.1, 0.14, "Bread"), (0.1, 0.16, "2.Choose"), (0.1, 0.18, "C"), (0.2, 0.18, "cat"), (0.5, 0.181, "D dog")]
    want = check_pages(spark, {1: across, 2: columns, 3: plain, 4: [(0.1, 0.1, "B alone")]})
    assert want[1][:2] == [(1, "A", "apple", 1), (1, "B", "bread", 2)] and (1, "B", "twomore", 2) in want[2] and want[3][0] == (1, "A", "pple", 1) and want[4] == []


def test_random_pages(spark):
    rng = random.Random(3)
    texts = ["1. A x", "2. A", "B y", "C", "D z", "word", "—", "3. word", "4.B q", " A　b", "5 ．A w", "ABBA"]
    pages = {p: [(round(rng.random(), 3), round(rng.choice([rng.random() * 0.1, rng.randint(0, 5) * 0.03]), 4), t + str(i % 3))
                 for i, t in enumerate(rng.choices(texts if p % 3 else texts[2:8], k=rng.randint(1, 25)))] for p in range(1, 120)}
    want = check_pages(spark, pages)
    assert sum(map(bool, want.values())) > 80


def test_letters_inside_words_open_choices_in_reading_order_too(spark):
    df = spark.createDataFrame([(1, 1, "1. x"), (1, 2, "Apple"), (1, 3, "Bread")], "page int, n int, line string")
    assert [(r.question, r.letter, r.answer) for r in parse_choices(df, ["page"], ["n"], "line").orderBy("letter").collect()] == [(1, "A", "pple"), (1, "B", "read")]


def test_query(spark, sf):
    from folioframe.plans import QUERIES
    from folioframe.plans.demo import Tables
    from folioframe.plans.sequences import choice_lines

    pages = {}
    for r in choice_lines(Tables(spark, sf)).collect():
        pages.setdefault((r.l_suppkey, r.sheet), []).append((r.x, r.y, r.line))
    got = sorted(map(tuple, QUERIES["page_choices"](spark, sf).collect()))
    assert got == sorted((*p, *row) for p, lines in pages.items() for row in read(lines)) and len(got) > 500


def odd_pages(rng):
    """Lines that come twice, at places with zeros of both signs and far out, on pages with null and not-a-number keys."""
    texts = ["1. A x", "2. A", "B y", "C", "D z", "word", "—", "—\n", "3. word", "4.B q", "1. A", "ABBA", ""]
    out = []
    for p, k in [(None, None), (None, 0.0), (1, float("nan")), (1, None), *((p, float(p % 2)) for p in range(2, 90))]:
        pool = texts if p is None or p % 3 else texts[2:10]
        lines = [(rng.choice([-0.0, 0.0, 0.1, 0.5, 0.72, 1e19, -3.0]) if p is None or p % 4 else 0.3, rng.choice([-0.0, 0.0, 0.006, 0.007, 0.014, 0.2, 0.203, 1e9]), rng.choice(pool))
                 for _ in range(rng.randint(1, 30))]
        out += [(p, k, *line) for line in lines for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    rng.shuffle(out)
    return out


def test_pages_read_whole_and_long_pages_agree(spark, monkeypatch):
    df = spark.createDataFrame(odd_pages(random.Random(8)), "page int, k double, x double, y double, line string").repartition(3)
    got = {}
    for most, pairs in ((0, choices.PAIRS), (25, choices.PAIRS), (choices.LONG_PAGE, choices.PAIRS), (choices.LONG_PAGE, 5)):
        monkeypatch.setattr(choices, "LONG_PAGE", most)
        monkeypatch.setattr(choices, "PAIRS", pairs)
        done = choices.page_choices(df, ["page", "k"], "line", "x", "y")
        assert [(f.name, f.dataType.simpleString()) for f in done.schema] == [("page", "int"), ("k", "double"), ("question", "bigint"), ("letter", "string"), ("answer", "string"), ("pieces", "bigint")]
        got[most, pairs] = sorted(map(repr, done.collect()))
    first, *others = got.values()
    assert len(first) > 500 and len(others) == 3 and all(other == first for other in others)


def test_pages_are_read_in_one_shuffle(spark):
    lines = [(i / 10, i * 0.03, t) for i, t in enumerate(["1. A x", "B y", "C z", "2. A w"])]
    done = choices.page_choices(spark.createDataFrame([(p, *line) for p in range(50) for line in lines], "page int, x double, y double, line string"), ["page"], "line", "x", "y")
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, done.collect())) == [(p, *row) for p in range(50) for row in read(lines)]
