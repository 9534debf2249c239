"""Text, box and record functions on small literal cases."""

import random
import time
import unittest.mock

import pytest
from pyspark.sql import functions as F

from folioframe.functions import alignment, boxes, records
from folioframe.functions import text as tx


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_tone_key(spark):
    words = ["mā", "má", "mǎ", "mà", "mǎ", "lǜ", "lǜ", " NǙ ", "ma", "mámā", "bāng", "xyz̀", "máma", None]
    assert apply(spark, tx.tone_key, words) == ["ma1", "ma2", "ma3", "ma4", "ma3", "lv4", "lv4", "nv3", None, None, "bang1", None, None, None]


def test_tone_of(spark):
    assert apply(spark, tx.tone_of, ["nǐ hǎo", "nǐ hào", "ni", "é"]) == [3, None, None, 2]


def test_nfc_and_counts(spark):
    assert apply(spark, tx.nfc, ["éa", "ǘ", "plain", "q̌"]) == ["éa", "ǘ", "plain", "q̌"]
    assert apply(spark, tx.tone_count, ["nǚ", "xué", "xúé", "abc"]) == [2, 1, 2, 0]
    assert apply(spark, tx.toneless, ["Xuéshēng", "NǙ", "é"]) == ["xuesheng", "nu", "e"]
    assert apply(spark, tx.memory_key, [" É  a\n"]) == ["é a"]


def test_widen_punctuation(spark):
    cases = {"你好, 吗?": "你好， 吗？", "abc, d?": "abc, d?", "(中)": "（中）", "中.": "中。", "中. abc": "中. abc", "中),": "中）,", "中 . 文": "中。 文"}
    assert apply(spark, tx.widen_punctuation, list(cases)) == list(cases.values())


def test_mixed_tokens(spark):
    got = apply(spark, tx.mixed_tokens, ["你好 Xī'ān café 12a!", "don’t_x"])
    assert got == [["你", "好", "Xī'ān", "café", "12", "a", "!"], ["don’t", "_", "x"]]


def test_syllables(spark):
    assert apply(spark, tx.syllable_count, ["xuéshēng", "nǎr", "èr", "nǚ'ér", "", "zhōngguó"]) == [2, 2, 1, 2, 0, 2]


def test_transliterate(spark):
    words = ["Wáng Yīfēi", "shì", "zì", "jù", "nǚ", "xuéxí", "hello", "", "Xī'ān"]
    assert apply(spark, tx.transliterate, words) == ["Ван Ифэй", "Ши", "Цзы", "Цзюй", "Нюй", "Сюэси", None, None, "Сиань"]


def test_track_code(spark):
    names = ["1-3.mp3", "01_03.mp3", "Track 1-3", "第1课 1-3", "1_3", "123-4", "none", "12.5.wav"]
    assert apply(spark, tx.track_code, names) == ["1-3", "1-3", "1-3", "1-3", "1-3", None, None, "12-5"]


def test_text_weight(spark):
    assert [round(x, 2) for x in apply(spark, tx.text_weight, ["中a", "mi", "x y"])] == [1.53, 1.12, 1.33]


def test_spoken_match(spark):
    pairs = [("你好！", "你好", True), ("你 好", "你好。", True), ("你好", "你好吗", False), ("", "", False), ("!", "?", False), (None, "a", False), ("你好", "你们好", False),
             ("学生", "学 生", True), ("a-b", "ab", True), ("好", "不好", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.filter(tx.spoken_match(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_proximity(spark):
    flag = lambda c: tx.proximity_flag(c, "\\b(?:zoom|pan)\\b", "\\bpage\\b", "\\b(?:no|without)\\b[^.;\\n]{0,30}$")
    got = apply(spark, flag, ["slow zoom over the page", "no zoom over the page", "zoom in on the face", "no pan here. Then zoom to the page", "pan " + "x" * 80 + " page",
                              "no pan " + "y" * 40 + " zoom page"])
    assert [g is not None for g in got] == [True, False, False, True, False, True]
    assert got[0] == "slow zoom over the page"


def test_fenced_json(spark):
    fn = lambda c: records.parse_fenced_json(c, "a INT")["a"]
    assert apply(spark, fn, ['```json\n{"a": 1}\n```', 'Sure: {"a": 2} ok', '{"a": 3}', "none", "{broken"]) == [1, 2, 3, None, None]


def test_secret_scan(spark):
    rows = [(1, "key sk-" + "a" * 30), (2, "ghp_" + "b" * 30), (3, "-----BEGIN RSA PRIVATE KEY-----"), (4, "sk-short"), (5, "sk-proj-" + "c" * 30 + " and github_pat_" + "d" * 30)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.id, r.pattern) for r in records.secret_scan(df, "text").collect())
    assert got == [(1, "api_key"), (2, "gh_token"), (3, "private_key"), (5, "api_key"), (5, "github_pat")]


def test_infer_metadata(spark):
    rows = [(1, "HSK 1 v3.0 Workbook"), (2, "HSK-5 上"), (3, "Other book"), (4, "hsk_2 练习册")]
    df = spark.createDataFrame(rows, "id int, name string")
    got = {r.id: (r.level, r.section, r.slug) for r in records.infer_metadata(df, "name", "id").collect()}
    assert got == {1: ("HSK 1", "HSK 1 v3.0 · Рабочая тетрадь", "hsk1-v3-workbook"), 2: ("HSK 5", "HSK 5", "hsk5-upper"), 3: ("", "Other book", "book-3"),
                   4: ("HSK 2", "HSK 2 · Рабочая тетрадь", "hsk2-workbook")}


def test_glyphs_only_in_phonetic_context(spark):
    df = spark.createDataFrame([("|", True), ("|", False), ("O", True), ("I", True), ("Ok", True)], "t string, ph boolean")
    got = [tuple(r) for r in records.fix_conditional_glyphs(df, "t", F.col("ph")).select("t", "original_text").collect()]
    assert got == [("l", "|"), ("|", None), ("o", "O"), ("l", "I"), ("Ok", None)]


def test_language_layers(spark):
    df = spark.createDataFrame([("你好 Hello there 朋友", "nǐ hǎo Hello péngyou"), ("你好 hello Nǐ hǎo ① again", "nǐ hǎo hello"), ("你好 HSK one", "HSK one")], "s string, p string")
    got = [tuple(r) for r in df.select(tx.split_language_layers(F.col("s"), F.col("p")).alias("x")).select("x.native", "x.pinyin", "x.english").collect()]
    assert got == [("你好  朋友", "nǐ hǎo péngyou", "Hello there"), ("你好", "nǐ hǎo", "hello again"), ("你好", "", "HSK one")]


def test_normalize_box(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4), (2.76, 0.2, 0.1, 0.1), (0.9, 0.2, 0.3, 0.1), (0.1, 0.1, 0.001, 0.5), (0.95, 0.1, 0.1, 0.1)], "x double, y double, w double, h double")
    one = F.lit(1.0)
    got = [r.b for r in df.select(boxes.normalize_box(*[F.col(c) for c in "xywh"], one, one).alias("b")).collect()]
    assert [b and tuple(round(v, 4) for v in b) for b in got] == [(0.1, 0.2, 0.3, 0.4), (0.276, 0.2, 0.1, 0.1), None, None, (0.95, 0.1, 0.05, 0.1)]


def edit_table(a, z):
    d = [[max(i, j) if not i * j else 0 for j in range(len(z) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(z) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != z[j - 1]))
    return d


@pytest.mark.parametrize("seed", range(5))
def test_edit_path(seed):
    import random
    rnd = random.Random(seed)
    for _ in range(200):
        a, z = ("".join(rnd.choices("abc", k=rnd.randint(0, 12))) for _ in range(2))
        d, i, j = edit_table(a, z), len(a), len(z)
        want = {i: j}
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != z[j - 1]):
                i, j = i - 1, j - 1
            elif j and d[i][j] == d[i][j - 1] + 1:
                j -= 1
            else:
                i -= 1
            want[i] = j
        best = d[-1][-1]
        assert alignment.edit_path(a, z) == want == alignment.edit_path(a, z, best)
        assert alignment.edit_path(a, z, best - 1) is None
        # Narrow bands and rows made again from marks give the same path.
        for band, kept in ((1, 2), (3, 5)):
            with unittest.mock.patch.multiple(alignment, BAND=band, KEPT=kept):
                assert alignment.edit_path(a, z) == want


@pytest.mark.parametrize("seed", range(5))
def test_match_share(seed):
    import random
    rnd = random.Random(seed)
    for _ in range(150):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randint(1, 25))) for _ in range(2))
        run = max((n for n in range(1, len(a) + 1) if any(a[i:i + n] in b for i in range(len(a) - n + 1))), default=0) / len(a)
        row = [0] * (len(b) + 1)
        for c in a:
            nxt = [0]
            for j, x in enumerate(b):
                nxt.append(row[j] + 1 if c == x else max(row[j + 1], nxt[j]))
            row = nxt
        want = 1.0 if a in b else run if len(a) < 12 or run >= 0.6 else max(run, row[-1] / len(a) * 0.9)
        assert alignment.match_share(a, b) == pytest.approx(want)
        floored = alignment.match_share(a, b, 0.6)
        assert floored == pytest.approx(want) if want >= 0.6 else floored < 0.6


def test_match_scores_compare_what_can_win(monkeypatch):
    """The best pair of each owner is that of comparing all, but neighbours that cannot win are not compared."""
    import random

    import pandas as pd
    rnd = random.Random(4)
    rows = []
    for owner in range(60):
        texts = ["".join(rnd.choices("abcdefgh汉", k=rnd.choice([5, 20, 64, 150, 1100]))) for _ in range(3)]
        rows += [(str(owner), "".join(rnd.choice("xy") if rnd.random() < 0.1 else c for c in texts[1]), t, lift) for t, lift in zip(texts, (-0.18, 0.75, -0.18))]
    rnd.shuffle(rows)
    assert alignment._commons([r[1:3] for r in rows]) == [alignment._common(*r[1:3]) for r in rows]
    full = [alignment.match_share(line, text, 0.6) for _, line, text, _ in rows]
    calls = []
    monkeypatch.setattr(alignment, "match_share", lambda *a, f=alignment.match_share: calls.append(1) or f(*a))
    owners, lines, texts, lifts = (pd.Series(c) for c in zip(*rows))
    got = alignment.match_scores(owners, lines, texts.where([b not in t for b, t in zip(lines, texts)], None), lifts, 0.6).tolist()
    def best(scores):
        kept = {}
        for k, (s, r) in enumerate(zip(scores, rows)):
            if s >= 0.6:
                kept[r[0]] = max(kept.get(r[0], (-9.0, 0)), (s + r[3], -k))
        return kept
    assert best(got) == best(full) and len(best(full)) > 40
    assert len(calls) < len(rows) * 0.7


def test_cut_lines():
    assert alignment.cut_lines("你好 世界朋友", ["你好世", "界朋"]) == ["你好 世", "界朋友"]
    assert alignment.cut_lines("abcdef", ["xxxxxx"], 0.3) is None


@pytest.mark.parametrize("seed", range(3))
def test_edit_paths_of_groups(seed):
    import random
    rnd = random.Random(seed)
    pairs, most = [], []
    for _ in range(40):
        z = "".join(rnd.choices("abcdefgh世", k=rnd.choice([0, 1, 63, 64, 65, 300, 900])))
        pairs.append(("".join(c if rnd.random() > 0.15 else rnd.choice(["", "x", "ab"]) for c in z), z))
        most.append(rnd.choice([float("inf"), 0.3 * len(z), 5]))
    want = [alignment.edit_path(a, z, m) for (a, z), m in zip(pairs, most)]
    # Together and one by one, with and without windows by letter counts, and without room for either.
    for few, wide, group in ((1, 0, 1 << 30), (99, 0, 1 << 30), (1, 1 << 30, 1 << 30), (1, 0, 0)):
        with unittest.mock.patch.multiple(alignment, FEW=few, WIDE=wide, GROUP=group):
            assert alignment.edit_paths(pairs, most) == want


def test_edit_paths_work_on_few_cells():
    """Letters that one side lacks leave a narrow window around the path, however many they are."""
    z = "".join("abcdefghij"[i * i % 7 + i % 3] + ("e" if i % 9 == 0 else "") for i in range(40_000))
    a = z.replace("e", "")
    first, last = alignment._window(a, z, len(z) - len(a) + 1)
    assert (last - first).max() <= 12 < (len(z) - len(a)) // 64
    assert alignment.edit_paths([(a, z)], [float("inf")])[0][len(a)] == len(z)


@pytest.mark.parametrize("seed", range(4))
def test_line_ends_are_those_of_the_path(seed):
    import random
    rnd = random.Random(seed)
    noises = [lambda c: c if rnd.random() > 0.2 else "", lambda c: c if rnd.random() > 0.2 else c + "b", lambda c: c if rnd.random() > 0.2 else "xy"[c > "b"], lambda c: "" if c == "a" else c,
              lambda c: c if rnd.random() > 0.2 else rnd.choice(["", "a", "x", "cb"]), lambda c: {"a": "", "b": "x"}.get(c, c), lambda c: rnd.choice("abc"), lambda c: "xy"[c > "b"] if rnd.random() < 0.3 else rnd.choice([c, c, ""])]
    reads, cleans = [], []
    for k in range(400):
        z = "".join(rnd.choices("abcd世", k=rnd.choice([0, 1, 2, 5, 12, 70])))
        a = "".join(map(noises[k % len(noises)], z))
        cuts = [0, *sorted(rnd.choices(range(len(a) + 1), k=rnd.choice([0, 1, 3, 9]))), len(a)]  # some lines are empty
        reads.append([a[i:j] for i, j in zip(cuts, cuts[1:])])
        cleans.append(z)
    reads, cleans = [*reads, [], [], ["", ""]], [*cleans, "", "ab", "ab"]
    for ratio in (0.05, 0.3, 1.0, float("inf")):
        want = []
        for read, z in zip(reads, cleans):
            longest = max(len(a := "".join(read)), len(z))
            path = alignment.edit_path(a, z, longest and ratio * longest)
            want.append(None if path is None else [path[sum(map(len, read[:k]))] for k in range(1, len(read))])
        assert alignment.line_ends(reads, cleans, ratio) == want
        assert any(want) and (ratio >= 1 or None in want)


def test_blanks_are_those_of_split():
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kept = ~alignment.BLANKS[[min(ord(c), len(alignment.BLANKS) - 1) for c in text]]
    assert "".join(c for c, k in zip(text, kept) if k) == "".join(text.split())


@pytest.mark.parametrize("noise", [("aeno", "xyzw", ""), ("", "", "e"), ("ao", "01", "e"), ("", "", "")])
def test_lines_are_cut_without_a_table(noise, monkeypatch):
    """No table of edits is made of a reading that lacks letters, has others in their place, or both if letter counts tell which."""
    import random
    rnd = random.Random(5)
    clean = "\n".join(" ".join("".join(rnd.choices("abcdefghijklmnostuwxyz汉", k=6)) for _ in range(12)) for _ in range(300))
    want = alignment.cut_lines(clean, lines := clean.translate(str.maketrans(*noise)).split("\n"), 0.3)
    for table in ("_group_rows", "_pair_rows", "_table_rows"):
        monkeypatch.delattr(alignment, table)
    assert alignment.cut_lines(clean, lines, 0.3) == want
    assert want and "".join(want) == clean.replace("\n", "") and len(want) == 300


def test_transliterate_looks_at_each_word_once(spark, tmp_path):
    from folioframe.plans import QUERIES
    spark.createDataFrame([(1, "nǐ hǎo hello nǐ"), (2, "nǐ xyz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    done = QUERIES["transliterate"](spark, str(tmp_path))
    assert "Aggregate" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.word, r.russian) for r in done.collect()} == {("nǐ", "Ни"), ("hǎo", "Хао")}


def test_language_layers_of_a_long_text(spark):
    r = random.Random(14)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    toned, plain = ["ǎ" + word("ǎǒíùbc") for _ in range(30_000)], [word("abcde") for _ in range(120_000)]
    read, text = [*toned, "HSK", "Zhōng", "①"], [*toned[:20], *plain, "hsk", "ZHŌNG", "你好"]
    r.shuffle(text)
    gone = {t.lower() for t in read}
    df = spark.createDataFrame([(" ".join(text), " ".join(read)), ("ab Nǐ ́ x", "Nǐ fooBAR ABCd ́")], "s string, p string")
    began = time.time()
    got = [tuple(x) for x in df.select(tx.split_language_layers(F.col("s"), F.col("p")).alias("x")).select("x.*").collect()]
    assert time.time() - began < 30  # not every word against every toned one of the reading
    assert got[0] == ("你好", " ".join(read), " ".join(w for w in text if w.lower() not in gone and w != "你好"))
    assert got[1] == ("", "Nǐ ABC ́", "ab ́ x")
