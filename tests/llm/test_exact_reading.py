"""What is read by the mask's lengths, vectors at the ends of the number range, and counts of texts against plain counting."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioframe.llm import chat, rp_forest
from folioframe.llm import quality as ql
from folioframe.llm import toxicity as tx
from folioframe.llm.queries import QUERIES
from folioframe.llm.words import slabs


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))


def test_loss_text_follows_the_lengths_of_the_mask(spark):
    rows = [(1, 0, "user", "héllo <s>"), (1, 1, "assistant", "</s>[INST] ök [/INST]"), (1, 2, "assistant", "𝄞"), (1, 3, "user", None), (1, 4, "assistant", None), (2, 0, "user", "x")]
    talks = formatted(spark, rows)
    assert {r.conv: r.loss_text for r in chat.read_back(talks).collect()} == {1: "</s>[INST] ök [/INST]𝄞", 2: ""}
    longer = talks.withColumn("mask", F.transform("mask", lambda r, i: F.struct((r["chars"] + F.when(i == 0, 1).otherwise(0)).alias("chars"), r["loss"].alias("loss"))))
    assert chat.read_back(longer).filter("conv = 1").first().loss_text != "</s>[INST] ök [/INST]𝄞"


def test_long_conversation(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"é{i} <s> " * 60) for i in range(1500)]
    got = chat.read_back(formatted(spark, rows)).first()
    assert got.loss_text == "".join(t for _, i, r, t in rows if r == "assistant") and len(got.turns) == 1500


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [0.0, 1e200]), (3, [1e-170, 0.0]), (4, [1.0, 0.0]), (5, [5e-324, 0.0]), (6, [0.0, -1e308]), (7, [1e308, 1e308]), (8, [3e-300, 3e-300]), (9, [0.0, 0.0])]
    got = {r.id: (r.n_links, r.component_id) for r in rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 3: (3, 1), 4: (3, 1), 5: (3, 1), 2: (0, 2), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_marks_do_not_change_what_is_read(spark, sf):
    tricky = QUERIES["op9_chat"](spark, sf).filter("conv_id = -1").first()
    assert tricky.loss_chars == len("</s>[INST] ok [/INST]") and tricky.n_turns == 2


TEXTS = ["You are an IDIOT and a fool", "idiot", "YOU LOUD dummkopf, dummkopf", None, "", "plain words only", "scum " * 300 + "tu imbécile", "ends in you", "scum of the earth"]


def test_voters_against_plain_counting():
    """Every voter's count, word by word in plain Python; a text's counts do not depend on its neighbours."""
    marked, begun = ["plain", "earth"], {4: ["only", "wor"], 5: ["idiot"], 6: []}
    as_words = lambda ws: np.sort(np.concatenate([np.zeros(0, np.uint64), *[tx._lexicon(w) for w in ws]]))

    def beginnings(n):
        known = [w[:n] for w in begun[n]]
        tokens = [tx._tokens(next(slabs(pa.array([w])))[1])[0] for w in known]
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *[t.hashes(tx._OTHER + 2 * n, n) for t in tokens]]))

    markers = tx.Markers(as_words(marked), tuple(beginnings(n) for n in tx.BEGINNINGS))
    got = np.concatenate([tx.count_hits(words, markers) for _, words in slabs(pa.array(TEXTS))])
    alone = np.concatenate([tx.count_hits(words, markers) for t in TEXTS for _, words in slabs(pa.array([t], pa.string()))])
    assert (got == alone).all()
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    abuse, contempt, address = (set(x.split()) for x in (tx.ABUSE, tx.CONTEMPT, tx.ADDRESS))
    for text, row in zip(TEXTS, got):
        raw = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")
        ws = [lower(w) for w in raw]
        bad = [w in abuse or w in contempt or w in marked for w in ws]
        near = sum(b and any(v in address for v in ws[max(0, i - 3):i]) for i, b in enumerate(bad))
        loud = sum(w.isascii() and w.isalpha() and w.isupper() and len(w) > 2 for w in raw)
        want = [sum(w in abuse for w in ws), sum(w in contempt for w in ws), near, loud]
        assert row[:4].tolist() == want and row[4:7].sum() == sum(w in marked for w in ws)
        for k, n in enumerate(tx.BEGINNINGS):
            assert row[7 + k] == sum(w.encode()[:n] in [b.encode()[:n] for b in begun[n]] for w in ws)


def test_statistics_against_plain_counting():
    texts = [*TEXTS, "One, two. THREE!\nOne, two. THREE!\n\n- 12 #a {b} ünï-Code", "a a a b", "x" * 25 + " 1234567890", "...", "\n\r\n", "é É"]
    got = np.concatenate([ql.statistics(words) for _, words in slabs(pa.array(texts))])
    share = lambda a, b, c=10: math.asin(math.sqrt(min(max(a / (b + c), 0), 1)))
    for text, row in zip(texts, got):
        data = (text or "").encode()
        ws = [w for w in re.split(rb"[ \t-\r]+", data) if w]
        lines = [x for x in re.split(rb"[\n\r]+", data) if x]
        of = lambda chars: sum(data.count(bytes([c])) for c in chars.encode())
        letters = lambda w: sum(chr(c).isalpha() if c < 128 else True for c in w)
        capitals = lambda w: sum(65 <= c <= 90 for c in w)
        n = len(ws)
        want = [math.log1p(n), math.log1p(sum(map(len, ws)) / max(n, 1)), share(sum(len(w) > 20 for w in ws), n), share(capitals(data), len(data), 60),
                share(of(".,;:?'\"()-"), len(data), 60), share(of("0123456789"), len(data), 60), share(of("#$%&*+/<=>@[\\]^_`{|}~"), len(data), 60), share(of("!"), len(data), 60),
                share(sum(letters(w) == 0 for w in ws), n), math.log1p(len(set(ws))) / max(math.log1p(n), 1), share(max([ws.count(w) for w in set(ws)], default=0) - 1, n),
                share(sum(a == b for a, b in zip(ws, ws[1:])), n), math.log1p(len(lines)), share(len(lines) - len(set(lines)), len(lines)),
                share(sum(capitals(w) > 1 and capitals(w) * 2 > letters(w) for w in ws), n)]
        assert np.allclose(row, want), (text, dict(zip(ql.NAMES, row - np.array(want))))


def test_toxic_documents_are_found(spark):
    """Recall and precision of label 1 on held-out documents; predicting 0 for all of them has neither."""
    folder = "/root/testdata/sf0.1"
    held = QUERIES["op6_toxicity"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("toxic IS NOT NULL").collect()
    toxic, said = sum(r.toxic for r in held), sum(r.predicted for r in held)
    both = sum(r.toxic * r.predicted for r in held)
    assert toxic > 50 and both >= 0.85 * toxic and both >= 0.95 * said
