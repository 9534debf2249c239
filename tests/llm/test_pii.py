"""Personal data against the plain patterns, the SQL on texts with all kinds, and masking."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from folioframe.llm import pii
from folioframe.llm.oracles import ORACLES
from folioframe.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

TEXTS = ["tel (030) 123-4567, mail a.b@c.de. 10.0.0.1 +1 (614) 555-8001 IBAN DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432. ssn 123-45-6789",
         "order 4111 1111 1111 1111, order 123-45-6789, (030) 123-4567, 666-12-1234, ssn 000-12-1234", "é" * 50 + " call 030/123-4567x, call 030/123-4567 a@b..c a@b.c@d.e",
         None, "", "4111-1111-1111-1111, 4111 1111 1111 1112, 0004.4.4.4 256.1.1.1 1.2.3.4.5.6.7.8 +1--2 +1234567890", "XDE89370400440532013000 DE88370400440532013000 ZZ89370400440532013000",
         "+1 415 555 2671 and ssn +123-45-6789 1", "Konto DE89 3704 0044 0532 0130 00, Rechnung", "a@b.c-d@e.f a@.b a@b. x@y.z..w %@%.a", "1234 - 5678  4111 1111 1111 1111  2"]


def plain_base(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def texts(n):
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "..", " ", "  ", "-", "+", "1", "42", "4111 1111 1111 1111", "10.0.0.1", "é", "x", "+1 415 555 2671", "(0", ")", "%", "0", "9", "DE89370400440532013000", "tel "]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(n)]


def test_base_spans_against_the_plain_patterns():
    for text in [*TEXTS, *texts(4000)]:
        assert [s[:3] for s in pii.find(text or "") if s[1] < pii.BASE] == plain_base(text), text


def test_added_spans_and_context():
    got = [[(t[s:e], pii.KINDS[k], x) for s, k, e, x in pii.find(t) if k >= pii.BASE] for t in map(lambda t: t or "", TEXTS)]
    assert got[0] == [("(030) 123-4567", "tel", 5), ("DE89 3704 0044 0532 0130 00", "iban", 10), ("GB82WEST12345698765432", "iban", 10), ("123-45-6789", "ssn", 6)]
    assert got[1] == [] and got[2] == [("030/123-4567", "tel", 5)] and got[6] == [] and got[8] == [("DE89 3704 0044 0532 0130 00", "iban", 10)]


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pii"))
    spark.createDataFrame(list(enumerate([*TEXTS, *texts(500)])), "doc_id long, text string").withColumns({"spans": F.lit("clash"), "start": F.lit(1)}).write.parquet(f"{at}/documents.parquet")
    return at


def test_sql_on_all_kinds(spark, folder):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    cur = db.execute(ORACLES["op11_pii"])
    cols = [c[0] for c in cur.description]
    df = QUERIES["op11_pii"](spark, folder)
    assert check.rows([tuple(r) for r in df.collect()], df.columns) == check.rows(cur.fetchall(), cols)


def test_mask_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    masked = {r.doc_id: r for r in pii.mask(pii.find_spans(docs)).collect()}
    assert masked[5].text == "<card>, 4111 1111 1111 1112, <ip> 256.1.1.1 <ip>.<ip> +1--2 <phone>" and masked[5].start == 1
    assert masked[0].text == "tel <tel>, mail <email>. <ip> <phone> IBAN <iban> AND <iban>. ssn <ssn>"
    assert masked[3].text is None and masked[4].text == "" and masked[0].spans[0].kind == "tel"
    assert pii.find_spans(docs.limit(0)).count() == 0
    assert pii.find_spans(docs.union(docs)).count() == 2 * docs.count()


@pytest.mark.parametrize("piece", ["a", "1", "1.", "a@", "1 ", "+1", "A", "@a.", "AB12 ", "a." * 4 + "@"])
def test_time_grows_with_the_text(piece):
    def took(n):
        start = time.perf_counter()
        pii.find(piece * (n // len(piece)))
        return time.perf_counter() - start
    took(1000)
    assert took(400_000) < 12 * took(100_000) + 0.5
