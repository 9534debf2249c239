"""Personal data in texts: patterns propose spans, validators confirm them, words before a span adjust its score.

The four base kinds (email, ip, card, phone) are kept whenever their own check holds.  The added kinds are kept by score: a
checksum (IBAN: modulo 97) or a plausible form gives a score, words of the kind within ``NEAR`` characters before the span raise it, words that
speak of other numbers lower it.  Every pattern is a run of single characters or of bounded length, so the time grows with the text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE = 4  # kinds that stay whatever their score
NEAR, LEAST = 40, 5  # characters before a span that are its context; tenths that an added span needs

# Tenths of a span's score before its context, words that raise it, words that lower any score.
SCORES = {"email": 9, "ip": 6, "card": 8, "phone": 6, "iban": 8, "ssn": 4, "tel": 3}
WORDS = {"email": "mail|email|contact|write|kontakt|correo", "ip": "ip|host|server|address|adresse", "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
         "phone": "phone|tel|call|fax|mobile|telefon|telefono|anruf", "iban": "iban|account|bank|konto|compte|cuenta",
         "ssn": "ssn|social security|taxpayer", "tel": "phone|tel|call|fax|mobile|telefon|telefono|anruf"}
OTHER_NUMBERS = "order|invoice|isbn|issn|ticket|version|article|artikel|pedido|facture"
# Lengths of international bank account numbers by country.
IBAN_LENGTHS = {"AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
                "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
                "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27}
# What the added kinds look like; no retries after a match that fails its check.
IBAN_HEAD, IBAN = "[A-Z][A-Z][0-9][0-9]", "[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}"  # a number is read from every head
SSN, TEL = "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ ./-][0-9]{3,4}"

_DOMAIN, _LOCAL = re.compile(r"@[A-Za-z0-9.-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS, _GAP = re.compile(r"[0-9][0-9 -]*"), re.compile(r"[ -]{2,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HEAD, _IBAN, _SSN, _TEL = map(re.compile, (IBAN_HEAD, IBAN, SSN, TEL))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_CONTEXT = {kind: re.compile(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)") for kind, words in WORDS.items()}
_OTHER = re.compile(f"(?:^|[^a-z])(?:{OTHER_NUMBERS})(?:[^a-z]|$)")

Span = tuple[int, int, int, int]  # start, place of the kind in KINDS, end, tenths


# -- validators ------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second one from the right doubled, ends in 0."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (no blanks) leaves 1: its first four characters last, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


# -- spans of each kind ------------------------------------------------------------------

def emails(text: str) -> Iterator[tuple[int, int]]:
    """A domain after each @ and the run of local characters before it; cheaper than a search from every letter."""
    free, after = 0, 0  # where the next match may start; behind the last @
    for m in _DOMAIN.finditer(text):
        at, run = m.start(), m.group()[1:]
        local = text[max(free, after):at]
        after = at + 1
        run = run[:run.find("..")] if ".." in run else run.removesuffix(".")
        start = at - (len(local) - len(local.rstrip(_LOCAL)))
        if start < at and "." in run[1:] and run[0] != ".":
            free = at + 1 + len(run)
            yield start, free


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Digits with at most one blank or hyphen between two of them."""
    for m in _DIGITS.finditer(text):
        start = m.start()
        for gap in (*_GAP.finditer(m.group()), None):
            end = m.end() if gap is None else m.start() + gap.start()
            piece = text[start:end].rstrip(" -")
            digits = piece.replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield start, start + len(piece)
            start = end if gap is None else m.start() + gap.end()


def _alone(text: str, start: int, end: int, around: str = "") -> bool:
    """Whether no ASCII letter or digit, nor a character of ``around``, touches the span."""
    sides = text[max(0, start - 1):start] + text[end:end + 1]
    return not any(c in around or c.isascii() and c.isalnum() for c in sides)


def accounts(text: str) -> Iterator[tuple[int, int]]:
    for head in _HEAD.finditer(text):
        size = IBAN_LENGTHS.get(head.group()[:2])
        m = _IBAN.match(text, head.start()) if size else None
        places = [i for i, c in enumerate(m.group()) if c != " "] if m else []
        if m and len(places) >= size:
            end = m.start() + places[size - 1] + 1
            if _alone(text, m.start(), end) and mod97(text[m.start():end].replace(" ", "")):
                yield m.start(), end


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in accounts(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if _alone(text, *m.span(), "-") and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()
    for m in _TEL.finditer(text):
        if _alone(text, *m.span(), "+.-/(") and 9 <= sum(c.isdigit() for c in m.group()) <= 11:
            yield "tel", *m.span()


def _score(text: str, kind: str, start: int) -> int:
    context = text[max(0, start - NEAR):start].translate(_ASCII_LOWER)
    return max(0, min(10, SCORES[kind] + 2 * bool(_CONTEXT[kind].search(context)) - 3 * bool(_OTHER.search(context))))


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind; an added span inside a base span is left out."""
    base = [("email", *s) for s in emails(text)] if "@" in text else []
    base += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    base += [("card", *s) for s in cards(text)]
    base += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    out = [(start, KINDS.index(kind), end, _score(text, kind, start)) for kind, start, end in base]
    covered = sorted((start, end) for _, start, end in base)
    for kind, start, end in _added(text):
        score = _score(text, kind, start)
        if score >= LEAST and not _inside(covered, start, end):
            out.append((start, KINDS.index(kind), end, score))
    return sorted(out)


def _inside(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    """Base spans of one kind are disjoint, so at most one a kind that starts before the span can hold it."""
    import bisect

    at = bisect.bisect_right(covered, (start, float("inf")))
    return any(e >= end for _, e in covered[max(0, at - 2 * BASE):at])


# -- over a table ---------------------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("stop", T.IntegerType()),
                                  T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))


def _spans(texts: pa.Array) -> pa.Array:
    cuts, flat = [0], []
    for text in texts:
        flat += find(text.as_py() or "")
        cuts.append(len(flat))
    start, kind, stop, tenths = zip(*flat) if flat else ((),) * 4
    columns = [pa.array(start, pa.int32()), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(stop, pa.int32()),
               pa.array([t / 10 for t in tenths], pa.float64()), pa.array([k < BASE for k in kind], pa.bool_())]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, [f.name for f in SPANS.elementType.fields]))


def find_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``spans_col``: array of (start, kind, stop, score, base) by start, then kind; code points, stop exclusive.

    Whole texts are searched.  A null or empty text has an empty array.  A column of that name is replaced, others pass unchanged;
    repeated rows stay and an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _spans(batch.column(batch.schema.get_field_index(text_col)))], [*batch.schema.names, spans_col])

    rest = docs.drop(spans_col)
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(spans_col, SPANS)]))


def mask(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with every span of ``spans_col`` replaced in the text by its kind in angle brackets; of overlapping spans the first counts."""
    def step(acc, s):
        free = s["start"] >= acc["at"]
        kept = F.substr(F.col(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(free, F.concat(acc["out"], kept, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"),
                        F.when(free, s["stop"]).otherwise(acc["at"]).alias("at"))

    whole = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.aggregate(spans_col, whole, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1)))
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, text).otherwise(F.col(text_col)))
