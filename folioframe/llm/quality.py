"""Document quality by regularised quadratic discriminant analysis of transformed text statistics.

Each class gets a mean and a covariance that is shrunk towards its own diagonal and towards the pooled diagonal.  The score is
the posterior of label 1: the difference of the two Gaussian log densities, from Mahalanobis distances by triangular factors
that are computed once and travel with the function, plus the log odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.words import Words, slabs

SHRINK_OWN, SHRINK_POOLED, FLOOR = 0.05, 0.05, 1e-3
THRESHOLD = 0.3
NAMES = ["words", "word_length", "long_words", "upper", "punctuation", "digits", "symbols", "marks", "bare", "distinct", "top_share", "repeats",
         "lines", "repeated_lines", "capital_words"]
_BASE = 0x9E3779B97F4A7C15


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_PLAIN, _MARK = _bytes(".,;:?'\"()-"), _bytes("!")
_SYMBOL = _bytes("#$%&*+/<=>@[\\]^_`{|}~")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_NEWLINE = _bytes("\n\r")
_LETTER_CAPITAL = _LETTER.astype(np.int64) + (_UPPER.astype(np.int64) << 32)
_CLASSES = np.stack([_UPPER, _PLAIN, _DIGIT, _SYMBOL, _MARK], axis=1).astype(np.int64)


def _share(part: np.ndarray, whole: np.ndarray, unseen: int = 10) -> np.ndarray:
    """A share on the scale where its spread hardly depends on its size; ``unseen`` plain cases damp that of short texts."""
    return np.arcsin(np.sqrt(np.clip(part / (whole + unseen), 0, 1)))


def _counts(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many different words, and how often the commonest one stands."""
    n = len(words.offsets) - 1
    distinct, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = (words.text.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))  # 40 hash bits tell one text's words apart
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    runs, text = np.diff(np.append(first, len(key))), (key[first] >> np.uint64(40)).astype(np.int64)
    np.add.at(distinct, text, 1)
    np.maximum.at(top, text, runs)
    return distinct, top


def statistics(words: Words) -> np.ndarray:
    """One row of ``NAMES`` for each text; all zero for a text without words."""
    lines = Words(words.data, words.offsets, _NEWLINE)
    n, size = np.diff(words.bounds), np.diff(words.offsets)
    length = words.end - words.start
    h = words.hashes(_BASE)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])
    both = np.concatenate([[0], np.cumsum(_LETTER_CAPITAL[words.data])])
    both = both[words.end] - both[words.start]
    own_letters, own_capitals = both & 0xFFFFFFFF, both >> 32
    found = np.stack([np.bincount(words.data[i:j], minlength=256) for i, j in zip(words.offsets[:-1], words.offsets[1:])]) @ _CLASSES
    distinct, top = _counts(words, h)
    n_lines = np.diff(lines.bounds)
    columns = [
        np.log1p(n),
        np.log1p(words.per_text(length) / np.maximum(n, 1)),
        _share(words.per_text(length > 20), n),
        _share(found[:, 0], size, 60),
        _share(found[:, 1], size, 60),
        _share(found[:, 2], size, 60),
        _share(found[:, 3], size, 60),
        _share(found[:, 4], size, 60),
        _share(words.per_text((own_letters == 0)), n),
        np.log1p(distinct) / np.maximum(np.log1p(n), 1),
        _share(top - 1, n),
        _share(words.per_text(again), n),
        np.log1p(n_lines),
        _share(n_lines - _counts(lines, lines.hashes(_BASE))[0], n_lines),
        _share(words.per_text((own_capitals > 1) & (own_capitals * 2 > own_letters)), n),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _table(texts: pa.Array) -> np.ndarray:
    rows = [statistics(words) for _, words in slabs(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    """Column function: the transformed statistics of a whole text (null: those of an empty text)."""
    x = _table(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the lower Cholesky factor, log of the factor's determinant; and the log odds of label 1."""

    means: tuple[np.ndarray, np.ndarray]
    inverse: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * np.square((x - m) @ inv.T).sum(1) - d for m, inv, d in zip(self.means, self.inverse, self.log_det)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def fit(rows: DataFrame, label_col: str, features_col: str = "features", *, own: float = SHRINK_OWN,
        pooled: float = SHRINK_POOLED, one_class: bool = False) -> Discriminant:
    """The model of all ``rows`` with label 0 or 1 (others, nulls included, are left out).

    Without any such row every text scores 0.5.  Where one label only occurs, ``one_class`` gives every text that label's score (0 or 1);
    else it is an error.
    Sums and products are aggregated by Spark; the driver gets one row a class, whatever the number of rows.
    """
    d = len(NAMES)
    f = F.col(features_col)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = (rows.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(f[i] * f[j]) for i, j in pairs]).alias("p")).collect())
    by = {r["label"]: r for r in sums}
    if len(by) == 1 and not one_class:
        raise ValueError("both labels are needed to fit")
    if len(by) < 2:
        flat = np.zeros(d), np.zeros((d, d))
        return Discriminant((flat[0],) * 2, (flat[1],) * 2, (0.0, 0.0), 500.0 * ((1 in by) - (0 in by)))
    means, scatter = [], []
    for k in (0, 1):
        mean = np.array(by[k]["s"]) / by[k]["n"]
        square = np.zeros((d, d))
        for (i, j), p in zip(pairs, by[k]["p"]):
            square[i, j] = square[j, i] = p
        means.append(mean)
        scatter.append(square / by[k]["n"] - np.outer(mean, mean))
    count = [by[k]["n"] for k in (0, 1)]
    spread = (count[0] * np.diag(scatter[0]) + count[1] * np.diag(scatter[1])) / sum(count)
    inverse, log_det = [], []
    for s in scatter:
        shrunk = (1 - own - pooled) * s + np.diag(own * np.diag(s) + pooled * spread + FLOOR)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        log_det.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(inverse), tuple(log_det), float(np.log(count[1] / count[0])))


def score(model: Discriminant, text: Column) -> Column:
    """Column: the posterior of label 1 for a whole text; null and empty texts are scored like any other."""

    @F.arrow_udf(T.DoubleType())
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_table(texts)))

    return apply(text)


def held_out(id_col: str) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text modulo 5 is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *,
                  one_class: bool = False) -> Discriminant:
    """The model of the labelled documents that are not held out (see ``fit``).  Repeated rows and repeated labels each count."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label in (0, 1)")
    own = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("features"))
    return fit(own.join(marks, "id"), "label", one_class=one_class)


def classify(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on).

    Only the text is looked at.  Input columns of the results' names are replaced, others pass unchanged, repeated rows stay, and
    an empty table gives an empty result.
    """
    scored = docs.drop("score", "predicted").withColumn("score", score(model, F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
