"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters look for words of fixed lexicons, for address and shouting patterns, and for markers: words and word beginnings that are many
times as common in documents labelled toxic as in the others.  A label model without labels estimates by
expectation maximisation how often each voter fires on either class and which voters fire together beyond that; voters that say
the same thing share one voice.  A logistic regression on the voters' counts learns its posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.quality import held_out
from folioframe.llm.words import Words, mix, slabs
from folioframe.operators.lineage import cut_lineage

SAMPLE = 20_000  # labelled documents (about) that markers are learned from
SUPPORT, RATIO = 0.01, 50.0  # a marker's least share of toxic documents, and how many times that of the others
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6)  # bytes of a word
ROUNDS = 200
PRIOR = 0.1  # share of toxic documents that the label model starts from
SHINGLE = 3  # words; documents that agree in the smallest hash of their shingles count once when markers are learned

# Common words of abuse and of contempt, and words of address, in four languages.
ABUSE = """idiot idiots moron morons imbecile stupid dumb fool loser losers clown jerk bastard bitch asshole
idiot dummkopf arschloch trottel idiote imbécile connard crétin idiota imbécil estúpido cabrón"""
CONTEMPT = """worthless pathetic disgusting trash garbage scum filth vermin hate despise
wertlos abschaum widerlich nutzlos minable ordure dégoûtant basura asqueroso inútil"""
ADDRESS = "you your youre du dein dich ihr tu toi ton vous tú eres usted"

NAMES = ["abuse", "contempt", "addressed", "shouting", "words_a", "words_b", "words_c", *[f"begins_{n}" for n in BEGINNINGS]]
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _tokens(words: Words) -> tuple[Words, np.ndarray]:
    """Letters and digits in lower case as words; and the bytes as they were."""
    return Words(_LOWER[words.data], words.offsets, _BETWEEN), words.data


def _hashes(tokens: Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings; the length tells them apart, and a word is its own beginning too."""
    return [tokens.hashes(_BASE), *[tokens.hashes(_OTHER + 2 * n, n) for n in BEGINNINGS]]


def _lexicon(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(Words(_LOWER[data], np.array([0, len(data)]), _BETWEEN).hashes(_BASE))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


@dataclass(frozen=True)
class Markers:
    """Sorted hashes of marker words and, by length, of marker beginnings."""

    words: np.ndarray
    beginnings: tuple[np.ndarray, ...]


def count_hits(words: Words, markers: Markers) -> np.ndarray:
    """For each text one row of ``NAMES``: how many of its words each voter points at."""
    tokens, raw = _tokens(words)
    whole, *begins = _hashes(tokens)
    abuse, contempt, marked = _among(whole, _lexicon(ABUSE)), _among(whole, _lexicon(CONTEMPT)), _among(whole, markers.words)
    told = np.concatenate([[0], np.cumsum(_among(whole, _lexicon(ADDRESS)))])
    at = np.arange(len(whole))
    near = told[at] > told[np.maximum(at - 3, tokens.bounds[tokens.text])]  # an address among the text's own three words before
    capitals = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    loud = (capitals[tokens.end] - capitals[tokens.start] == tokens.end - tokens.start) & (tokens.end - tokens.start > 2)
    hit = [abuse, contempt, near & (abuse | contempt | marked), loud]
    hit += [marked & (whole % np.uint64(3) == np.uint64(k)) for k in range(3)]
    hit += [_among(h, known) for h, known in zip(begins, markers.beginnings)]
    return np.stack([tokens.per_text(x) for x in hit], axis=1).astype(np.int64)


@F.arrow_udf(T.LongType())
def signature(texts: pa.Array) -> pa.Array:
    """Column function: the smallest hash of a text's shingles, which near copies mostly share; of a shorter text that of all its words."""
    out = np.full(len(texts), (1 << 64) - 1, np.uint64)
    for row, words in slabs(texts):
        tokens, _ = _tokens(words)
        size = np.diff(tokens.bounds)
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        if len(short):
            h, whole = tokens.hashes(_BASE), np.zeros(len(short), np.uint64)
            for k in range(SHINGLE - 1):
                has = size[short] > k
                whole[has] = whole[has] * np.uint64(_BASE) + h[tokens.bounds[short[has]] + k]
            out[row + short] = mix(whole + size[short].astype(np.uint64))
        np.minimum.at(out, row + tokens.text[tokens.windows(SHINGLE)], tokens.window_hashes(SHINGLE, _BASE))
    return pa.array(out.view(np.int64))


def learn_markers(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, *, sample: int = SAMPLE,
                  support: float = SUPPORT, ratio: float = RATIO) -> Markers:
    """Markers from about ``sample`` labelled documents that are not held out, chosen by a hash of their ids.

    The sample's ids are broadcast (their number is bounded), so no text is shuffled.  Candidates are the words that
    toxic documents share; the other documents count those only.  Without labelled documents there are none.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1)).filter(~held_out(id_col))
    n = usable.count()
    if not n:
        none = np.zeros(0, np.uint64)
        return Markers(none, (none,) * len(BEGINNINGS))
    chosen = (usable.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) <= int(min(1.0, sample / n) * (1 << 20)))
              .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__label")))
    known = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__label", F.col(text_col).alias("text"))
    # One document of a group of copies, that of the smallest hash: else the words of a copied toxic text would all look like markers.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    known = cut_lineage(known.withColumn("s", signature("text")).groupBy("__label", "s").agg(one))

    def counted(candidates: list[np.ndarray] | None):
        """Per batch and word: in how many of its texts it stands."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, words in slabs(batch.column("text")):
                    tokens, _ = _tokens(words)
                    for kind, h in enumerate(_hashes(tokens)):
                        text = tokens.text
                        if candidates is not None:
                            mine = _among(h, candidates[kind])
                            h, text = h[mine], text[mine]
                        pairs = np.unique(np.stack([h, text.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(h) else h
                        values, counts = np.unique(pairs, return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                                              names=["kind", "h", "n"])
        return run

    def totals(rows: DataFrame, candidates: list[np.ndarray] | None) -> DataFrame:
        return rows.select("text").mapInArrow(counted(candidates), "kind int, h bigint, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("n"))

    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, support * toxic)
    # At most (words of a document) / support rows each kind, whatever the corpus: the sample and the support bound them.
    shared = totals(known.filter("__label = 1"), None).filter(F.col("n") >= least).collect()
    candidates = [np.unique(np.array([r["h"] for r in shared if r["kind"] == k], np.int64).view(np.uint64)) for k in range(1 + len(BEGINNINGS))]
    common = {(r["kind"], r["h"]): r["n"] for r in totals(known.filter("__label = 0"), candidates).collect()}
    kept: list[list[int]] = [[] for _ in candidates]
    for r in shared:
        if r["n"] / max(toxic, 1) >= ratio * (common.get((r["kind"], r["h"]), 0) + 0.5) / max(other, 1):
            kept[r["kind"]].append(r["h"])
    words, *beginnings = (np.sort(np.array(k, np.int64).view(np.uint64)) for k in kept)
    return Markers(words, tuple(beginnings))


def hits(markers: Markers, text: Column) -> Column:
    """Column: the counts of ``NAMES`` for a whole text (null: those of an empty one)."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def apply(texts: pa.Array) -> pa.Array:
        rows = [count_hits(words, markers) for _, words in slabs(texts)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))

    return apply(text)


@dataclass(frozen=True)
class LabelModel:
    """How often each voter fires on clean and on toxic documents, its voice, and the share of toxic documents."""

    fires: np.ndarray  # (2, voters)
    voice: np.ndarray
    prior: float
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        says = np.log(self.fires), np.log1p(-self.fires)
        both = [(np.where(votes, says[0][k], says[1][k]) * self.voice).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(both[0] - both[1] + np.log(1 - self.prior) - np.log(self.prior), -500, 500)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, odds: np.ndarray | None = None) -> LabelModel:
    """From the distinct vote patterns and how many documents show each: no labels are used.

    ``odds`` says how many times likelier each voter at least fires on toxic documents (1: not less likely), which is what is known of
    voters chosen for that.
    After a first fit the voters' correlations within the classes are estimated; a voter's voice is one over its summed positive
    correlations with all voters, itself included, and the model is fitted again with these voices.
    """
    n = patterns.shape[1]
    total = counts.sum()
    voice, correlation, odds = np.ones(n), np.eye(n), np.ones(n) if odds is None else odds
    for _ in range(2):
        start = np.minimum(0.5, patterns.T @ counts / total)
        fires, prior = np.clip(np.stack([0.2 * start, np.maximum(0.4, start)]), 1e-4, 0.95), PRIOR
        for _ in range(ROUNDS):
            p = LabelModel(fires, voice, prior, correlation).posterior(patterns)
            mass = np.stack([(1 - p) * counts, p * counts])
            new = np.clip((mass @ patterns + [[0.01], [0.5]]) / (mass.sum(1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
            new[1] = np.maximum(new[1], new[0])  # a voter never speaks for the clean class
            new[0] = np.minimum(new[0], new[1] / odds)
            prior = float(np.clip(mass[1].sum() / total, 1e-4, 0.5))
            if np.abs(new - fires).max() < 1e-7:
                break
            fires = new
        p = LabelModel(fires, voice, prior, correlation).posterior(patterns)
        weight = p * counts  # the toxic class, where voters fire at all
        mean = weight @ patterns / max(weight.sum(), 1e-9)
        spread = (patterns - mean).T @ ((patterns - mean) * weight[:, None]) / max(weight.sum(), 1e-9)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        correlation = spread / np.outer(scale, scale)
        np.fill_diagonal(correlation, 1)
        voice = 1 / np.clip(correlation, 0, 1).sum(1)
    return LabelModel(fires, voice, prior, correlation)


def _inputs(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(counts), counts > 0, np.ones((len(counts), 1))], axis=1)


def fit_linear(votes: np.ndarray, hits_sums: np.ndarray, weight: np.ndarray, target: np.ndarray, rounds: int = 50, penalty: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps on soft targets; one row per vote pattern and count class."""
    x = np.concatenate([hits_sums, votes, np.ones((len(votes), 1))], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - penalty * w
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty * np.eye(len(w)), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Toxicity:
    markers: Markers
    labels: LabelModel
    weights: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(counts) @ self.weights, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE) -> Toxicity:
    """The model: markers from labelled documents, everything else from the votes on all documents that are not held out.

    Vote patterns come to the driver with their numbers of documents and mean counts: at most 2 to the number of voters rows.
    Without a document that is not held out every text scores ``PRIOR``.
    """
    markers = learn_markers(docs, labels, id_col, text_col, label_col, sample=sample)
    seen = docs.filter(~held_out(id_col)).select(hits(markers, F.col(text_col)).alias("c"))
    pattern = F.transform("c", lambda x: (x > 0).cast("int"))
    k = len(NAMES)
    rows = (seen.select(pattern.alias("p"), "c").groupBy("p")
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.log1p(F.col("c")[i])) for i in range(k)]).alias("mean")).orderBy("p").collect())
    if not rows:
        return Toxicity(markers, LabelModel(np.full((2, k), 0.5), np.ones(k), PRIOR, np.eye(k)), np.append(np.zeros(2 * k), np.log(PRIOR / (1 - PRIOR))))
    votes, counts = np.array([r["p"] for r in rows]).reshape(-1, k), np.array([r["n"] for r in rows], float)
    model = fit_label_model(votes, counts, np.where(np.arange(k) < NAMES.index("words_a"), 1, RATIO))  # each marker was chosen for this ratio
    weights = fit_linear(votes, np.array([r["mean"] for r in rows]).reshape(-1, k), counts, model.posterior(votes))
    return Toxicity(markers, model, weights)


def classify(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from ``threshold`` on).

    Only the text is looked at, whole; null and empty texts are scored as texts without any hit.  Input columns of the results' names are
    replaced, others pass unchanged, repeated rows stay, and an empty table gives an empty result.
    """

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        rows = [count_hits(words, model.markers) for _, words in slabs(texts)]
        return pa.array(model.score(np.concatenate(rows)) if rows else np.zeros(0))

    scored = docs.drop("score", "predicted").withColumn("score", score(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
