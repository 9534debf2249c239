"""Scoring of drawn strokes against reference strokes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 48


def resample(points: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """``steps`` + 1 points evenly spaced along a path; a path without length stays one point, repeated."""
    legs = np.hypot(*np.diff(points, axis=0).T) if len(points) > 1 else np.zeros(0)
    along = np.concatenate([[0.0], np.cumsum(legs)])
    if along[-1] == 0:
        return np.repeat(points[:1], steps + 1, axis=0)
    at = np.linspace(0, along[-1], steps + 1)
    return np.column_stack([np.interp(at, along, points[:, k]) for k in (0, 1)])


def frechet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Frechet distances of many pairs of paths at once (arrays pairs x points x 2)."""
    d = np.hypot(a[:, :, None, 0] - b[:, None, :, 0], a[:, :, None, 1] - b[:, None, :, 1])
    for i in range(d.shape[1]):
        for j in range(d.shape[2]):
            if i and j:
                reach = np.minimum(np.minimum(d[:, i - 1, j], d[:, i, j - 1]), d[:, i - 1, j - 1])
            elif i or j:
                reach = d[:, i - 1, 0] if i else d[:, 0, j - 1]
            else:
                continue
            d[:, i, j] = np.maximum(d[:, i, j], reach)
    return d[:, -1, -1]


def trace_score(traces: DataFrame, references: DataFrame, keys: list[str], ident: list[str], size: float) -> DataFrame:
    """Distance of every trace to the reference of its stroke and whether it passes.

    ``points`` is array<struct<x, y>> on both sides.  A trace passes under max(13, .085 x size).
    """
    def axis(points, of):
        return F.transform(points, lambda p: p[of].cast("double"))
    t, r = traces.filter(F.size("points") > 0), references.filter(F.size("points") > 0)
    joined = t.select(*keys, *ident, axis("points", "x").alias("tx"), axis("points", "y").alias("ty")).join(
        r.select(*keys, axis("points", "x").alias("rx"), axis("points", "y").alias("ry")), keys)
    out = [*keys, *ident]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*out).schema.fields) + ", distance double, passed boolean"
    limit = max(13.0, 0.085 * size)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def paths(xs, ys):
            return np.stack([resample(np.column_stack([x, y])) for x, y in zip(xs, ys)])
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start:start + 512]
                distance = frechet(paths(part["tx"], part["ty"]), paths(part["rx"], part["ry"]))
                yield part[out].assign(distance=distance, passed=distance < limit)

    return joined.mapInPandas(score, schema)
