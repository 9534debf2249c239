"""Lines, rows and bands of a page: ordering, grouping and vertical placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_weight
from .ordered import Ordered


def allocate_width(df: DataFrame, line: list[str], pos: str, text: str, x: str, w: str) -> DataFrame:
    """Split the box of a line among its parts in proportion to their text weight, with a small gap.

    ``x`` and ``w`` hold the box of the line on every part and become the box of the part.
    """
    weighed = df.withColumn("__weight", text_weight(F.col(text)))
    run = Ordered(weighed, line, [pos]).add(__upto=("sum", "__weight"), __i=("row",), __total=("total", "__weight"), __n=("total", F.lit(1))).done()
    gap = F.least(F.lit(0.006), F.col(w) / (F.col("__n") * 12))
    usable = F.col(w) - gap * (F.col("__n") - 1)
    before = F.col("__upto") - F.col("__weight")
    share = F.when(F.col("__total") > 0, usable / F.col("__total"))
    return run.select(*[c for c in df.columns if c not in (x, w)],
                         (F.col(x) + share * before + gap * (F.col("__i") - 1)).alias(x), (share * F.col("__weight")).alias(w))
