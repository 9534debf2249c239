"""Functions on record fields: JSON text, digests, names, glyph repairs, credentials."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CREDENTIALS

FIELD = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def parse_json_column(df: DataFrame, col: str, schema: str, out: str = "parsed") -> DataFrame:
    """JSON text as a typed struct; bad JSON gives null instead of a failure."""
    return df.withColumn(out, F.when(F.try_parse_json(col).isNotNull(), F.from_json(col, schema)))


def parse_fenced_json(col: Column, schema: str) -> Column:
    """JSON inside a code fence, or else between the first and the last brace."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(col, "^(?i)```(?:json)?\\s*", ""), "```\\s*$", ""))
    text = F.when(F.try_parse_json(clean).isNotNull(), clean).otherwise(F.regexp_extract(clean, "(?s)\\{.*\\}", 0))
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def content_digest(*cols: str) -> Column:
    """SHA-256 over the named source fields only, so edits elsewhere keep the identity."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def memo_digest(*cols: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", *cols))


def fields_by_suffix(df: DataFrame, json_col: str, suffix: str = "ru", *, skip: tuple[str, ...] = ("printed", "box", "translations")) -> DataFrame:
    """One row per non-blank nested string whose key is ``suffix`` or ends with ``_suffix``, with its dotted path."""
    def walk(node, path, out):
        items = node.items() if isinstance(node, dict) else enumerate(node)
        for k, v in items:
            at = f"{path}.{k}" if path else str(k)
            if isinstance(v, str):
                if (str(k) == suffix or str(k).endswith("_" + suffix)) and v.strip():
                    out.append({"path": at, "value": v.strip()})
            elif isinstance(v, (dict, list)) and k not in skip:
                walk(v, at, out)
        return out

    @F.pandas_udf(FIELD)
    def fields(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: walk(json.loads(s), "", []))

    held = df.filter(F.try_parse_json(json_col).isNotNull())
    found = held.withColumn("__f", F.explode(fields(json_col)))
    return found.select(*[c for c in df.columns if c != json_col], "__f.path", "__f.value")


def infer_metadata(df: DataFrame, name: str, ident: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Level, section and slug from a course name; explicit columns win field by field."""
    n = F.coalesce(F.col(name), F.lit(""))
    level = F.regexp_extract(n, "(?i)HSK[\\s_-]*([1-6])", 1)
    known = level != ""
    workbook = n.rlike("(?iu)work\\s*book|\\bWB\\b|тетрад|练习册")
    third = (level == "1") & n.rlike("(?i)v?3[._]0|3\\.0|HSK Course 1")
    inferred = {
        "level": F.when(known, F.concat(F.lit("HSK "), level)).otherwise(""),
        "section": F.when(known, F.concat(F.lit("HSK "), level, F.when(third, " v3.0").otherwise(""),
                                          F.when(workbook, " · Рабочая тетрадь").otherwise(""))).otherwise(n),
        "slug": F.when(known, F.concat(F.lit("hsk"), level, F.when(third, "-v3").otherwise(""),
                                       F.when(F.contains(n, F.lit("上")), "-upper").otherwise(""),
                                       F.when(workbook, "-workbook").otherwise("")))
                 .otherwise(F.concat(F.lit("book-"), F.col(ident).cast("string"))),
    }
    overrides = overrides or {}
    return df.withColumns({k: F.coalesce(F.col(overrides[k]), v) if k in overrides else v for k, v in inferred.items()})


def fix_conditional_glyphs(df: DataFrame, text: str, phonetic: Column) -> DataFrame:
    """Bar, I and 1 become l, and O becomes o, only where the context is phonetic; the original is kept."""
    t = F.trim(text)
    fixed = F.when(phonetic & t.rlike("^[|I1]$"), "l").when(phonetic & (t == "O"), "o").otherwise(t)
    changed = fixed != t
    return df.withColumns({text: fixed, "original_text": F.when(changed, t),
                           "normalization": F.when(changed, "phonetics-table-glyph-ambiguity")})


def secret_scan(df: DataFrame, col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per record and credential pattern found in it, with the number of hits."""
    patterns = patterns or CREDENTIALS
    suspects = df.filter(F.col(col).rlike("|".join(patterns.values())))
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(col, F.lit(p)).cast("long").alias("hits"))
                     for n, p in patterns.items()])
    return (suspects.withColumn("__h", F.explode(hits)).filter("__h.hits > 0")
            .select(*[c for c in df.columns if c != col], "__h.pattern", "__h.hits"))
