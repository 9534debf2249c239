"""Schemas of the page, journal and lesson documents, and a tolerant JSON reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"

OCR_PAGE = """book_id STRING, page INT, engine STRING, dpi INT, width INT, height INT, sourceHash STRING,
lines ARRAY<STRUCT<id: INT, text: STRING, confidence: DOUBLE, position: STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>>>"""

TOKEN = """book_id STRING, page INT, id INT, text STRING, originalText STRING, normalization STRING, segment INT, sourceRegion INT,
confidence DOUBLE, reviewRequired BOOLEAN, recognizer STRING, tone INT, speechText STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"""

ISSUE = "book_id STRING, page INT, kind STRING, sourceRegion INT, sourceText STRING, text STRING, confidence DOUBLE, box ARRAY<INT>, note STRING"

WORD_BOX = "book_id STRING, page INT, text STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"

TRANSLATION = "book_id STRING, page INT, block_id STRING, path STRING, source STRING, ru STRING, kk STRING, sourceHash STRING"

JOURNAL_ENTRY = """id STRING, no BIGINT, at TIMESTAMP, kind STRING, model STRING, provider STRING, cost DOUBLE, subscription BOOLEAN, page INT,
purpose STRING, section STRING, prompt STRING, settings MAP<STRING, STRING>, refs INT, file STRING, mime STRING, size BIGINT, hash STRING,
sourceKey STRING, imported BOOLEAN, rating INT, comment STRING, ratedAt TIMESTAMP"""

REVIEW_EVENT = "user_id BIGINT, ts TIMESTAMP, seconds DOUBLE, word STRING, passed BOOLEAN"

JOB = "id STRING, book STRING, `from` INT, `to` INT, engine STRING, state STRING, createdAt TIMESTAMP, completed INT, error STRING"

EXPORT_MANIFEST = "book STRING, sourcePage INT, conversionId STRING, exportedAt TIMESTAMP, englishLayers INT, resources ARRAY<STRING>"

MEDIA_MANIFEST = """count INT, total_bytes BIGINT, total_duration_seconds DOUBLE,
tracks ARRAY<STRUCT<id: STRING, title: STRING, file: STRING, source: STRING, bytes: BIGINT, duration_seconds: DOUBLE, bitrate: INT, sha256: STRING>>"""

FEEDBACK = "time TIMESTAMP, page STRING, message STRING"

STROKE = "glyph STRING, pinyin STRING, translation STRING, medians ARRAY<ARRAY<ARRAY<INT>>>, paths ARRAY<STRING>"


def read_documents(spark: SparkSession, path: str, schema: str, *, multiline: bool = False) -> DataFrame:
    """JSON documents with a given schema; malformed ones become rows of nulls with their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per recognised line of the pages of ``OCR_PAGE``."""
    return pages.selectExpr("book_id", "page", "inline(lines)").selectExpr(
        "book_id", "page", "id", "text", "confidence", "position.x AS x", "position.y AS y", "position.width AS w", "position.height AS h")
