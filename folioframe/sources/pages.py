"""Page, file and recogniser sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes (hex) of the accepted file types.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "webp": "52494646", "parquet": "50415231"}
MAX_BYTES = 20 * 1024 * 1024

# Columns of a recogniser's tab-separated output.
OCR_TSV = ("level STRING, page_num STRING, block_num STRING, par_num STRING, line_num STRING, word_num STRING, "
           "left STRING, top STRING, width STRING, height STRING, conf STRING, text STRING")


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=OCR_TSV, quote="", mode="PERMISSIVE")


def ingest_ocr_tsv(df: DataFrame, page_w: Column, page_h: Column, min_conf: float = 25) -> DataFrame:
    """Word rows (level 5) that are confident, not blank and parse, with page-relative boxes."""
    n = {c: F.expr(f"try_cast({c} AS INT)") for c in ("left", "top", "width", "height")}
    keep = ((F.expr("try_cast(level AS INT)") == 5) & (F.expr("try_cast(conf AS DOUBLE)") >= min_conf) & (F.trim("text") != ""))
    for c in n.values():
        keep = keep & c.isNotNull()
    rest = [c for c in df.columns if c not in (*n, "level", "conf", "text")]
    # Halves are rounded to even.
    return df.filter(keep).select(*rest, F.trim("text").alias("text"), F.bround(n["left"] / page_w, 6).alias("x"), F.bround(n["top"] / page_h, 6).alias("y"),
                                  F.bround(n["width"] / page_w, 6).alias("w"), F.bround(n["height"] / page_h, 6).alias("h"))


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Pages (book, n) whose book has its marker file and whose numeric folder has a layout, sorted."""
    p = F.col(path)
    layout = "^(?:.*/)?([^/]+)/pages/([0-9]+)/layout\\.json$"
    marker = "^(?:.*/)?([^/]+)/book\\.json$"
    pages = files.filter(p.rlike(layout)).select(F.regexp_extract(p, layout, 1).alias("book"), F.regexp_extract(p, layout, 2).cast("int").alias("n"))
    books = files.filter(p.rlike(marker)).select(F.regexp_extract(p, marker, 1).alias("book"))
    return pages.join(books, "book", "left_semi").distinct().orderBy("book", "n")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths, sizes and times below a folder, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def signature_verdict(name: Column, head: Column, length: Column, *, signatures: dict[str, str] | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """ok, or why a file is not accepted: from its name, its first 12 bytes and its length."""
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in (signatures or SIGNATURES).items() for x in kv]), extension)
    start = F.hex(head)
    fits = F.when(extension == "webp", start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250")).otherwise(start.startswith(wanted))
    return (F.when(F.coalesce(length, F.lit(0)) == 0, "empty").when(length > max_bytes, "too large").when(wanted.isNull(), "unknown type")
            .when(F.coalesce(fits, F.lit(False)), "ok").otherwise("wrong content"))


def check_signatures(spark: SparkSession, path: str, *, signatures: dict[str, str] | None = None, max_bytes: int = MAX_BYTES,
                     listed: DataFrame | None = None) -> DataFrame:
    """Whether each file's content fits its extension, is not empty and keeps the size limit.

    Files over the limit are judged by their size alone, so their content is never loaded.  Spark reads no
    rows from files of no length; they are found by a list of the expected files (column name).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sized = files.filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    verdict = signature_verdict(F.col("path"), F.substring("content", 1, 12), F.col("length"), signatures=signatures, max_bytes=max_bytes)
    checked = sized.select("path", "length", verdict.alias("verdict"))
    done = checked.unionByName(files.filter(F.col("length") > max_bytes).select("path", "length", F.lit("too large").alias("verdict")))
    if listed is None:
        return done
    there = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    absent = listed.select("name").join(there, "name", "left_anti")
    return done.unionByName(absent.select(F.col("name").alias("path"), F.lit(0).cast("long").alias("length"), F.lit("empty").alias("verdict")))


LINK = "(?:src|href|data-src)=\"([^\"<>]+)\""


def references(pages: DataFrame, html: str, ident: str, pattern: str = LINK) -> DataFrame:
    """Distinct resource links per page."""
    return pages.select(ident, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).alias("url"))


def referenced_copies(pages: DataFrame, html: str, ident: str, files: DataFrame, pattern: str = LINK) -> DataFrame:
    """Links of each page resolved against the known files (column ``file``), with a missing flag."""
    links = references(pages, html, ident, pattern).withColumn("file", F.regexp_replace("url", "[?#].*$", ""))
    known = files.select("file").distinct().withColumn("__known", F.lit(True))
    return links.join(known, "file", "left").select(ident, "url", "file", F.col("__known").isNull().alias("missing"))


def missing_references(resolved: DataFrame) -> DataFrame:
    return resolved.filter("missing")
