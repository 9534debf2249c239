"""Contracts as tables: one row per violation."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and path patterns of published pages.
SLUG = "^[a-z0-9][a-z0-9-]{0,63}$"
ASPECT = "^[0-9]{2,5}/[0-9]{2,5}$"
FILE_PATH = ("^(?:pages/[0-9]{3}/(?:assets/)?|cast/)[A-Za-z0-9][A-Za-z0-9._-]{0,120}\\."
             "(?:webp|png|jpe?g|mp4|webm|mov|mp3|m4a|aac|ogg|wav)$")
TEXT_LIMITS = {"pageNum": 40, "navLabel": 120, "chaoIntro": 600, "task": 600, "systemPrompt": 3000}


def violations(df: DataFrame, report: list[str], rules: dict[str, Column], severity: str = "error") -> DataFrame:
    """One row per broken rule; a rule is true where it is kept, and null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*report, F.explode(broken).alias("rule"), F.lit(severity).alias("severity"))


def repeated(df: DataFrame, report: list[str], keys: list[str], rule: str, severity: str = "error") -> DataFrame:
    """Keys that occur more than once, reported once each."""
    return (df.groupBy(*dict.fromkeys([*report, *keys])).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
            .select(*report, F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def over_limit(df: DataFrame, report: list[str], limit: int, rule: str, *, minimum: int = 0) -> DataFrame:
    return (df.groupBy(*report).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > limit) | (F.col("__n") < minimum))
            .select(*report, F.lit(rule).alias("rule"), F.lit("error").alias("severity")))


def present(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def strict_int(c: str) -> Column:
    """Text that is a plain whole number; true, 1.0 and the like are not."""
    return F.col(c).rlike("^-?[0-9]+$") & F.expr(f"try_cast(`{c}` AS INT)").isNotNull()


def vocab_contract(vocab: DataFrame, report: list[str], maximum: int = 20) -> DataFrame:
    """Words need text, reading and translation (the part of speech may be empty), at most ``maximum`` per page."""
    rows = violations(vocab, report, {"vocab.word": present("word"), "vocab.py": present("py"), "vocab.trans": present("trans"), "vocab.pos": F.col("pos").isNotNull()})
    return rows.unionByName(over_limit(vocab, report, maximum, "vocab.count"))


def draft_contract(pages: DataFrame, expected: DataFrame, vocab: DataFrame, draft: str) -> DataFrame:
    """Drafts whose pages are not exactly the expected ones or lack text.

    ``pages``: draft, pdf_page (text as received), task, chaoIntro; ``expected``: draft, page (int);
    ``vocab``: draft, pdf_page, word, py, pos, trans.
    """
    report = [draft, "pdf_page"]
    rows = violations(pages, report, {"task": present("task"), "chaoIntro": present("chaoIntro"), "pdf_page.type": strict_int("pdf_page")})
    ints = pages.filter(strict_int("pdf_page")).withColumn("page", F.col("pdf_page").cast("int"))
    e = expected.select(draft, "page")
    out_of_range = ints.join(e, [draft, "page"], "left_anti").select(*report, F.lit("pdf_page.range").alias("rule"), F.lit("error").alias("severity"))
    twice = repeated(ints.withColumn("pdf_page", F.col("page").cast("string")), report, [], "pdf_page.unique")
    lost = e.join(ints, [draft, "page"], "left_anti").select(draft, F.col("page").cast("string").alias("pdf_page"), F.lit("pages.missing").alias("rule"), F.lit("error").alias("severity"))
    return rows.unionByName(out_of_range).unionByName(twice).unionByName(lost).unionByName(vocab_contract(vocab, report))


def lesson_contract(blocks: DataFrame, pages: DataFrame, lesson: str, page: str) -> DataFrame:
    """Pages and blocks that break the rules of a lesson; electronic pages have more rules than scanned ones.

    ``pages``: lesson, page, page_type, scan (number of the scan), width, height; ``blocks``: lesson, page, page_type, book, id,
    type, text, translation, alt, image, x, y, w, h.  Blocks of a page of unknown type are not judged, the page is.
    """
    report = [lesson, page]
    def size(c):
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) > 0)
    page_rules = {"page.type": F.col("page_type").isin("scanned", "electronic"), "scan.number": F.col("scan") >= 1, "scan.size": size("width") & size("height")}
    per_page = violations(pages, report, page_rules)
    twice = pages.groupBy(lesson, "scan").agg(F.count(F.lit(1)).alias("__n"), F.min(page).alias(page)).filter("__n > 1").select(
        *report, F.lit("scan.unique").alias("rule"), F.lit("error").alias("severity"))

    electronic = F.coalesce(F.col("page_type") == "electronic", F.lit(False))
    text, image = (F.coalesce(F.col("type") == kind, F.lit(False)) for kind in ("text", "image"))
    n = {c: F.col(c) for c in "xywh"}
    within = lambda c: c.isNotNull() & ~F.isnan(c) & c.between(0, 1)
    upload = F.concat(F.lit("^/assets/\\Q"), F.col("book"), F.lit("\\E/[a-f0-9]{32}\\.(?:png|jpe?g|webp)$"))
    of_electronic = {
        "block.id": present("id"), "block.type": text | image,
        "block.text": ~text | (present("text") & F.col("translation").isNotNull()),
        "block.length": ~text | ((F.length(F.coalesce("text", F.lit(""))) <= 2000) & (F.length(F.coalesce("translation", F.lit(""))) <= 2000)),
        "block.alt": ~image | present("alt"), "block.image": ~image | F.regexp_like(F.col("image"), upload),
        "block.box": (n["w"] > 0) & (n["h"] > 0) & (n["x"] + n["w"] <= 1.001) & (n["y"] + n["h"] <= 1.001)}
    rules = {name: ~electronic | ok for name, ok in of_electronic.items()}
    rules["block.text"] = F.when(electronic, of_electronic["block.text"]).otherwise(present("text"))
    rules["block.number"] = within(n["x"]) & within(n["y"]) & within(n["w"]) & within(n["h"])
    rows = violations(blocks.filter(F.col("page_type").isin("scanned", "electronic")), report, rules)
    own = blocks.filter(electronic)
    ids = repeated(own.filter(present("id")), report, [*report, "id"], "block.unique")
    sizes = own.groupBy(*report).agg(F.count(F.lit(1)).alias("__n"))
    counted = pages.filter(electronic).select(*report).distinct().join(sizes, report, "left")
    count = violations(counted, report, {"blocks.count": F.coalesce("__n", F.lit(0)).between(1, 500)})
    return per_page.unionByName(twice).unionByName(rows).unionByName(ids).unionByName(count)


def publish_contract(pages: DataFrame, files: DataFrame, words: DataFrame, vocab: DataFrame, slug: str, n: str, *,
                     required: Collection[str] = ()) -> DataFrame:
    """Published pages that break the rules.

    ``pages``: slug, n, aspect, crop_left, crop_right, lesson_number, title and the text fields of
    ``TEXT_LIMITS`` that are at hand (every page breaks the rule of a ``required`` one that is not); ``files``: slug, n, path; ``words``: slug, n, word; ``vocab`` as above.
    """
    report = [slug, n]
    crop = lambda c: F.col(c).isNull() | F.col(c).between(0, 0.2)
    rules = {"book.slug": F.col(slug).rlike(SLUG), "page.n": F.col(n).between(1, 999), "page.aspect": F.col("aspect").rlike(ASPECT), "page.crop": crop("crop_left") & crop("crop_right"),
             "lesson.number": F.col("lesson_number").between(0, 999), "lesson.title": present("title") & (F.length("title") <= 160)}
    rules |= {f"page.{c}": present(c) & (F.length(c) <= limit) for c, limit in TEXT_LIMITS.items() if c in pages.columns}
    rules |= {f"page.{c}": F.lit(False) for c in required if c not in pages.columns}
    rows = violations(pages, report, rules)
    own = F.concat(F.lit("pages/"), F.lpad(F.col(n).cast("string"), 3, "0"), F.lit("/"))
    paths = violations(files, report, {"file.path": F.col("path").rlike(FILE_PATH), "file.page": ~F.col("path").startswith("pages/") | F.col("path").startswith(own)})
    texts = violations(words, report, {"builder.word": F.length("word").between(1, 40)})
    return (rows.unionByName(paths).unionByName(texts).unionByName(over_limit(words, report, 12, "builder.count"))
            .unionByName(over_limit(files, report, 80, "files.count")).unionByName(vocab_contract(vocab, report, 200)))
