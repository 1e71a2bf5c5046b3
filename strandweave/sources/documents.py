"""Text out of files, text into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze

#: File types that are taken in, the largest text, and how many items a batch may have.
TYPES = ("pdf", "docx", "pptx", "xlsx", "xls", "txt", "md", "html", "htm", "csv", "json")
MOST_BYTES, MOST_ITEMS, RESULT_MINUTES = 20 * 1024 * 1024, 20, 30
PLAIN = ("txt", "md", "csv", "json")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, size, sha256, content): files of the accepted types; the listing filters before any is read."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.withColumn("extension", extension).filter(F.col("extension").isin(*TYPES)).select("path", "extension", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def html_text(html: Column) -> Column:
    """Readable text of HTML: no scripts, styles or comments, blocks on their own lines, entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), squeeze), lambda x: F.length(x) > 0)
    return F.array_join(lines, "\n")


def table_rows(html: Column) -> Column:
    """Rows of the tables of an HTML text as ``cell | cell`` lines: spreadsheets saved as HTML."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda c: squeeze(F.regexp_replace(c, r"(?s)<[^>]+>", " ")))
    return F.array_join(F.filter(F.transform(rows, lambda r: F.array_join(F.filter(cells(r), lambda c: F.length(c) > 0), " | ")), lambda x: F.length(x) > 0), "\n")


def extracted(df: DataFrame) -> DataFrame:
    """(path, extension, text, error): what this engine reads itself; other formats name the converter they need."""
    body = F.decode("content", "UTF-8")
    text = F.when(F.col("extension").isin(*PLAIN), body).when(F.col("extension").isin("html", "htm"), html_text(body)).when((F.col("extension") == "xls") & body.rlike("(?i)<table"), table_rows(body))
    filled = F.nullif(F.trim(text), F.lit(""))
    error = F.when(filled.isNotNull(), F.lit(None)).when(text.isNull(), "CONVERTER_REQUIRED").otherwise("EMPTY_TEXT")
    return df.select("path", "extension", filled.alias("text"), error.alias("error"))


def accepted(df: DataFrame, text: str) -> DataFrame:
    """Adds ``rejection``: why a text is not taken in (null: it is). Items fail one by one."""
    t = F.col(text)
    return df.withColumn("rejection", F.when(t.isNull() | (F.length(F.trim(t)) == 0), "BLANK_TEXT").when(F.octet_length(t) > MOST_BYTES, "TEXT_TOO_LARGE"))


def in_batches(df: DataFrame, batch: str) -> DataFrame:
    """(batch, n, n_accepted, state) of items with their ``rejection``: a batch of more than ``MOST_ITEMS`` is rejected whole; else it is queued, partial or rejected by how its items fared."""
    n = df.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(F.col("rejection").isNull()).alias("n_accepted"))
    state = F.when(F.col("n") > MOST_ITEMS, "TOO_MANY_ITEMS").when(F.col("n_accepted") == F.col("n"), "queued").when(F.col("n_accepted") > 0, "partial").otherwise("rejected")
    return n.withColumn("state", state)


def live_once(df: DataFrame, *keys: str, text: str, order: list[Column]) -> DataFrame:
    """One row for each content within keys, the first in order; adds ``sha256``."""
    from ..operators.metadata import latest_of

    return latest_of(df.withColumn("sha256", F.sha2(F.col(text), 256)), [*keys, "sha256"], *order)


def store_results(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Writes results with the time they expire."""
    at = now if now is not None else F.current_timestamp()
    df.withColumn("expires_at", at + F.expr(f"INTERVAL {RESULT_MINUTES} MINUTES")).write.mode("append").parquet(path)


def stored_results(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Results that have not expired."""
    at = now if now is not None else F.current_timestamp()
    return spark.read.parquet(path).filter(F.col("expires_at") > at)
