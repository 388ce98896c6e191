"""Source documents: manifests, texts by path, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import collapse_white

SCHEMA = (
    "source_doc_id string, ticker string, event_id string, event_time string, event_type string, event_subtype string, release_session string, source_type string, "
    "source_url string, title string, path string, text string, fiscal_period_end string, sector_benchmark string, notes string"
)


def read_manifest(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A CSV manifest of documents; a document without ``text`` takes the file at its ``path`` below ``folder``.

    Files are read by Spark, once, and joined by path.
    """
    manifest = spark.read.schema(SCHEMA).options(header=True, multiLine=True, escape='"').csv(path)
    if folder is None:
        return manifest
    texts = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("value").alias("_text"), F.input_file_name().alias("_file"))
    key = F.regexp_extract(F.col("_file"), r"([^/]+)$", 1)
    joined = manifest.withColumn("_name", F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]+)$", 1)).join(texts.withColumn("_name", key), "_name", "left")
    return joined.withColumn("text", F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.col("_text"))).drop("_name", "_file", "_text")


def ingest(docs: DataFrame, least: int = 200) -> DataFrame:
    """Normalised texts with content hash, number of copies and the reason to skip (too_short, empty), empty for those that stay."""
    clean = collapse_white(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("text", clean).withColumn("n_chars", F.length("text")).withColumn("content_hash", F.sha2("text", 256))
    reason = F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") < least, "too_short").otherwise("")
    return rows.withColumn("skip_reason", reason).withColumn("copies", F.count("*").over(Window.partitionBy("content_hash")))


def filing_items(text: F.Column) -> F.Column:
    """Distinct item numbers such as 1.05 or 8.01 that a filing names, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)item\s+([0-9]\.[0-9]{2})"), F.lit(1))))


def filter_filings(filings: DataFrame, start: str | None = None, end: str | None = None, items: tuple[str, ...] = ()) -> DataFrame:
    """Filings of a date range that name one of the items (all, if none is asked for)."""
    keep = F.lit(True)
    if start:
        keep &= F.col("filing_date") >= start
    if end:
        keep &= F.col("filing_date") <= end
    if items:
        keep &= F.arrays_overlap(F.col("items"), F.array(*[F.lit(i) for i in items]))
    return filings.where(keep)
