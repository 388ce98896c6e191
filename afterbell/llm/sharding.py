"""Operator 1: contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from afterbell.llm.common import materialize, partitions, text_or_empty


def shard_by_bytes(docs: DataFrame, num_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``num_shards`` shards that are contiguous in ``id_col`` order.

    Rows are dealt into id ranges; per-range totals give each range its global byte offset; a
    running sum inside the range gives each row's byte interval; the shard is the one whose equal
    target interval holds the middle of the row's interval. Only ids, sizes and checksums are
    shuffled, never texts. A row id breaks ties, so one id that holds a third of all rows is
    still spread over several ranges.

    Returns ``id_col``, size (UTF-8 bytes + 1), text_crc32, shard and slot (0.. within the shard).
    Defined cases: a null text counts as empty (size 1, checksum 0); null ids sort first; repeated
    rows are separate rows; an empty table gives an empty result; fewer rows than shards leave
    shards empty; other columns of the input are ignored.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    n = partitions(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    ranged = materialize(
        rows.repartitionByRange(n, F.col("_id").asc_nulls_first(), F.col("_seq")).withColumn("_range", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    # as many rows as ranges, a number the session sets
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    within = Window.partitionBy("_range").orderBy(F.col("_id").asc_nulls_first(), "_seq")
    placed = (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn("_start", F.col("_bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_rank", F.col("_rows_before") + F.row_number().over(within) - 1)
        .withColumn(
            "shard",
            F.expr(
                f"cast(least({num_shards - 1}, ((2 * cast(_start as decimal(38,0)) + size) * {num_shards}) div (2 * cast(_total as decimal(38,0)))) as int)"
            ),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # num_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, num_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as Parquet under ``path/shard=K``, each shard in id order. Ids must be unique and not null."""
    placed = shard_by_bytes(docs, num_shards, id_col, text_col).select(id_col, "shard", "slot")
    (
        docs.drop("shard", "slot")
        .join(placed, id_col)
        .repartitionByRange(partitions(docs.sparkSession), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .drop("slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
