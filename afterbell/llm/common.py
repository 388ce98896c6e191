"""What the training-data operators share: shared scratch tables and table reading."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.sources.shared import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/afterbell/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a re-computation, and values that
    depend on partitioning (partition ids, row ids) are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table behind ``df`` (for loops that replace one table by the next)."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what a task makes of whole texts is small at any time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Most bits of a filter, and the bytes of one of its pieces.
FILTER_BITS, FILTER_PIECE = 1 << 27, 1 << 13


def mark_cell(col: str, bits: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(bits))


def marks(values: DataFrame, col: str) -> tuple[Broadcast, int]:
    """Bits (in bytes, least significant first) at :func:`mark_cell` of each value, for leaving out rows before a shuffle; and how many.

    A row whose bit isn't set is no value; one whose bit is set may be none. At most 16 MB, whatever the number of values.
    """
    bits = min(FILTER_BITS, max(8 * FILTER_PIECE, 1 << (16 * values.count()).bit_length()))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            cells = batch.column(0).to_numpy()
            np.bitwise_or.at(own, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
        pieces = own.reshape(-1, FILTER_PIECE)
        held = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([pieces[k].tobytes() for k in held], pa.binary())], names=["piece", "bits"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(own, np.uint8)
                held[piece] = held[piece] | own if piece in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["piece", "bits"])

    spark = values.sparkSession
    pieces = values.select(mark_cell(col, bits)).mapInArrow(some, "piece int, bits binary").repartition(partitions(spark), "piece").mapInArrow(whole, "piece int, bits binary")
    out = np.zeros(bits // 8, np.uint8).reshape(-1, FILTER_PIECE)
    for row in pieces.collect():
        out[row.piece] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(out.ravel()), bits


def hits(shared: Broadcast, cells: pa.Array) -> np.ndarray:
    """Whether the bits of the cells are set."""
    at = cells.to_numpy()
    return (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1


def text_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))
