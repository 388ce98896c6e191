"""Daily bars: normalisation and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Other names that price files use for the columns.
ALIASES = {"date": ("date", "datetime", "timestamp"), "adj_close": ("adj_close", "adj close", "adjusted_close", "adjclose"), "close": ("close", "last"), "volume": ("volume", "vol")}


def first_price_per_day(rows: DataFrame, place: str) -> DataFrame:
    """Rows with ticker, d and price, one per ticker and day: the first by ``place``; rows without a price are dropped first."""
    w = Window.partitionBy("ticker", "d").orderBy(place)
    return rows.where(F.col("price").isNotNull() & F.col("d").isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def read_bars(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Bars (ticker, d, price, volume) from CSV files with any of the known column names.

    The adjusted close is the price, else the close. Without ``ticker`` the file's name is the
    ticker (``.../ABC.csv``), or the partition folder's (``.../ticker=ABC/``). The first row of a day wins.
    """
    raw = spark.read.option("header", True).csv(path)
    named = {c.strip().lower(): c for c in raw.columns}

    def column(name: str) -> F.Column | None:
        return next((F.col(f"`{named[a]}`") for a in ALIASES[name] if a in named), None)

    day, adjusted, close, volume = (column(n) for n in ("date", "adj_close", "close", "volume"))
    if day is None or (adjusted is None and close is None):
        raise ValueError(f"{path}: a date and an adjusted or plain close are needed, found {raw.columns}")
    price = F.coalesce(*[c.try_cast("double") for c in (adjusted, close) if c is not None])
    own = F.lit(ticker) if ticker else F.col("ticker") if "ticker" in named else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.csv[^/]*$", 1)
    rows = raw.select(
        own.alias("ticker"),
        day.try_cast("timestamp").cast("date").alias("d"),
        F.when(~F.isnan(price), price).alias("price"),
        (volume.try_cast("double") if volume is not None else F.lit(None).cast("double")).alias("volume"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_place"),
    )
    return first_price_per_day(rows, "_place").drop("_place")


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that exists, on any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = hadoop.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    return None
