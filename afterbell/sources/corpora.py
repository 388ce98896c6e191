"""Universes, earnings rows from EPS histories and filings, award rows from search results, and seeded demo tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import safe_pct_delta

# Preset universes with their sector benchmark.
UNIVERSES = {
    "semiconductors": ("SOXX", "NVDA AMD AVGO INTC QCOM TXN MU ADI MRVL AMAT LRCX KLAC MCHP ON NXPI MPWR TER ASML TSM"),
    "mega_cap_tech": ("XLK", "AAPL MSFT NVDA GOOGL GOOG META AMZN TSLA AVGO ORCL"),
    "cloud_software": ("IGV", "MSFT CRM NOW ADBE SNOW DDOG NET MDB CRWD ZS PANW TEAM WDAY SHOP"),
}
SECTORS = {
    "semiconductors": ("SMH", "NVDA AMD AVGO INTC QCOM TXN MU ADI MRVL AMAT LRCX KLAC ON MCHP"),
    "mega_cap_tech": ("QQQ", "AAPL MSFT GOOGL GOOG AMZN META NVDA TSLA AVGO ORCL"),
    "software": ("IGV", "MSFT ORCL CRM ADBE NOW SNOW DDOG MDB NET PLTR CRWD ZS"),
    "biotech": ("XBI", "AMGN GILD REGN VRTX BIIB MRNA BMRN ILMN INCY ALNY"),
    "banks": ("KBE", "JPM BAC WFC C GS MS USB PNC TFC COF"),
}
SECTOR_ALIASES = {"semis": "semiconductors", "tech_platforms": "mega_cap_tech", "cloud_software": "software"}
EARNINGS_ITEM = "2.02"
EARNINGS_WORDS = r"(?i)results of operations|earnings|quarterly results|financial results"


def preset(spark: SparkSession, name: str, sectors: bool = False) -> DataFrame:
    """universe, ticker, sector_benchmark of a preset; names may hold spaces and dashes, an unknown one is an error."""
    known = SECTORS if sectors else UNIVERSES
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = SECTOR_ALIASES.get(key, key) if sectors and key not in known else key
    if key not in known:
        raise ValueError(f"unknown universe {name!r}; there are {', '.join(sorted(known))}")
    benchmark, tickers = known[key]
    return spark.createDataFrame([(key, t, benchmark) for t in tickers.split()], "universe string, ticker string, sector_benchmark string")


def universe_of(table: DataFrame) -> DataFrame:
    """Different upper-case tickers of a universe table, each with the table's most frequent benchmark (ties: the lesser; NULL if it names none)."""
    tickers = table.where(F.trim("ticker") != "").select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    if "sector_benchmark" not in table.columns:
        return tickers.withColumn("sector_benchmark", F.lit(None).cast("string"))
    named = table.select(F.upper(F.trim("sector_benchmark")).alias("b")).where("b <> ''").groupBy("b").agg(F.count("*").alias("n"))
    modal = named.agg(F.min_by("b", F.struct((-F.col("n")).alias("n"), "b")).alias("sector_benchmark"))
    return tickers.join(F.broadcast(modal))  # one row


def earnings_rows(history: DataFrame, session: str = "unknown", benchmark: str = "", last: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Event rows from a history of quarterly earnings: ticker, reported_date, fiscal_period_end, actual_eps, consensus_eps.

    The time of day follows the session: 08:00 before the open, 16:05 after the close, else 12:00. One row per
    id; with ``last`` the last so many of each ticker, by report date.
    """
    rows = history.select(F.upper(F.trim("ticker")).alias("ticker"), F.try_to_date("reported_date").alias("d"), F.try_to_date("fiscal_period_end").alias("q"), F.col("actual_eps").try_cast("double").alias("actual_eps"), F.col("consensus_eps").try_cast("double").alias("consensus_eps"))
    rows = rows.where(F.col("d").isNotNull() & (F.col("ticker") != ""))
    rows = rows.where(F.col("d") >= F.lit(start)) if start else rows
    rows = rows.where(F.col("d") <= F.lit(end)) if end else rows
    rows = rows.groupBy("ticker", "d").agg(F.max(F.struct("q", "actual_eps", "consensus_eps")).alias("x")).select("ticker", "d", "x.*")
    if last:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where(F.col("_k") <= last)
    clock = {"before_open": " 08:00:00", "after_close": " 16:05:00"}.get(session, " 12:00:00")
    label = F.coalesce(F.col("q").cast("string"), F.lit("unknown"))
    return rows.select(
        F.concat_ws("_", F.lit("earnings"), "ticker", F.date_format("d", "yyyyMMdd"), F.regexp_replace(label, "-", "")).alias("event_id"), "ticker", F.to_timestamp(F.concat(F.col("d").cast("string"), F.lit(clock))).alias("event_time"),
        F.lit("earnings").alias("event_type"), F.lit("quarterly_eps").alias("event_subtype"), F.lit(session).alias("release_session"), label.alias("fiscal_period_end"), F.lit(benchmark).alias("sector_benchmark"),
        "actual_eps", "consensus_eps", safe_pct_delta(F.col("actual_eps"), F.col("consensus_eps")).alias("eps_surprise_pct"),
    )


def earnings_filings(filings: DataFrame, benchmark: str = "") -> DataFrame:
    """Event rows of current reports with the item of results, or that say so: accession, ticker, form, accepted_at, items, title."""
    current = F.upper(F.trim("form")).isin("8-K", "8-K/A")
    said = F.coalesce(F.col("items").contains(EARNINGS_ITEM), F.lit(False)) | F.coalesce(F.col("title").rlike(EARNINGS_WORDS), F.lit(False))
    minute = F.hour("accepted_at") * 60 + F.minute("accepted_at")
    session = F.when(minute < 570, "before_open").when(minute >= 960, "after_close").otherwise("intraday")
    rows = filings.where(current & said & F.col("accepted_at").isNotNull())
    return rows.select(
        F.concat_ws("_", F.lit("earnings"), F.upper("ticker"), F.regexp_replace("accession", "[^A-Za-z0-9]+", "")).alias("event_id"), F.upper("ticker").alias("ticker"), F.col("accepted_at").alias("event_time"), F.lit("earnings").alias("event_type"),
        F.when(F.col("form").endswith("/A"), "amended_results").otherwise("results").alias("event_subtype"), session.alias("release_session"), F.lit(benchmark).alias("sector_benchmark"),
    )


AWARD = "`Award ID` string, `Recipient Name` string, `Start Date` string, `End Date` string, `Award Amount` double, `Contract Award Type` string, `Awarding Agency` string, `Awarding Sub Agency` string, Description string, generated_internal_id string"


def award_rows(results: DataFrame, mapping: DataFrame, json_col: str = "value", least_confidence: float = 0.8) -> DataFrame:
    """Source rows of award search results (one JSON text each), with the recipient's ticker where the mapping is sure.

    mapping: recipient_name, mapped_ticker, recipient_mapping_confidence. Amounts of vehicles (indefinite
    delivery, BPA, BOA) are ceilings, others obligated. Texts that aren't JSON give no row.
    """
    x = results.select(F.from_json(json_col, AWARD).alias("x")).where("x.`Award ID` is not null").select("x.*")
    recipient = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col("Recipient Name"), F.lit("")))), r"[^a-z0-9]+", " ")
    best = mapping.select(F.regexp_replace(F.lower(F.trim("recipient_name")), r"[^a-z0-9]+", " ").alias("_r"), F.struct("recipient_mapping_confidence", "mapped_ticker").alias("m")).groupBy("_r").agg(F.max("m").alias("m"))
    kind = F.coalesce(F.col("Contract Award Type"), F.lit(""))
    vehicle = F.lower(kind).contains("indefinite") | F.lower(F.coalesce(F.col("generated_internal_id"), F.lit(""))).contains("idv") | F.upper(kind).isin("BPA", "BOA")
    amount, day = F.col("Award Amount"), F.try_to_date("Start Date")
    slug = lambda c, n: F.substring(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), 1, n)
    sure = F.coalesce(F.col("m.recipient_mapping_confidence") >= least_confidence, F.lit(False)) & (F.trim("m.mapped_ticker") != "")
    ticker = F.when(sure, F.upper("m.mapped_ticker")).otherwise("")
    joined = x.withColumn("_r", recipient).join(best, "_r", "left").withColumn("ticker", ticker)
    return joined.select(
        F.concat(F.lit("award_"), slug(F.coalesce(F.nullif(F.trim("generated_internal_id"), F.lit("")), F.col("Award ID")), 96)).alias("source_doc_id"), "ticker",
        F.concat_ws("_", F.lit("government_contract"), F.when(F.col("ticker") == "", "UNMAPPED").otherwise(F.col("ticker")), slug(F.col("Award ID"), 48)).alias("event_id"),
        F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00"))).alias("event_time"), F.lit("government_contract").alias("event_type"), F.lit("award").alias("event_subtype"), F.lit("unknown").alias("release_session"),
        F.col("Recipient Name").alias("recipient_name"), F.coalesce(F.col("m.recipient_mapping_confidence"), F.lit(0.0)).alias("recipient_mapping_confidence"), F.col("Awarding Agency").alias("agency"), F.col("Awarding Sub Agency").alias("sub_agency"),
        amount.alias("award_amount"), F.when(~vehicle, amount).alias("obligated_amount"), F.when(vehicle & (amount > 0), amount).alias("contract_ceiling"), kind.alias("award_type"), day.alias("period_start"), F.try_to_date("End Date").alias("period_end"), F.col("Description").alias("description"),
    )


def _uniform(seed: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _normal(seed: int, *key: Column) -> Column:
    """A standard normal number that seed and key decide."""
    return F.sqrt(-2 * F.ln(_uniform(seed, *key) * (1 - 2e-9) + 1e-9)) * F.cos(2 * 3.141592653589793 * _uniform(seed + 1, *key))


def demo_bars(spark: SparkSession, tickers: Sequence[str], days: int = 300, start: str = "2022-01-03", seed: int = 7) -> DataFrame:
    """ticker, d, price, volume: random walks on weekdays. The same arguments give the same rows, whatever the partitions."""
    day = F.date_add(F.lit(start).cast("date"), F.col("id").cast("int"))
    calendar = spark.range(days * 7 // 5 + 7).select(day.alias("d")).where(F.weekday("d") < 5).orderBy("d").limit(days)
    grid = spark.createDataFrame([(t,) for t in tickers], "ticker string").join(F.broadcast(calendar))
    step = 0.0003 + 0.015 * _normal(seed, F.col("ticker"), F.col("d"))
    w = Window.partitionBy("ticker").orderBy("d")
    walk = F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grid.select("ticker", "d", (100 * F.exp(walk)).alias("price"), F.floor(1e5 + 9e5 * _uniform(seed + 2, F.col("ticker"), F.col("d"))).cast("double").alias("volume"))


def demo_events(bars: DataFrame, every: int = 20, seed: int = 7) -> DataFrame:
    """event_id, ticker, event_time, release_session, event_type, actual_eps, consensus_eps on about one bar in ``every``."""
    chosen = bars.where(_uniform(seed + 3, F.col("ticker"), F.col("d")) < 1 / every)
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(_uniform(seed + k, F.col("ticker"), F.col("d")) * len(names)) + 1).cast("int"))
    rows = chosen.select("ticker", "d", pick(("before_open", "intraday", "after_close"), 4).alias("release_session"), pick(("earnings", "guidance"), 5).alias("event_type"), F.round(1 + _normal(seed + 6, F.col("ticker"), F.col("d")) / 4, 2).alias("consensus_eps"))
    clock = F.when(F.col("release_session") == "before_open", " 08:00:00").when(F.col("release_session") == "after_close", " 16:05:00").otherwise(" 12:00:00")
    return rows.select(
        F.concat_ws("_", F.lit("demo"), "ticker", F.date_format("d", "yyyyMMdd")).alias("event_id"), "ticker", F.to_timestamp(F.concat(F.col("d").cast("string"), clock)).alias("event_time"), "release_session", "event_type",
        F.round(F.col("consensus_eps") * (1 + 0.1 * _normal(seed + 7, F.col("ticker"), F.col("d"))), 2).alias("actual_eps"), "consensus_eps",
    )
