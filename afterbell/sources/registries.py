"""Registries, observation feeds, company facts, ownership filings: files to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.functions.exprs import safe_id

OBSERVATION = (
    "slug string, title string, source_name string, source_kind string, source_url string, official_source boolean, timestamp_quality string, delayed_digest_reasons array<string>, hard_negatives array<string>, "
    "materiality_fields array<string>, evidence array<string>, tags array<string>, mapping_notes string, liquidity_notes string, sample_size_hint int, observed_at string, proposed_by string, _corrupt_record string"
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations from JSON lines anywhere below ``path``; lines that can't be read keep their text in _corrupt_record."""
    return spark.read.schema(OBSERVATION).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)


def read_pipe_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of Markdown pipe tables: the heading and the rule below it are left out, cells are trimmed."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where(~F.forall("c", lambda c: c.rlike(r"^:?-+:?$")))
    first = F.lower(F.regexp_replace(F.get("c", F.lit(0)), r"[^A-Za-z]+", "_"))
    return rows.where(first != columns[0].lower()).select(*[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(columns)])


def shares_outstanding(companies: DataFrame) -> DataFrame:
    """Dated shares outstanding from company fact JSON (ticker, json): positive values with a filing date, one per (ticker, end, filed)."""
    entry = "struct<end:string, val:double, filed:string, form:string, accn:string>"
    unit = f"map<string, array<{entry}>>"
    concept = f"struct<units:{unit}>"
    schema = f"struct<facts:struct<dei:struct<EntityCommonStockSharesOutstanding:{concept}>, `us-gaap`:struct<CommonStockSharesOutstanding:{concept}>>>"
    parsed = companies.select("ticker", F.from_json("json", schema).alias("j"))
    both = F.array(F.col("j.facts.dei.EntityCommonStockSharesOutstanding.units"), F.col("j.facts")["us-gaap"]["CommonStockSharesOutstanding"]["units"])
    rows = parsed.select("ticker", F.explode(both).alias("u")).select("ticker", F.explode(F.flatten(F.map_values("u"))).alias("e")).select("ticker", "e.*")
    good = rows.where((F.col("val") > 0) & F.col("filed").isNotNull())
    return good.groupBy("ticker", F.to_date("end").alias("asof_date"), F.to_date("filed").alias("filed_at")).agg(F.max("val").alias("shares_outstanding"), F.max_by("form", "accn").alias("form"))


_VALUE = "struct<value:string>"
FORM4 = (
    f"issuer struct<issuerCik:string, issuerName:string, issuerTradingSymbol:string>, reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string, rptOwnerName:string>, "
    "reportingOwnerRelationship:struct<isDirector:string, isOfficer:string, isTenPercentOwner:string, officerTitle:string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{_VALUE}, transactionCoding:struct<transactionCode:string>, "
    f"transactionAmounts:struct<transactionShares:{_VALUE}, transactionPricePerShare:{_VALUE}, transactionAcquiredDisposedCode:{_VALUE}>, "
    f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_VALUE}>>>>"
)


def ownership_transactions(docs: DataFrame, xml: str = "text") -> DataFrame:
    """Transactions of ownership filings (source_doc_id, XML text), one row each, with the first owner and the owner's roles.

    Namespaces are taken off first; documents that aren't XML give no rows.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(xml), r"<\?xml[^>]*\?>|\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    body = F.regexp_extract(clean, r"(?s)<ownershipDocument.*</ownershipDocument>", 0)
    rows = docs.where(clean.contains("<ownershipDocument")).select("source_doc_id", F.from_xml(body, FORM4).alias("d"))
    owner = F.get(F.col("d.reportingOwner"), F.lit(0))
    role = owner["reportingOwnerRelationship"]
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true"), F.lit(False))
    t = rows.select(
        "source_doc_id", F.upper(F.trim("d.issuer.issuerTradingSymbol")).alias("ticker"), owner["reportingOwnerId"]["rptOwnerName"].alias("owner"),
        yes(role["isDirector"]).alias("is_director"), yes(role["isOfficer"]).alias("is_officer"), yes(role["isTenPercentOwner"]).alias("is_ten_percent"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"),
    )
    number = lambda c: F.col(c).try_cast("double")
    return t.select(
        *[c for c in t.columns if c != "t"], F.col("t.transactionDate.value").try_cast("date").alias("transaction_date"), F.trim("t.transactionCoding.transactionCode").alias("code"),
        number("t.transactionAmounts.transactionShares.value").alias("shares"), number("t.transactionAmounts.transactionPricePerShare.value").alias("price"), number("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("owned_after"),
    ).withColumn("value_usd", F.col("shares") * F.col("price"))


def key_values(notes: Column, pair: str = ";", key: str = "=") -> Column:
    """Notes such as ``a=1; b=2`` as a map of trimmed texts."""
    return F.transform_values(F.transform_keys(F.str_to_map(notes, F.lit(pair), F.lit(key)), lambda k, v: F.trim(k)), lambda k, v: F.trim(v))


def document_path(source_doc_id: Column) -> Column:
    return F.concat(safe_id(source_doc_id), F.lit(".txt"))
