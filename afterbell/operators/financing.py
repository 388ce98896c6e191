"""Terms of financings from filings and releases: facts with evidence, without background deals, fee tables and assumed prices; best amount and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afterbell.functions import taxonomies as T
from afterbell.operators.sections import sectioned

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
# Words of segments whose amounts aren't terms of the deal at hand, and of those that name one.
DATED = rf"(?i)\b(?:{_MONTH})\s+[0-9]{{1,2}},\s+((?:19|20)[0-9]{{2}})\b"
DONE = "issued|sold|received gross proceeds|completed|entered into"
FEES = "rule 457|registration fee|filing fee|fee table|proposed maximum aggregate offering price|calculated pursuant|estimated solely for the purpose of calculating"
ASSUMED = "assumed offering price|last reported sale price|actual number of shares|will vary based"
DILUTION = "net tangible book value|immediate dilution"
DENOMINATION = r"(authorized|minimum) denomination|per \$1,000 principal"
EXCHANGE, NEW = "exchange agreements?|exchange transaction|exchanged for", "issued|priced|offering of"
NOT_OFFERED = "underwriters of the offering to purchase up to an additional|upon conversion|maximum conversion rate|common stock to be outstanding|number of shares"
OFFERED, SOLD = "offering|program|sale|sell|securities", "offer|offering|sale|sell|issued"
PRICED, WARRANT = "public offering|registered direct|price to the public|gross proceeds|offering price|purchase price|at a price of", "exercise price|warrant"
LESS_SURE = "up to|option|additional|upon exercise|warrant shares|issuable upon|convert into|issued and outstanding"
MORE_SURE = r"entered into securities purchase|public offering price|gross proceeds|issued \$|issued and sold"
_AMOUNT = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(billion|bn\b|b\b|million|mn\b|m\b)?"
_PRICE = r"\$\s?([0-9]+(?:\.[0-9]+)?)"
#: Facts: name, confidence, patterns (number, and unit if there is a second group), what the segment must hold and must not hold, unit.
FACTS = (
    ("gross_proceeds", 0.88, (r"(?is)gross proceeds.*?" + _AMOUNT,), (), (FEES,), "usd"),
    ("net_proceeds", 0.82, (r"(?is)net proceeds.*?" + _AMOUNT,), (), (FEES, "gross proceeds"), "usd"),
    ("capacity", 0.80, (r"(?is)(?:aggregate offering price|aggregate purchase price|up to).*?" + _AMOUNT,), (OFFERED,), (FEES, ASSUMED, "gross proceeds|net proceeds"), "usd"),
    ("shares_offered", 0.84, (r"(?i)\b([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)(?:\s*(million|mn))?\s+(?:newly issued\s+|additional\s+|new\s+)?(?:ordinary\s+|common\s+)?shares\b",), (SOLD,), (FEES, ASSUMED, NOT_OFFERED), "shares"),
    ("price_per_share", 0.86, (r"(?is)(?:public offering price|price to the public|purchase price|priced at|at a price)(?:[^$]{0,40})" + _PRICE + r"\s*per\s+share",), (), (FEES, ASSUMED, DILUTION), "usd_per_share"),
    ("convertible_principal", 0.84, (r"(?i)" + _AMOUNT + r"\s+(?:aggregate\s+)?principal amount", r"(?is)principal amount.*?" + _AMOUNT), ("convertible",), (FEES, DENOMINATION), "usd"),
    ("conversion_price", 0.78, (r"(?is)conversion price[^$]*?" + _PRICE,), (), (), "usd_per_share"),
)
#: What a segment with a match of the patterns holds in lower case; looked for first, as it costs least.
HELD = {"gross_proceeds": "gross proceeds", "net_proceeds": "net proceeds", "capacity": "$", "shares_offered": "shares", "price_per_share": "pric", "convertible_principal": "principal amount", "conversion_price": "conversion price"}
COMPLETED = ("completed_equity_offering", "registered_direct_offering", "private_placement", "convertible_note_offering", "atm_program_usage_reported")
DILUTIVE = ("completed_equity_offering", "registered_direct_offering", "private_placement", "atm_program_usage_reported")
CAPACITY = {"atm_program_created": "atm_capacity", "shelf_registration": "shelf_capacity"}
REDEEMED = "redemption of public warrants|public warrants are exercisable"


def _value(text: Column, patterns, units: bool) -> Column:
    found = []
    for p in patterns:
        number = F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
        unit = F.lower(F.regexp_extract(text, p, 2)) if units else F.lit("")
        found.append(number * F.when(unit.startswith("b"), 1e9).when(unit.startswith("m"), 1e6).otherwise(1.0))
    return F.coalesce(*found)


def background(low: Column, event_time: Column) -> Column:
    """Whether a segment tells of a deal of an earlier year than the text's own: its earliest date, and a word of a deal that is done."""
    years = F.transform(F.regexp_extract_all(low, F.lit(DATED), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(low.rlike(DONE) & (F.array_min(years) < F.year(event_time)), F.lit(False))


def financing_facts(docs: DataFrame) -> DataFrame:
    """Facts of (doc_id, text, event_time): doc_id, fact_name, value, unit, confidence, start_char, end_char, evidence_text.

    The best segment for each fact: confidence, then how sure its words are, then place. Segments about deals of earlier
    years, fee tables and assumed prices give none; par values and exercise prices are no offering prices; a text about the
    redemption of warrants offers nothing. An amount up to which may be sold is the capacity of a programme or shelf, else the offering's
    amount. Null texts have no facts.
    """
    label = T.first_label(F.col("text"), T.FINANCING_EVENTS, "unknown")["label"]
    own = docs.select("doc_id", "event_time", label.alias("_event"), F.coalesce(F.lower("text").rlike(REDEEMED), F.lit(False)).alias("_redeemed"))
    rows = sectioned(docs.select("doc_id", "text")).join(own, "doc_id").withColumn("low", F.lower("segment"))
    low, text = F.col("low"), F.col("segment")
    rows = rows.withColumn("_background", background(low, F.col("event_time")))
    found = []
    for name, confidence, patterns, need, reject, unit in FACTS:
        ok = low.contains(HELD[name]) & ~F.col("_background")
        for n in need:
            ok &= low.rlike(n)
        for r in reject:
            ok &= ~low.rlike(r)
        if name in ("gross_proceeds", "shares_offered", "price_per_share"):
            ok &= ~F.col("_redeemed")
        if name == "price_per_share":
            ok &= ~low.rlike(WARRANT) | low.rlike(PRICED)
            sure = F.when(low.contains("gross proceeds"), 0.90).otherwise(confidence)
        else:
            sure = F.lit(confidence)
        if name == "convertible_principal":
            ok &= (F.col("_event") == "convertible_note_offering") & (~low.rlike(EXCHANGE) | low.rlike(NEW))
        value = _value(text, patterns, unit in ("usd", "shares"))
        label = F.when(F.lit(name == "capacity"), F.coalesce(*[F.when(F.col("_event") == e, n) for e, n in CAPACITY.items()], F.lit("offering_amount"))).otherwise(F.lit(name))
        words = F.when(low.rlike(MORE_SURE), 30).otherwise(0) - (F.when(low.rlike(LESS_SURE), 35).otherwise(0) if name == "shares_offered" else F.lit(0))
        found.append(F.when(ok & value.isNotNull(), F.struct(label.alias("fact_name"), value.alias("value"), F.lit(unit).alias("unit"), sure.alias("confidence"), words.alias("words"))))
    # outer, as an inner one would work all patterns out again to see that there is something to explode
    each = rows.withColumn("f", F.explode_outer(F.array_compact(F.array(*found)))).where("f is not null").select("doc_id", "start_char", "end_char", "segment", "f.*")
    best = each.groupBy("doc_id", "fact_name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("words")).alias("w"), "start_char", "end_char", "segment", "value", "unit", "confidence")).alias("b"))
    return best.select("doc_id", "fact_name", *[F.col(f"b.{c}").alias(c) for c in ("value", "unit", "confidence", "start_char", "end_char")], F.col("b.segment").alias("evidence_text"))


def financing_fields(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per text: event, best amount with its source (shares times price where nothing is stated, or far too little), and flags."""
    names = [*(f[0] for f in FACTS if f[0] != "capacity"), "atm_capacity", "shelf_capacity", "offering_amount"]
    wide = facts.groupBy("doc_id").agg(*[F.max(F.when(F.col("fact_name") == n, F.col("value"))).alias(n) for n in names])
    low = F.lower(F.coalesce("text", F.lit("")))
    event = T.first_label(F.col("text"), T.FINANCING_EVENTS, "unknown")["label"]
    warned = low.contains("liquidity") & low.rlike("substantial doubt|cash runway|working capital|continue as a going concern")
    rows = docs.select("doc_id", event.alias("event_type"), low.contains("going concern").alias("going_concern"), warned.alias("_warned")).join(wide, "doc_id", "left")
    kind = F.col("event_type")
    named = lambda *of: F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("amount"), F.lit(n).alias("source"))) for n in of])
    stated = (
        F.when(kind == "convertible_note_offering", named("convertible_principal", "gross_proceeds", "offering_amount", "net_proceeds")).when(kind == "atm_program_created", named("atm_capacity", "offering_amount"))
        .when(kind == "shelf_registration", named("shelf_capacity", "offering_amount")).otherwise(named("gross_proceeds", "offering_amount", "net_proceeds"))
    )
    rows = rows.withColumns({"_stated": stated, "_implied": F.col("shares_offered") * F.col("price_per_share")})
    better = F.col("_stated").isNull() | (kind.isin(*DILUTIVE) & (F.col("_stated.amount") < 1e6) & (F.col("_implied") >= 1e6))
    best = F.when(F.col("_implied").isNotNull() & better, F.struct(F.col("_implied").alias("amount"), F.lit("shares_offered_x_price_per_share").alias("source"))).otherwise(F.col("_stated"))
    return rows.withColumn("_best", best).select(
        "doc_id", "event_type", F.col("_best.amount").alias("amount"), F.col("_best.source").alias("amount_source"), "shares_offered", "price_per_share", kind.isin(*COMPLETED).alias("completed"), kind.isin(*DILUTIVE).alias("dilutive"),
        (kind.isin(*CAPACITY) | ((kind == "prospectus_supplement") & F.col("shares_offered").isNull() & F.col("price_per_share").isNull())).alias("capacity_only"), "going_concern", (F.col("going_concern") | F.col("_warned")).alias("liquidity_stress"),
    )
