from pyspark.sql import functions as F

from afterbell.operators.financing import financing_facts, financing_fields

TEXTS = {
    "offering": "XYZ announced a public offering of 10,000,000 shares of common stock at a public offering price of $2.50 per share. Gross proceeds are expected to be approximately $25.0 million before expenses.",
    "warrants": "XYZ Announces Redemption of Public Warrants. The public warrants are exercisable for shares of common stock at a price of $11.50 per share.",
    "fees": "Calculated pursuant to Rule 457(o) based on the proposed maximum aggregate offering price of $75,000,000.",
    "assumed": "Up to 504,859,164 shares, assuming the sale of $8,000,000 of shares at an assumed offering price of $7.77 per share.",
    "before": "On June 23, 2023, we issued 6,337,039 shares of Class A common stock and received gross proceeds of $25,000,000.",
    "option": "The underwriters of the offering to purchase up to an additional 1,500,000 shares of option stock.",
    "commission": "The sales agent in the at-the-market program gets up to 3.0% of the sale price.",
    "small": "A registered direct offering of 2 million shares at a purchase price of $3.00 per share for gross proceeds of $600.",
    "null": None,
    "empty": "",
}


def test_terms_without_background(spark):
    docs = spark.createDataFrame([(k, v, "2024-05-01") for k, v in TEXTS.items()], "doc_id string, text string, event_time string").withColumn("event_time", F.to_timestamp("event_time"))
    facts = financing_facts(docs)
    got = {}
    for r in facts.collect():
        got.setdefault(r.doc_id, {})[r.fact_name] = r.value
        assert " ".join(TEXTS[r.doc_id][r.start_char : r.end_char].split()) == r.evidence_text
    assert got == {
        "offering": {"shares_offered": 1e7, "price_per_share": 2.5, "gross_proceeds": 25e6},
        "small": {"shares_offered": 2e6, "price_per_share": 3.0, "gross_proceeds": 600.0},
    }
    fields = {r.doc_id: r for r in financing_fields(docs, facts).collect()}
    assert len(fields) == len(TEXTS) and fields["small"].amount == 6e6 and fields["small"].amount_source == "shares_offered_x_price_per_share"
    assert fields["offering"].amount_source == "gross_proceeds" and fields["offering"].completed and fields["null"].event_type == "unknown" and fields["null"].amount is None
    earlier = docs.where("doc_id = 'before'").withColumn("event_time", F.lit("2023-06-24").cast("timestamp"))
    assert {r.fact_name: r.value for r in financing_facts(earlier).collect()} == {"gross_proceeds": 25e6, "shares_offered": 6337039.0}
