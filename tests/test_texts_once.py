import datetime as dt

from afterbell.operators import financing as FI
from afterbell.operators import sections as S
from afterbell.plans import base


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_worked_out_once_for_a_segment(spark):
    docs = spark.createDataFrame([(1, "It priced an offering.\nGross proceeds were $25.0 million in all.", dt.datetime(2024, 1, 10))], "doc_id long, text string, event_time timestamp")
    facts = FI.financing_facts(docs)
    for df in (facts, S.trial_facts(docs.select("doc_id", "text")), S.sectioned(docs.select("doc_id", "text"))):
        assert "Generate explode(" in plan(df) and "size(array_compact" not in plan(df) and "size(CASE" not in plan(df)
    assert [(r.fact_name, r.value) for r in facts.collect()] == [("gross_proceeds", 25e6)]


def test_rows_of_a_small_file_are_spread(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df = base.spread(base.table(spark, str(tmp_path), "t"))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 50
    many = spark.range(0, 50, 1, 9)
    assert base.spread(many) is many
