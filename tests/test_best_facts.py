from afterbell.operators import facts as X


def test_a_row_carries_its_value_and_evidence_once(spark):
    rows = [(1, "a", 5, 0.9, "long text"), (1, "a", 7, 0.9, "text"), (1, "a", None, 0.9, "text"), (1, "b", None, 0.5, None), (1, "b", None, 0.4, "x"), (2, "a", 10, 0.8, ""), (2, "a", 9, 0.8, None)]
    df = spark.createDataFrame(rows, "event_id long, fact_name string, value long, confidence double, evidence_text string")
    out = X.best_facts(df)
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["event_id", "fact_name", "value", "confidence", "evidence_text", "candidates"] and [t for _, t in out.dtypes[2:5]] == ["bigint", "double", "string"]
    got = {(r.event_id, r.fact_name): tuple(r)[2:] for r in out.collect()}
    assert got == {(1, "a"): (7, 0.9, "text", 3), (1, "b"): (None, 0.5, None, 2), (2, "a"): (9, 0.8, None, 2)}
