import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from afterbell.sources import documents, events, prices, registries, sinks
from afterbell.streaming import events as streams


def test_events_scan(spark, tmp_path):
    good = "event_id,ticker,event_time,event_type,summary,materiality,extra\n1, abc ,2024-01-02 08:00:00,Earnings,s,1.7,x\n2,DEF,2024-01-03,Other,s,,y\n"
    (tmp_path / "e.csv").write_text(good)
    rows = {r.event_id: r for r in events.read_events(spark, str(tmp_path / "e.csv")).collect()}
    assert rows["1"].ticker == "ABC" and rows["1"].event_type == "earnings" and rows["1"].materiality == 1.0 and rows["2"].materiality == 0.5 and rows["2"].extra == "y" and rows["2"].release_session == "unknown"
    for bad, message in (("1,A,2024-01-01,t,s\n1,A,2024-01-01,t,s\n", "repeated"), ("1,A,soon,t,s\n", "can't be read")):
        (tmp_path / "b.csv").write_text("event_id,ticker,event_time,event_type,summary\n" + bad)
        with pytest.raises(ValueError, match=message):
            events.read_events(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="lack"):
        events.load_events(spark.createDataFrame([("1",)], "event_id string"))
    with pytest.raises(ValueError, match="release_session"):
        events.load_events(spark.createDataFrame([("1", "A", "2024-01-01", "t", "s", "noon")], "event_id string, ticker string, event_time string, event_type string, summary string, release_session string"))


def test_prices(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("Date,Close,Adj Close,Volume\n2024-01-02,10,9,5\n2024-01-02,11,8,5\n2024-01-03,12,,7\nbad,1,1,1\n")
    rows = prices.read_bars(spark, str(tmp_path / "ABC.csv")).orderBy("d").collect()
    assert [(r.ticker, r.d, r.price) for r in rows] == [("ABC", date(2024, 1, 2), 9.0), ("ABC", date(2024, 1, 3), 12.0)]
    assert prices.first_existing(spark, [str(tmp_path / "no.csv"), str(tmp_path / "ABC.csv")]).endswith("ABC.csv")


def test_documents(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("Item 1.05 and item 8.01, Item 1.05 again")
    (tmp_path / "m.csv").write_text("source_doc_id,ticker,event_id,event_time,event_type,event_subtype,release_session,source_type,source_url,title,path,text,fiscal_period_end,sector_benchmark,notes\nd1,,,,,,,,,,a.txt,,,,\nd2,,,,,,,,,,, own text ,,,\n")
    rows = {r.source_doc_id: r for r in documents.read_manifest(spark, str(tmp_path / "m.csv"), str(tmp_path / "docs")).withColumn("items", documents.filing_items(F.col("text"))).collect()}
    assert rows["d1"].items == ["1.05", "8.01"] and rows["d2"].text.strip() == "own text"
    out = {r.doc_id: r for r in documents.ingest(spark.createDataFrame([(1, " a  b "), (2, None), (3, "a b")], "doc_id int, text string"), 2).collect()}
    assert out[1].copies == 2 and out[2].skip_reason == "empty" and out[1].skip_reason == ""


def test_registries(spark, tmp_path):
    (tmp_path / "r.md").write_text("# Title\n\n| domain | status |\n|---|:--:|\n| x | frozen |\n| y |\n")
    assert [tuple(r) for r in registries.read_pipe_table(spark, str(tmp_path / "r.md"), ["domain", "status"]).collect()] == [("x", "frozen"), ("y", "")]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/o.jsonl").write_text('{"slug": "a", "title": "t", "tags": ["q"]}\nnot json\n')
    rows = registries.read_observations(spark, str(tmp_path / "feed")).collect()
    assert len(rows) == 2 and {r.slug for r in rows} == {"a", None}
    facts = {"facts": {"dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2024-01-31", "val": 5, "filed": "2024-02-10", "form": "10-K", "accn": "1"}, {"end": "2024-01-31", "val": 0, "filed": "2024-02-10"}]}}}}}
    got = registries.shares_outstanding(spark.createDataFrame([("A", json.dumps(facts)), ("B", "{}")], "ticker string, json string")).collect()
    assert [(r.ticker, r.filed_at, r.shares_outstanding) for r in got] == [("A", date(2024, 2, 10), 5.0)]
    assert registries.key_values(F.lit("a=1")) is not None
    assert spark.range(1).select(registries.key_values(F.lit("a = 1; b=2"))).first()[0] == {"a": "1", "b": "2"}


def test_ownership_xml(spark):
    xml = """<?xml version="1.0"?><ownershipDocument xmlns="urn:x"><issuer><issuerTradingSymbol> abc </issuerTradingSymbol></issuer>
    <reportingOwner><reportingOwnerId><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner>
    <nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-05</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
    got = registries.ownership_transactions(spark.createDataFrame([("d", xml), ("e", "plain")], "source_doc_id string, text string")).collect()
    assert [(r.ticker, r.owner, r.is_director, r.is_officer, r.code, r.value_usd, r.transaction_date) for r in got] == [("ABC", "Doe", True, False, "P", 250.0, date(2024, 1, 5))]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("d", "t", "x" * 50)], "source_doc_id string, title string, text string")
    sinks.write_packets(docs, str(tmp_path / "p"), ["eps"], 10)
    assert json.loads(spark.read.text(str(tmp_path / "p")).first()[0])["text"] == "x" * 10
    claims = spark.createDataFrame([("d", "f", "accepted", "ev"), ("d", "g", "needs_review", "no")], "source_doc_id string, field_name string, review_status string, evidence_text string")
    text = sinks.digest(claims, "Title")
    assert "**f**" in text and "**g**" not in text
    (tmp_path / "in.txt").write_text("abc")
    row = sinks.run_manifest(spark, "r", {"b": 1, "a": 2}, [str(tmp_path / "in.txt")]).first()
    assert row.sha256.startswith("ba7816bf") and row.config_sha256 == sinks.canonical_hash({"a": 2, "b": 1})


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 10, i % 50), i % 3, "a", 1.0, "{}") for i in range(60)]
    spark.createDataFrame(rows, streams.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"))
    out = streams.run_once(streams.windowed_counts(stream, "1 hour"), "hours", "complete", str(tmp_path / "c1"))
    assert [(r.n, r.total) for r in out.collect()] == [(60, 60.0)]
    for checkpoint in ("c2", "c3"):  # the same input twice adds nothing
        streams.append_new(stream, str(tmp_path / "target"), "event_id", str(tmp_path / checkpoint))
    assert spark.read.parquet(str(tmp_path / "target")).count() == 60
