import json

from pyspark.sql import functions as F

from afterbell.sources import readers


def test_feeds_of_all_kinds(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a/one.jsonl").write_text('{"slug": "x", "title": "One", "official_source": true, "tags": ["p", "q"], "sample_size_hint": 5}\n\nnot json\n[1]\n{"slug": "y", "tags": "single", "sample_size_hint": "many"}\n')
    (tmp_path / "a/b/two.json").write_text(json.dumps([{"slug": "z"}, {"slug": "w", "title": {"a": 1}}]))
    (tmp_path / "a/b/three.toml").write_text('[[observations]]\nslug = "t"\nevidence = ["e1"]\nofficial_source = false\n[[observations]]\nslug = "u"\n')
    (tmp_path / "a/four.json").write_text('{"slug": "alone"}')
    (tmp_path / "a/bad.toml").write_text("= =")
    (tmp_path / "a/other.txt").write_text('{"slug": "no"}')
    df = spark.read.format("observations").load(str(tmp_path))
    rows = {(r.slug or r._corrupt_record): r for r in df.collect()}
    assert set(rows) == {"x", "y", "z", "w", "t", "u", "alone", "not json", "[1]", "= ="}
    assert rows["x"].tags == ["p", "q"] and rows["x"].official_source is True and rows["y"].tags == ["single"] and rows["y"].sample_size_hint is None
    assert rows["t"].evidence == ["e1"] and rows["w"].title == '{"a": 1}' and rows["x"].source_file.endswith("a/one.jsonl")
    assert df.rdd.getNumPartitions() == 5
    asked = df.where((F.col("slug") == "x") | (F.col("slug") == "x")).select("slug")
    assert [r.slug for r in asked.collect()] == ["x"]
    one = df.where(F.col("source_file") == rows["z"].source_file)
    assert {r.slug for r in one.collect()} == {"z", "w"} and one.rdd.getNumPartitions() == 1
    assert {r.slug for r in df.where(F.col("slug").isin("t", "z") & F.col("slug").isNotNull() & (F.length("slug") == 1)).collect()} == {"t", "z"}


def test_pipe_tables(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "r.md").write_text("# T\n\n| Domain | Status | Next step |\n|:--|---|--:|\n| a\\|b | open | go |\n| c | | \n\ntext | no\n\n| x | y |\n|-|-|\n| 1 | 2 |\n")
    rows = spark.read.format("pipe_tables").option("columns", "domain, next_step").load(str(tmp_path / "r.md")).collect()
    assert [(r.domain, r.next_step) for r in rows] == [("a|b", "go"), ("c", ""), ("1", "2")]


def test_manifests_with_texts_beside_them(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.txt").write_text("Text of\nthe file")
    (tmp_path / "m.csv").write_text('source_doc_id,ticker,path,text,more\nd1,AA,docs/one.txt,,1\nd2,BB,docs/none.txt,"own ""text"",\nhere",2\nd3,AA,docs/none.txt,,3\n')
    df = spark.read.format("source_documents").load(str(tmp_path / "m.csv"))
    assert {r.source_doc_id: r.text for r in df.collect()} == {"d1": "Text of\nthe file", "d2": 'own "text",\nhere', "d3": None}
    assert [r.source_doc_id for r in df.where("ticker = 'BB'").collect()] == ["d2"]
