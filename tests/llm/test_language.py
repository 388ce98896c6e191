import random
import zlib

from afterbell.llm.language import UNKNOWN, keep_known_languages, learn_languages, predict_languages, shares

SYLLABLES = {
    "en": "the and ing th er wh ould tion ly ight",
    "de": "der und sch ung keit ein ver ich zu ß ü",
    "fr": "le et eau que oi é è ment ai ç",
    "es": "el y ción ue ll ñ os ez rr í",
    "xx": "zq qk wx kx jj vv",
}


def corpus(n=400):
    r = random.Random(9)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        text = " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60)))
        rows.append((i, text.capitalize(), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = predict_languages(df, learn_languages(df)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in SYLLABLES
    held = [r for r in out if r.held_out]
    assert len(held) > 50
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = spark.createDataFrame([(i, t, "fr" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows], df.schema)
    a = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(df, learn_languages(df)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(wrong, learn_languages(wrong)).collect()}
    assert a == b


def test_odd_rows(spark):
    rows = corpus(120) + [(900, None, "en"), (901, "", "en"), (902, "12 34 ½ !!", "en"), (None, "the and ing", None), (903, "x" * 200_000, None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, score string")
    model = learn_languages(df)
    out = {r.doc_id: r for r in predict_languages(df, model).collect()}
    assert [out[k].lang_pred for k in (900, 901, 902)] == [UNKNOWN] * 3
    assert out[None].lang_pred == "en" and not out[None].held_out
    kept = keep_known_languages(df, model)
    assert kept.columns == df.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert set(got) == {r[0] for r in rows} - {900, 901, 902}
    assert got[None] == "en"
    empty = df.limit(0)
    assert predict_languages(empty, learn_languages(empty)).count() == 0
    assert {r.lang_pred for r in predict_languages(df, learn_languages(empty)).collect()} == {UNKNOWN}


def test_a_text_beyond_the_bound_does_not_unlearn_others(spark):
    rows = corpus(200)
    schema = "doc_id long, text string, lang string"
    ids = spark.range(1000, 1400).selectExpr("id", "xxhash64(id) h", "crc32(cast(cast(id as string) as binary)) % 4 = 2 held").where("not held").orderBy("h")
    first = ids.first().id  # learned from before most others
    df = spark.createDataFrame(rows, schema)
    more = spark.createDataFrame([*rows, (first, "the ing " * 20_000, "en")], schema)
    a, b = learn_languages(df, max_chars=100_000), learn_languages(more, max_chars=100_000)
    assert a.langs == b.langs == sorted(SYLLABLES)
    assert (a.weights == b.weights).all()
    assert learn_languages(df, max_chars=2_000).langs == sorted(SYLLABLES)


def test_shares():
    assert shares({"a": 5, "b": 90, "c": 30}, 200) == {"a": 5, "c": 30, "b": 90}
    assert shares({"a": 5, "b": 90, "c": 30}, 60) == {"a": 5, "c": 27, "b": 28}
    assert shares({}, 60) == {}
