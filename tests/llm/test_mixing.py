import numpy as np
import pytest

from afterbell.llm.mixing import calibrate, mix_documents, rake, sample_mixture, tempered


def test_rake_meets_marginals():
    r = np.random.default_rng(1)
    tokens = r.random(60) + 0.01
    groups = [np.arange(60) % 4, np.arange(60) // 20, (np.arange(60) * 7) % 5]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.full(5, 0.2)]
    weights = rake(tokens, groups, targets) * tokens
    weights /= weights.sum()
    for g, t in zip(groups, targets, strict=True):
        assert np.allclose(np.bincount(g, weights), t, atol=1e-6)


def rows():
    out = []
    for i in range(3000):
        source = "hot" if i % 3 else f"s{i % 5}"
        text = ("word " * (i % 40 + 1)) + ("a | b" if i % 7 == 0 else "")
        out.append((i, text, ["en", "de", None][i % 3 if source != "hot" else 0], source))
    return out


def test_sampled_shares_follow_targets(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    targets = {"source": {"hot": 0.25, **{f"s{k}": 0.15 for k in range(5)}}}
    out = mix_documents(df, targets=targets).collect()
    assert len(out) == 3000 and max(r.probability for r in out) == pytest.approx(1)
    expected = {}
    for r in out:
        expected[r.source] = expected.get(r.source, 0) + r.n_tokens * r.probability
    whole = sum(expected.values())
    for source, share in targets["source"].items():
        assert expected[source] / whole == pytest.approx(share, abs=1e-3)
    taken = sum(r.n_tokens for r in out if r.selected)
    assert taken == pytest.approx(whole, rel=0.1)
    kept = sample_mixture(df, targets=targets)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.selected}


def test_tempered():
    assert tempered({"a": 4.0, "b": 1.0, "c": 0.0}, 0.5) == pytest.approx({"a": 2 / 3, "b": 1 / 3})


def test_odd_rows(spark):
    odd = [(1, None, None, None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a")]
    df = spark.createDataFrame([(*r, 0.5) for r in odd], "doc_id long, text string, lang string, source string, probability double")
    out = mix_documents(df).collect()
    assert len(out) == 5
    assert [r.selected for r in out if r.n_tokens == 0] == [True, True]
    assert len({r.selected for r in out if r.doc_id == 3}) == 1
    assert sample_mixture(df).count() == sum(r.selected for r in out)
    assert mix_documents(df.limit(0)).count() == 0
    assert sample_mixture(df.limit(0)).count() == 0


def test_calibrated_share():
    tokens, factor = np.array([100.0, 50, 10, 0]), np.array([0.5, 1.0, 6.0, 1.0])
    assert calibrate(tokens, factor, None).tolist() == pytest.approx([0.5 / 6, 1 / 6, 1, 1])
    p = calibrate(tokens, factor, 0.6)
    assert (tokens * p).sum() == pytest.approx(0.6 * 160)
    assert p[2] == 1 and p[1] / p[0] == pytest.approx(2)
    assert calibrate(tokens, factor, 1.0).tolist() == pytest.approx([1, 1, 1, 1])


def test_share_of_documents(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    out = mix_documents(df, share=0.8).collect()
    assert sum(r.n_tokens * r.probability for r in out) == pytest.approx(0.8 * sum(r.n_tokens for r in out))
    assert sample_mixture(df, share=0.8).count() == sum(r.selected for r in out)


def test_cells_as_a_table_give_the_same(spark):
    df = spark.createDataFrame(rows() + [(5000, "", "xx", "none"), (5001, None, None, None)], "doc_id long, text string, lang string, source string")
    targets = {"source": {"hot": 0.25, **{f"s{k}": 0.15 for k in range(5)}}}
    for share in (None, 0.7):
        once, table = ({r.doc_id: r for r in mix_documents(df, targets=targets, share=share, max_cells=n).collect()} for n in (1000, 3))
        assert once.keys() == table.keys() and len({(r.source, r.lang, r.topic) for r in once.values()}) > 3
        for i, r in once.items():
            assert table[i].factor == pytest.approx(r.factor, abs=1e-6) and table[i].probability == pytest.approx(r.probability, abs=1e-6)


def test_topics(spark):
    texts = ["All rights reserved, licensed with no warranty", "write to a@b.org or +1 555 123 4567", "the password is a secret token", "a | b | c", "### !! what", "nothing of the kind", "", None, "one license " + "word " * 300]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert [r.topic for r in sorted(mix_documents(df).collect(), key=lambda r: r.doc_id)] == ["legal", "contact", "credentials", "table", "noise", "prose", "prose", "prose", "prose"]
