import random
import re
import time
from collections import Counter, defaultdict

from afterbell.llm import divergence
from afterbell.llm.divergence import source_divergence


def plain(rows, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= 3]
        counts, total = defaultdict(Counter), Counter()
        for _, s, terms in own:
            counts[s].update(t for t in terms if df[t] >= 3)
            total.update(t for t in terms if df[t] >= 3)

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(p, q):
            return (p - q) * (p - q) // q

        shares = {s: {t: p(c, t) for t in kept} for s, c in [(s, counts[s]) for s in {d[1] for d in own}]}
        whole = {t: p(total, t) for t in kept}
        for s in shares:
            pair = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in shares if o != s]
            term = [(t, f(shares[s][t], whole[t])) for t in kept if counts[s][t] and shares[s][t] > whole[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def made_rows(r, n):
    vocabulary = ["the", "The", "THE", "ab", "abc", "b", "naïve", "ÉCOLE", "école", "中文", "中", "x y", "zz"] + ["".join(r.choice("abcd") for _ in range(3)) for _ in range(150)]
    glue = [" ", "  ", ", ", "-", "\n", "9", "'", "\x7f", "[", "_"]
    rows = []
    for _ in range(n):
        k = r.randrange(len(vocabulary))
        rows.append((r.choice(("en", "en", "de", None, "x y")), r.choice(("s1", "s1", "s1", "s2", "s3", "š", None)), "".join(r.choice(vocabulary[k // 2 :]) + r.choice(glue) for _ in range(r.randint(0, 30)))))
    return rows


def test_divergence_matches_a_plain_version(spark, monkeypatch):
    r = random.Random(5)
    rows = made_rows(r, 500) + [("fr", "a", None), ("fr", "b", ""), ("fr", "b", "seul"), ("it", "one", "uno due tre"), ("it", "one", "uno due tre"), ("it", "one", "uno due tre")]
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], "lang string, source string, text string, n int, term string")
    want = plain(rows)
    assert sorted(map(tuple, source_divergence(df).collect())) == want
    assert {w[2] for w in want} == {"pair", "term"} and any(w[:3] == ("fr", "a", "pair") and w[4] == 0 for w in want)
    assert source_divergence(df.limit(0)).collect() == []
    assert sorted(map(tuple, source_divergence(df, ranks=2).collect())) == plain(rows, 2)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(divergence, "SLICE_POSTINGS", 40)
    monkeypatch.setattr(divergence, "ROUND_BYTES", 60)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = made_rows(random.Random(6), 250)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence(df).collect())) == plain(rows)


def test_one_long_text_takes_linear_time(spark):
    text = "many words, " * 2_000_000
    rows = [("en", "a", text), ("en", "b", "many words"), ("en", "b", "many others"), ("en", "b", "words")]
    began = time.time()
    out = source_divergence(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    assert sorted(map(tuple, out)) == plain(rows)
    assert time.time() - began < 90


def test_shares_are_exact_where_longs_end(spark):
    counts = [0, 1, 5, divergence.FITS - 1, divergence.FITS, divergence.FITS + 1, 9_223_372_036, 10**12]
    rows = [(n, total, terms) for n in counts for total in (n, n + 7, 3 * n + 1) for terms in (1, 3, 10**7)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = df.select("n", "total", "terms", divergence.share("n", "total", "terms").alias("p"), divergence.share("0", "total", "terms").alias("p0")).collect()
    assert len(got) == len(rows)
    for n, total, terms, p, p0 in got:
        assert p == 1 + 10**9 * (n + 1) // (total + terms) and p0 == 1 + 10**9 // (total + terms)


def test_occurrences_are_summed_before_they_are_sorted(spark):
    rows = spark.createDataFrame([("en", "a", "one two one"), ("en", "b", "two three"), ("de", "a", "one")], "lang string, source string, text string")
    kept = spark.createDataFrame([("en", "one"), ("en", "two"), ("de", "one")], "lang string, term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = divergence.recounted(rows, kept)
        assert sorted(map(tuple, counts.select("lang", "source", "term", "n", "lang_n").collect())) == [("de", "a", "one", 1, 1), ("en", "a", "one", 2, 2), ("en", "a", "two", 1, 2), ("en", "b", "two", 1, 2)]
        # sums, and kept terms: what tasks hand on isn't sorted
        assert counts._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
        assert counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
