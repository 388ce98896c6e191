import random

import numpy as np
import pytest
import xxhash

from afterbell.llm import simhash
from afterbell.llm.simhash import fingerprint, fit_plan, keep_one_of_each, links, near_duplicates, sketch
from pyspark.sql import functions as F


def naive_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps, limit=3):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def texts():
    r = random.Random(5)
    vocabulary = ["ab", "cd", "éa", "Foo", "bar,", "x", "the", "of"] + [f"w{i}" for i in range(50)]
    out = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                if copy:
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append("\t".join(copy))
    return out + ["", "  \n", "one", "one two", "ONE TWO", "one two three"] + ["same copy of a text"] * 40


def test_fingerprint_matches_definition():
    for t in texts():
        assert fingerprint(t.encode(), 3) == naive_fingerprint(t)


def test_components_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    rows.sort()
    df = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string").withColumn("_fp", F.lit("clash"))
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    fps = [naive_fingerprint(t) for _, t in rows] + [0]
    ids = [i for i, _ in rows] + [1000]
    want = naive_components(fps)
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{fps[k]:016x}"
        assert got[i].component_id == ids[want[k]]


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 40])
def test_links_in_dense_and_skewed_fingerprints(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    centre = r.getrandbits(64)
    while len(fps) < 1200:  # a dense ball, and values that share 40 bits
        x = centre
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        fps |= {x, (centre & ~0xFFFFFF) | r.getrandbits(24)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, int(np.array([f], np.uint64).view(np.int64)[0])) for i, f in enumerate(fps)], "_node long, _fp long")
    for limit in (0, 1, 3, 5):
        edges = links(nodes, ["_fp"], [limit]).collect()
        parent = list(range(len(fps)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            assert bin(fps[e.u] ^ fps[e.v]).count("1") <= limit or limit > 0
            a, b = sorted((root(e.u), root(e.v)))
            parent[b] = a
        assert [root(i) for i in range(len(fps))] == naive_components(fps, limit)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_hot_values_are_cut_into_chunks_for_every_number_of_partitions(spark, monkeypatch, m):
    r = np.random.default_rng(5)
    fps = np.unique(np.concatenate([r.integers(0, 2**62, 300), (7 << 40) | r.integers(0, 2**20, 1500)])).astype(np.uint64)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    monkeypatch.setattr(simhash, "fit_plan", lambda sample, total, distance: simhash.Plan(simhash._group_bits(sample, m), distance, (), float(total)))
    nodes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.tolist())], "_node long, _fp long")
    plan = spark.sparkContext.broadcast(simhash.fit_plan(fps, len(fps), 3))
    values, chunks = simhash.hot_values(nodes, "_fp", plan, len(fps))
    assert len(values) and chunks.max() > 5 and (values[1:] > values[:-1]).all()
    edges = simhash.links(nodes, ["_fp"], [3]).collect()
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in edges:
        a, b = sorted((root(e.u), root(e.v)))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == naive_components([int(f) for f in fps], 3)


def test_plan_for_many_rows_uses_fewer_wider_partitions():
    sample = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    assert len(fit_plan(sample, 1000, 3).parts) == 4
    assert len(fit_plan(sample, 50_000_000_000, 3).parts) == 2
    plan = fit_plan(sample, 1000, 3)
    thresholds = plan.allocate(plan.values(sample))
    assert ((thresholds + 1).sum(axis=0) == 4).all()


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "q r s t")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, -1), (7, 7)]


def test_one_of_each_group_stays(spark):
    r = random.Random(8)
    rows = []
    for g in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        for c in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(min(c, 2)):
                copy[r.randrange(200)] = "other"
            rows.append((len(rows) + 1000 * g, " ".join(copy), g))
    rows += [(5, rows[0][1], 0), (5, rows[0][1], 0), (None, rows[1][1], 0), (None, "alone with no id", 99), (None, "alone with no id", 99)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, g int, component_id string")
    out = keep_one_of_each(df)
    assert out.columns == df.columns
    kept = [(x.g, x.doc_id) for x in out.collect()]
    want = {g: min((i for i, _, h in rows if h == g and i is not None), default=None) for _, _, g in rows}
    assert sorted(kept, key=str) == sorted(want.items(), key=str)
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    r = random.Random(6)
    misses = []
    for share in (1.0, 0.9, 0.8, 0.6, 0.0):
        off = []
        for _ in range(60):
            n = r.randint(150, 900)
            # words that stand alone: one-word shingles, so that the similarity is known
            common = [f"c{r.getrandbits(60)}" for _ in range(round(n * 2 * share / (1 + share)))]
            rest = n - len(common)
            a, b = (common + [f"{x}{r.getrandbits(60)}" for _ in range(rest)] for x in "ab")
            x, y = (np.frombuffer(sketch(" ".join(t).encode(), 1), np.uint64) for t in (a, b))
            off.append(int(np.bitwise_count(x ^ y).sum()))
        misses.append((share, np.mean(off)))
    for share, mean in misses:
        assert abs(mean - 128 * (1 - share)) < 6
    assert sketch(b"", 5) == sketch(b" ", 5) == bytes(32)
