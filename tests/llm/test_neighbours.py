import numpy as np

from afterbell.llm import neighbours as N


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows]
    out = set()
    for i, q in good:
        if i % 100 == 0:
            found = sorted((float(N.distances(q[None], v[None])[0, 0]), j) for j, v in good if j != i)[:k]
            out |= {(i, r, j, d) for r, (d, j) in enumerate(found, 1)}
    return out


def data(n=900):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 12))
    v = (centres[r.integers(0, 6, n)] + 0.3 * r.normal(size=(n, 12))).astype(np.float32)
    v[200:420] = v[100]  # one vector in very many rows
    return [(int(i), [float(x) for x in row]) for i, row in zip(r.permutation(n) * 5, v, strict=True)]


def test_exact_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 150)
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in N.nearest_neighbours(df).collect()}
    assert got == brute(rows)


def test_recall_with_relaxed_pruning(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, v) for q, _, v, _ in brute(rows)}
    got = {(r.query_id, r.vec_id) for r in N.nearest_neighbours(df, factor=1.5).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_tree_visits_less_on_easy_data():
    r = np.random.default_rng(5)
    points = r.normal(size=(4000, 2))
    seen = []
    tree = N.Tree(points)
    real = N.distances
    N.distances = lambda q, p: (seen.append(len(q) * len(p)), real(q, p))[1]
    try:
        tree.search(points[:20], np.full(20, -1), np.arange(4000), 5, 1.0)
    finally:
        N.distances = real
    assert sum(seen) < 20 * 4000 * 0.3


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None), (200, [float("nan"), 1.0]), (4, [1.0, None])]
    rows += [(5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, []), (0, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in N.nearest_neighbours(df).collect())
    assert [g for g in got if g[0] == 100] == [(100, 1, 0), (100, 2, 0), (100, 3, 1)]
    assert {g[0] for g in got} == {0, 100}
    assert N.nearest_neighbours(df.limit(0)).count() == 0
    assert N.nearest_neighbours(df.limit(1)).count() == 0
