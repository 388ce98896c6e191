import random

from afterbell.llm import graph


def naive(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_a_group_whose_pairs_are_all_linked_joins_as_few_edges_as_nodes(spark, monkeypatch):
    sizes, own = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda edges, large: sizes.append(edges.count()) or own(edges, large))
    pairs = [(a, b) for a in range(120) for b in range(a)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(8)
    assert {r.node: r.component for r in graph.components(edges).collect()} == {i: 0 for i in range(120)}
    assert max(sizes) < 120


def test_components_of_edges_in_many_tasks(spark, monkeypatch):
    draw = random.Random(1)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    monkeypatch.setattr(graph, "EDGES", 20)
    df = spark.createDataFrame(edges, "u long, v long").repartition(16)
    want = naive([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in graph.components(df).collect()} == want
