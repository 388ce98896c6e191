import random
from itertools import combinations

from afterbell.llm import jaccard
from afterbell.llm.simhash import keep_one_of_each


def similar(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) >= 0.8


def corpus():
    """Texts of 1 to 400 words, each with copies: words appended, cut off, changed."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(2500)]
    texts = []
    for n in [*range(1, 30), *r.sample(range(30, 400), 40)]:
        base = [r.choice(words) for _ in range(n)]
        texts += [base, base + ["more"], base[: max(1, round(n * 0.85))], base[: max(1, round(n * 0.78))], base + [r.choice(words) for _ in range(round(n * 0.15))]]
        for changes in (1, 2, max(1, n // 50)):
            copy = list(base)
            for _ in range(changes):
                copy[r.randrange(n)] = r.choice(words)
            texts.append(copy)
    common = [r.choice(words) for _ in range(80)]  # one large group, and a line that many share
    for _ in range(90):
        copy = list(common)
        copy[r.randrange(80)] = r.choice(words)
        texts += [copy, common[:12] + [r.choice(words) for _ in range(r.randint(2, 30))]]
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    return texts


def brute(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if similar(texts[i], texts[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i for i in range(len(texts)) if root(i) == i}


def test_kept_rows_are_those_of_brute_force(spark, monkeypatch):
    texts = corpus()
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one_of_each(df).collect()} == want
    monkeypatch.setattr(jaccard, "SHIFT_GROUP", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    monkeypatch.setattr(jaccard, "PARTNERS", 3)
    assert {r.doc_id for r in keep_one_of_each(df).collect()} == want
