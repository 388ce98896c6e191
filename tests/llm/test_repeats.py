import random
from collections import Counter

import numpy as np
import pytest

from afterbell.llm import repeats as R


def brute(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), kept))
    return out


def test_classes_of_windows():
    r = np.random.default_rng(1)
    for n, high, length in ((1, 2, 3), (50, 2, 4), (300, 3, 8), (400, 30, 2), (500, 2, 16), (257, 1, 5), (300, 2000, 3)):
        symbols = r.integers(0, high, n)
        padded = np.concatenate((symbols, np.full(length, -1)))
        classes = R.window_classes(symbols, length)
        want = [tuple(padded[i : i + length]) for i in range(n - length + 1)]
        for i in range(0, len(want), 3):
            for j in range(i):
                assert (want[i] == want[j]) == (classes[i] == classes[j])


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    make = lambda n: " ".join(word() for _ in range(n))
    passages = [make(r.randint(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(70):
        text = make(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            cut, p = r.randint(0, len(text)), r.choice(passages)
            a = r.randint(0, 40)
            text = text[:cut] + p[a : len(p) - r.randint(0, 60)] + text[cut:]
        texts.append(text)
    for t in texts[:15]:  # near copies
        words = t.split(" ")
        for _ in range(r.randint(1, 4)):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    period = make(30)
    texts += texts[20:24] + ["a" * 199, "b" * 200, "c" * 201, "d" * 500, "ab" * 300, period * 5, None, "", passages[0]] + [passages[1] * 2]
    texts += ["x" + "q" * 230 + str(i) for i in range(4)] + [make(3) + passages[2][:205] + make(3) for _ in range(120)]
    return texts


def check(spark, texts, length=200):
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, kept binary").repartition(5)
    got = {r.doc_id: r for r in R.remove_repeats(df, length).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_matches_brute_force(spark):
    check(spark, corpus(1))


def test_matches_brute_force_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 3000)
    monkeypatch.setattr(R, "TEXT", 2000)
    check(spark, corpus(2))
    check(spark, corpus(3), 97)


def test_hot_anchors_are_counted_to_the_same_end(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 5)
    check(spark, corpus(4))


def test_odd_tables(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = R.remove_repeats(spark.createDataFrame([(None, "k" * 150), (None, "k" * 150), (1, "z" * 210 + "y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 0), (1, 210)]


def test_repeats_far_into_a_long_text(spark):
    r = np.random.default_rng(5)
    make = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    far, border, inside = make(400), make(500), make(300)
    long = make(R.SLICE - 250) + border + make(16_900_000) + inside + far + make(50_000)
    assert long.index(far) > 2**24
    texts = [long, make(30) + far, border + make(40), inside + make(9)]
    out = {x.doc_id: [tuple(s) for s in x.spans] for x in R.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at, cut = long.index(far), long.index(border)
    assert out[0] == [(cut, cut + 500), (at - 300, at + 400)]
    assert (out[1], out[2], out[3]) == ([(30, 430)], [(0, 500)], [(0, 300)])


def test_a_slice_that_places_cannot_count_is_an_error():
    with pytest.raises(ValueError, match="more than places can count"):
        R.anchored_contexts([bytes(2**24 + 1)], [bytes(12)], [1], 200, 64)
    data = bytes(range(250)) * 5
    parts = list(R.pieces(data, 200, 300))
    assert [a for a, _ in parts] == list(range(0, 1051, 101)) and all(p == data[a : a + 300] for a, p in parts)
    assert list(R.pieces(b"abc", 200, 300)) == [(0, b"abc")]
