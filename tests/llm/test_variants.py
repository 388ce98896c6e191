import random
import re
import time
import zlib
from collections import Counter

from afterbell.llm.variants import group_variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    a, b = sorted((a, b), key=len)
    return a[k:] == b[k + 1 :]


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def test_variants_match_a_plain_version(spark):
    r = random.Random(3)
    stems = ["banana", "bananas", "ananab", "aaaaaaa", "aaaaaab", "Straße", "straßen", "élèves", "éleves", "letter", "lettre", "brown", "browns", "÷×÷×÷×", "abcdef"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(stems[: 3 + i % 12])
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abeé") + w[k:], w[:k] + r.choice("abeé") + w[k + 1 :], w.upper()))
            words.append(w)
        rows.append((i - 7, r.choice((" ", "-", "3", "中", "_")).join(words)))
    rows += [(None, "banana bananab"), (5, None), (6, ""), (7, "banana " * 50), (7, "banana " * 50), (3, "1 2 3")]
    rows += [(1000 + i, "marble " * 25 + "marbles " * 4 + "marbless" * (i < 6)) for i in range(10)]
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int")
    out = sorted((tuple(o) for o in group_variants(df).collect()), key=lambda o: o[0])
    want = plain(rows)
    assert [o[0] for o in out] == [w[0] for w in want]
    assert out == want
    assert any(o[1] and o[2] != o[1] for o in out) and any(o[1] is None and o[4] > 3 for o in out)
    assert group_variants(df.limit(0)).collect() == []


def test_letters_of_many_anagrams_meet_only_where_their_order_agrees(spark):
    r = random.Random(8)
    words = sorted({"".join(r.choice("abc") for _ in range(9)) for _ in range(900)})
    rows = [(k, " ".join(words)) for k in range(5)]
    out = {o.word: o for o in group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {w[0]: w for w in plain(rows)}
    assert {w: (o.n, o.n_near, o.form) for w, o in out.items()} == {w: (x[3], x[4], x[1]) for w, x in want.items()}


def test_a_word_of_a_million_letters_takes_linear_time(spark):
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh") for _ in range(1_000_000))
    rows = [(i, base) for i in range(25)] + [(100 + i, base[:500_000] + "z" + base[500_000:]) for i in range(5)] + [(200, "so " * 2_000_000 + "plain")]
    began = time.time()
    out = {len(o.word): o for o in group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1_000_001].n_near == 1 and len(out[1_000_001].form or base) == 1_000_000 and out[1_000_000].n_near >= 1
    assert time.time() - began < 120
