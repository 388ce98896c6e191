import random

import time

from afterbell.llm.decontaminate import Matcher, best_match, best_matches, drop_contaminated, find_contamination, normalise


def naive(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_distance_is_exact():
    r = random.Random(1)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        want, budget = naive(p, t), r.randint(0, 60)
        got = best_match(p, t, budget)
        assert (got[0] if got else None) == (want if want <= budget else None)


def test_many_windows_at_once():
    r = random.Random(2)
    for _ in range(60):
        p = "".join(r.choice("abc") for _ in range(r.choice((1, 20, 63, 64, 65, 130, 200))))
        t = "".join(r.choice("abcd") for _ in range(r.randint(1, 500)))
        windows = sorted((a := r.randrange(len(t)), min(len(t), a + r.randint(1, 250))) for _ in range(r.randint(1, 9)))
        budget = r.randint(0, len(p))
        each = [(h[0], a + h[1]) for a, b in windows if (h := best_match(p, t[a:b], budget))]
        assert best_matches(p, windows, t, budget) == min(each, default=None)


def template(n):
    return f"question: what is the capital of country number {n} and why was it chosen by its people?"


def test_items_of_one_template_in_texts_that_share_their_opening():
    matcher = Matcher([(i, normalise(template(i * 7919))) for i in range(4_000)], 0.08)
    for size in (10_000, 1_000_000):
        began = time.time()
        assert matcher.match("question: what is the capital of " * (size // 33)) == []
        assert time.time() - began < 1.5
    began = time.time()
    text = "so it begins. " + template(7919 * 12) + " filler " * 2_000 + template(7919 * 40).replace("why", "whyy")
    found = {f[0]: f[1] for f in matcher.match(text)}
    assert found[12] == 0 and found[40] == 1
    near = [i for i in range(0, 4_000, 97)]
    for i in near:  # all numbers of up to eight digits are within seven edits
        assert (i in found) == (naive(normalise(template(i * 7919)), normalise(template(7919 * 12))) <= int(len(template(i * 7919)) * 0.08) or naive(normalise(template(i * 7919)), normalise(text)[-120:]) <= int(len(template(i * 7919)) * 0.08))
    assert time.time() - began < 60


def test_templated_items_match_brute_force():
    r = random.Random(6)
    items = [(i, normalise(f"the {r.choice('abcdef') * 3} of {r.randint(1, 10**9)} goes to the {r.choice(('north', 'south'))} in year {i}")) for i in range(40)]
    matcher = Matcher(items, 0.08)
    for _ in range(40):
        text = list(" ".join(r.choice(items)[1] if r.random() < 0.4 else "the aaa of goes to the year" for _ in range(4)))
        for _ in range(r.randint(0, 6)):
            text[r.randrange(len(text))] = r.choice(("", "q", "zz"))
        text = normalise("".join(text))
        want = {i: d for i, p in items if (d := naive(p, text)) <= int(len(p) * 0.08)}
        assert {f[0]: f[1] for f in matcher.match(text)} == want
        assert bool(matcher.match(text, first_only=True)) == bool(want)


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(9, 20))).capitalize()) for i in range(10)]
    docs = []
    for d in range(90):
        text = " ".join(word() for _ in range(r.randint(0, 60)))
        if d % 3 == 0:
            leak = list(r.choice(items)[1])
            for _ in range(r.randint(0, int(len(leak) * 0.12))):
                leak[r.randrange(len(leak))] = r.choice(["", "x", "qq"])
            cut = r.randint(0, len(text))
            text = text[:cut] + " \n".join(["", "".join(leak), ""]) + text[cut:]
        docs.append((d, text))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    want = {}
    for d, t in docs:
        for i, p in items:
            p = normalise(p)
            dist = naive(p, normalise(t))
            if dist <= int(len(p) * 0.08):
                want[d, i] = dist
    d = spark.createDataFrame([(x, t, 1, "c") for x, t in docs], "doc_id long, text string, distance int, _item string")
    b = spark.createDataFrame([(x, t, 0) for x, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.distance for r in find_contamination(d, b).collect()}
    assert got == want and len(want) > 8
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "Tiny  item"), (4, "a tiny item"), (5, "a tiny items"), (6, "Atiny item. TINY\nitem!"), (7, "xtiny item"), (None, "tiny item"), (3, "Tiny  item")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "tiny item"), (2, None), (3, ""), (4, "  ")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in find_contamination(d, b).collect()) == [(0, 1), (3, 1), (3, 1), (4, 1), (6, 1)]
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {1, 2, 5, 7}
    assert find_contamination(d.limit(0), b).count() == 0
    assert find_contamination(d, b.limit(0)).count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == 9
