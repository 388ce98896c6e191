import hashlib
import random
import re
import zlib

import corpus_pipeline


def write_tables(spark, folder):
    r = random.Random(3)
    languages = {"en": "the and ing th er wh tion ly".split(), "de": "der und sch ung keit ein ver".split(), "fr": "le et eau que oi ment é".split()}
    item = " ".join(f"item{r.randrange(999)}" for _ in range(25))
    docs = []
    for i in range(240):
        lang = r.choice(list(languages))
        text = " ".join("".join(r.choice(languages[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(60, 120)))
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
    docs += [(300, "1234 !!", "en", "s1", 7), (301, None, None, None, None), (302, docs[7][1], "en", "s0", 0), (303, docs[8][1] + " extra", "en", "s0", 0)]
    docs += [(304, "some the and thing " + item + " and more the end", "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_one_by_one(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.read.parquet(folder + "/documents.parquet") if write_tables(spark, folder) is None else spark.read.parquet(folder + "/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    columns = docs.columns
    gone = {"language id": {300, 301}, "near duplicates": {302, 303}, "decontamination": {304}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name in gone:
            assert ids - now == gone[name]
        else:
            assert 0.2 * len(ids) < len(now) < len(ids)
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == ids and len(last) == len(ids)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def brute_force(docs, item):
    """The rows of the whole pipeline over the fixture, from the definitions of its stages."""
    kept = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, gone = {d[0]: shingles(d[1]) for d in kept}, set()
    for d in kept:  # in ascending order of ids, and no chains in the fixture
        for e in kept:
            if e[0] < d[0] and e[0] not in gone and len(sets[d[0]] & sets[e[0]]) >= 0.8 * len(sets[d[0]] | sets[e[0]]):
                gone.add(d[0])
    kept = [d for d in kept if d[0] not in gone and item not in d[1]]
    tokens = {d[0]: len(d[1].split()) for d in kept}
    cells = {}
    for d in kept:
        cells[d[3], d[2]] = cells.get((d[3], d[2]), 0) + tokens[d[0]]
    whole, weight = sum(cells.values()), {c: n / sum(cells.values()) for c, n in cells.items()}
    target = []
    for k in (0, 1):
        sums = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        target.append({v: n**0.7 / sum(m**0.7 for m in sums.values()) for v, n in sums.items()})
    for step in range(2000):
        k = step % 2
        now = {v: sum(w for c, w in weight.items() if c[k] == v) for v in target[k]}
        weight = {c: w * target[k][c[k]] / now[c[k]] for c, w in weight.items()}
    factor = {c: weight[c] / (cells[c] / whole) for c in cells}
    low, high = 0.0, 1 / min(factor.values())
    for _ in range(200):
        scale = (low + high) / 2
        enough = sum(n * min(1, scale * factor[c]) for c, n in cells.items()) >= 0.8 * whole
        low, high = (low, scale) if enough else (scale, high)
    chance = lambda d: int(hashlib.md5(f"{d[0]}:7:{d[1]}".encode()).hexdigest()[:13], 16) / 2**52
    kept = [d for d in kept if chance(d) < min(1, scale * factor[d[3], d[2]])]
    total, upto, out = sum(len(d[1].encode()) + 1 for d in kept), 0, []
    slots = {}
    for d in sorted(kept):
        size = len(d[1].encode()) + 1
        upto += size
        shard = min(7, ((2 * (upto - size) + size) * 8) // (2 * total))
        out.append((d[0], size, zlib.crc32(d[1].encode()), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return out


def test_whole_pipeline_against_a_plain_version(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = write_tables(spark, folder)
    item = spark.read.parquet(folder + "/benchmark.parquet").first().text
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == brute_force(docs, item)
