"""Operator 7: SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import in_parts, materialize, partitions
from afterbell.llm.graph import components

BITS, SEED = 64, 42
SKETCH, SKETCH_COLUMNS = 256, ["_s0", "_s1", "_s2", "_s3"]
#: Cost of a shuffled row, in compared pairs.
ROW_COST = 400.0
#: Fingerprints of a value that one task compares; a value with more is compared chunk by chunk. Most such values that are told to all tasks.
CHUNK, MOST_HOT = 16_384, 1_000_000
#: Groups up to this size are compared by shifting, larger ones by blocks.
SHIFT_GROUP = 64
BLOCK = 512


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each ``words``-word shingle, repeats included, of an ASCII-lower-cased text; fewer words are one shingle, none give none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return np.frombuffer(digest(joined, SEED), ">u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8")


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the shingles, as an unsigned number; 0 without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes as :func:`shingle_hashes` gives them (most significant byte first)."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def sketch(text: bytes, words: int) -> bytes:
    """256 bits of the set of shingles: one bit of the least hash in each of 256 ranges; empty ranges borrow from the next.

    Sets of similarity s differ in about (1 - s) / 2 of the bits.
    """
    hashes = np.sort(shingle_hashes(text, words).astype(np.uint64))
    if not len(hashes):
        return bytes(SKETCH // 8)
    ranges = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
    filled, least = ranges[first], hashes[first]
    own = np.arange(SKETCH)
    source = np.searchsorted(filled, own) % len(filled)
    mixed = least[source] + ((filled[source] - own) % SKETCH).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).tobytes()


def add_fingerprints(docs: DataFrame, words: int, sketch_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """Ids, the SimHash of ``words``-word shingles (_fp), and with ``sketch_words`` the sketch of longer ones (_s0 to _s3), as signed numbers."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    names = SKETCH_COLUMNS if sketch_words else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]
            if names:
                columns += list(np.frombuffer(b"".join([sketch(t, sketch_words) for t in texts]), "<i8").reshape(-1, len(names)).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=["_id", "_fp", *names])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_id {id_type}, " + ", ".join(f"{c} long" for c in ["_fp", *names])
    )


@dataclass(frozen=True)
class Plan:
    """How fingerprints are cut: bit numbers of each partition, and estimated counts for the allocation."""

    parts: tuple[np.ndarray, ...]
    max_distance: int
    counts: tuple[np.ndarray, ...]  # by partition: [threshold + 1, value], for partitions of up to 16 bits
    total: float

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        """The partitions' values, each packed into its low bits."""
        out = []
        for bits in self.parts:
            v = np.zeros(len(fps), np.uint64)
            for j, b in enumerate(bits.tolist()):
                v |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
            out.append(v)
        return out

    def costs(self, values: list[np.ndarray]) -> np.ndarray:
        """[partition, threshold + 1, fingerprint]: estimated candidates plus rows to send; threshold -1 is free."""
        t = self.max_distance + 1
        out = np.zeros((len(self.parts), t + 1, len(values[0])))
        for i, (bits, v) in enumerate(zip(self.parts, values, strict=True)):
            w = len(bits)
            for d in range(t):
                ball = sum(math.comb(w, k) for k in range(min(d, w) + 1))
                near = self.counts[i][d][v.astype(np.int64)] if len(self.counts) else self.total * ball / 2.0**w
                out[i, d + 1] = near + ROW_COST * (ball - 1)
        return out

    def allocate(self, values: list[np.ndarray]) -> np.ndarray:
        """Thresholds [partition, fingerprint] of least cost whose (threshold + 1) sum to max_distance + 1, by dynamic programming."""
        cost = self.costs(values)
        m, levels, n = cost.shape
        best = np.full((levels, n), np.inf)
        best[0] = 0
        choice = np.zeros((m, levels, n), np.int8)
        for i in range(m):
            new = np.full((levels, n), np.inf)
            for total in range(levels):
                for own in range(total + 1):
                    c = best[total - own] + cost[i, own]
                    better = c < new[total]
                    new[total][better] = c[better]
                    choice[i, total][better] = own
            best = new
        left = np.full(n, levels - 1)
        out = np.zeros((m, n), np.int64)
        for i in reversed(range(m)):
            out[i] = choice[i, left, np.arange(n)]
            left = left - out[i]
        return out - 1


def _group_bits(sample: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """Partitions of near-equal width; each starts at a free bit and takes the free bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    scale[scale == 0] = 1
    corr = np.abs((centred.T @ centred) / np.outer(scale, scale))
    free, out = list(range(BITS)), []
    for i in range(m):
        width = BITS * (i + 1) // m - BITS * i // m
        part = [free.pop(0)]
        while len(part) < width:
            part.append(free.pop(int(np.argmax(corr[part][:, free].mean(axis=0)))))
        out.append(np.array(sorted(part)))
    return tuple(out)


def _near_counts(values: np.ndarray, width: int, levels: int, scale: float) -> np.ndarray:
    """[d, value]: estimated fingerprints within d bits of the value, by passing counts over each bit."""
    exact = np.zeros((levels, 1 << width))
    exact[0] = np.bincount(values.astype(np.int64), minlength=1 << width) * scale
    at = np.arange(1 << width)
    for b in range(width):
        for d in range(levels - 1, 0, -1):
            exact[d] += exact[d - 1][at ^ (1 << b)]
    return np.cumsum(exact, axis=0)


def fit_plan(sample: np.ndarray, total: int, max_distance: int) -> Plan:
    """The partitioning of least estimated cost for ``total`` fingerprints, fitted on a bounded sample of them."""
    best, least = None, math.inf
    for m in range(min(2, max_distance + 1), max_distance + 2):
        parts = _group_bits(sample, m)
        plan = Plan(parts, max_distance, (), float(total))
        if max(map(len, parts)) <= 16:
            scale = total / max(1, len(sample))
            counts = tuple(
                _near_counts(v, len(b), max_distance + 1, scale).astype(np.float32) for v, b in zip(plan.values(sample), parts, strict=True)
            )
            plan = Plan(parts, max_distance, counts, float(total))
        values = plan.values(sample[:2000])
        chosen, cost = plan.allocate(values), plan.costs(values)
        mean = ROW_COST * m + sum(np.take_along_axis(cost[i], chosen[i][None] + 1, 0).mean() for i in range(m))
        if mean < least:
            best, least = plan, mean
    return best


def _ball(width: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` of ``width`` bits, but for none."""
    masks, last = [], [(0, -1)]
    for _ in range(radius):
        last = [(m | (1 << b), b) for m, top in last for b in range(top + 1, width)]
        masks += [m for m, _ in last]
    return np.array(masks, np.uint64)


def _probes(plan: Plan, node: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, row number, role): role 0 is found only, 1 looks only, 2 both."""
    values = plan.values(fps)
    thresholds = plan.allocate(values)
    for i, bits in enumerate(plan.parts):
        base = np.uint64(i) << np.uint64(56)
        yield base | values[i], np.arange(len(fps)), np.where(thresholds[i] >= 0, 2, 0).astype(np.int8)
        for t in range(1, plan.max_distance + 1):
            rows = np.flatnonzero(thresholds[i] == t)
            if len(rows):
                masks = _ball(len(bits), t)
                keys = base | (values[i][rows][:, None] ^ masks[None, :])
                yield keys.ravel(), np.repeat(rows, len(masks)), np.ones(keys.size, np.int8)


def _near(a: list[np.ndarray], i, b: list[np.ndarray], j, limits: list[int]) -> np.ndarray:
    """Whether fingerprints differ in at most limits[0] bits, and the sketches, if any, in at most limits[1]."""
    ok = np.bitwise_count(a[0][i] ^ b[0][j]) <= limits[0]
    if len(a) > 1 and ok.any():
        ok &= sum(np.bitwise_count(x[i] ^ y[j]).astype(np.uint16) for x, y in zip(a[1:], b[1:], strict=True)) <= limits[1]
    return ok


def _forest(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few (row, column) pairs that connect what all pairs of ``ok`` connect."""
    if np.count_nonzero(ok) <= 2 * sum(ok.shape):
        return np.nonzero(ok)
    rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    ok = ok[np.ix_(rows, cols)]
    label = np.arange(len(rows), dtype=np.int32)
    most = np.int32(len(rows))
    while True:
        over = np.where(ok, label[:, None], most).min(axis=0)  # least row label of each column
        new = np.where(ok, over[None, :], most).min(axis=1)
        if (new == label).all():
            break
        label = new
    # rows of one label hang together: neighbours in label order share a column of the first, and
    # each column is tied to one of its rows
    order = np.argsort(label, kind="stable")
    chain = label[order][1:] == label[order][:-1]
    left, right = order[:-1][chain], order[1:][chain]
    shared = cols[ok.argmax(axis=1)[left]]
    return np.concatenate((rows[ok.argmax(axis=0)], rows[left], rows[right])), np.concatenate((cols, shared, shared))


def _link_large(node: np.ndarray, fps: list[np.ndarray], role: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group as a forest: blocks of pairs are compared once, each gives a forest, and these are merged."""
    n = len(node)
    looks, found = role >= 1, role != 1
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, BLOCK):
        rows = slice(a, a + BLOCK)
        for b in range(a, n, BLOCK):
            cols = slice(b, b + BLOCK)
            one, other = looks[rows].any() and found[cols].any(), found[rows].any() and looks[cols].any()
            if not (one or other):
                continue
            ok = _near([x[rows, None] for x in fps], slice(None), [x[None, cols] for x in fps], slice(None), limits)
            if not ok.any():
                continue
            if not (looks[rows].all() and found[cols].all()):
                ok &= (looks[rows, None] & found[None, cols]) | (found[rows, None] & looks[None, cols])
            i, j = _forest(ok)
            us.append(i + a)
            vs.append(j + b)
    u, v = np.concatenate(us), np.concatenate(vs)
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(n)
    return node[linked], node[label[linked]]


def _link(key: np.ndarray, node: np.ndarray, fps: list[np.ndarray], role: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal key; the rows are sorted by key."""
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)]))
    sizes = np.diff(bounds)
    us, vs = [], []
    small = np.repeat(sizes <= SHIFT_GROUP, sizes)
    for shift in range(1, min(SHIFT_GROUP, int(sizes.max(initial=1)))):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
        if not len(i):
            break
        ok = _near(fps, i, fps, i + shift, limits) & (((role[i] >= 1) & (role[i + shift] != 1)) | ((role[i] != 1) & (role[i + shift] >= 1)))
        us.append(node[i[ok]])
        vs.append(node[i[ok] + shift])
    for g in np.flatnonzero(sizes > SHIFT_GROUP):
        s = slice(bounds[g], bounds[g + 1])
        if (role[s] >= 1).any():
            u, v = _link_large(node[s], [x[s] for x in fps], role[s], limits)
            us.append(u)
            vs.append(v)
    empty = np.zeros(0, np.int64)
    u, v = np.concatenate([empty, *us]), np.concatenate([empty, *vs])
    differ = u != v
    return u[differ], v[differ]


def hot_values(nodes: DataFrame, column: str, plan: Broadcast, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (partition and value) that more fingerprints have than one task compares, in order, and into how many chunks each is cut.

    Counted over all fingerprints, whatever the number of partitions. A fingerprint has a value in each, so no more than
    their number times ``total`` by the chunk can be hot; beyond a million the chunk grows instead.
    """
    chunk = max(CHUNK, -(-len(plan.value.parts) * total // MOST_HOT))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = plan.value.values(batch.column(0).to_numpy().view(np.uint64))
            own = np.concatenate([v | np.uint64(i) << np.uint64(56) for i, v in enumerate(values)])
            key, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["_key", "_n"])

    counted = nodes.select(column).mapInArrow(keys, "_key long, _n long").groupBy("_key").agg(F.sum("_n").alias("_n"))
    hot = counted.where(F.col("_n") > chunk).toPandas()  # a million at most
    key = hot["_key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.minimum(-(-hot["_n"].to_numpy(np.int64)[order] // chunk), 4095)


def _cells(hot: tuple[np.ndarray, np.ndarray], key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys by pair of chunks, and the row of each: a row of a value in c chunks goes to the c pairs that its own chunk is in."""
    values, parts = hot
    if not len(values):
        return key, np.arange(len(key))
    at = np.minimum(np.searchsorted(values, key), len(values) - 1)
    chunks = np.where(values[at] == key, parts[at], 1)
    if (chunks == 1).all():
        return key, np.arange(len(key))
    rows = np.repeat(np.arange(len(key)), chunks)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    own, c = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks)[rows], chunks[rows]
    cell = np.where(c > 1, np.minimum(own, other) * c + np.maximum(own, other), 0)
    return key[rows] | cell.astype(np.uint64) << np.uint64(32), rows  # values have 32 bits at most


def links(nodes: DataFrame, columns: list[str], limits: list[int], sample_size: int = 20_000) -> DataFrame:
    """Edges (u, v) that connect exactly the nodes whose fingerprints are within all limits.

    ``nodes`` has _node and the fingerprint columns, without repeated fingerprints. The first
    column is cut into partitions and probed, the others (a sketch) are only verified. The partitioning is
    fitted on at most ``sample_size`` fingerprints; which links are found doesn't depend on it.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64(*columns)).limit(sample_size).select(columns[0]).toPandas()[columns[0]].to_numpy(np.int64).view(np.uint64)
    if total < 2:
        return spark.createDataFrame([], "u long, v long")
    plan = spark.sparkContext.broadcast(fit_plan(sample, total, limits[0]))
    hot = spark.sparkContext.broadcast(hot_values(nodes, columns[0], plan, total))
    names = ["_key", "_node", *columns, "_role"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *fps = (c.to_numpy() for c in batch.columns)
            for key, rows, role in _probes(plan.value, node, fps[0].view(np.uint64)):
                key, at = _cells(hot.value, key, node[rows])
                rows, role = rows[at], role[at]
                for a in range(0, len(key), 100_000):
                    r = rows[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[a : a + 100_000].view(np.int64)), pa.array(node[r]), *[pa.array(f[r]) for f in fps], pa.array(role[a : a + 100_000])], names=names
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, node, *rest = (np.concatenate(c) for c in zip(*rows, strict=True))
            u, v = _link(key, node, [x.view(np.uint64) for x in rest[:-1]], rest[-1], limits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            columns_ = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns_[0]):
                continue
            last = int(np.searchsorted(columns_[0], columns_[0][-1]))  # the last group may go on
            if last or (held and held[-1][0][-1] != columns_[0][0]):
                held.append([c[:last] for c in columns_])
                yield flush(held)
                held = []
            held.append([c[last:] for c in columns_])
        if held:
            yield flush(held)

    rows = nodes.select("_node", *columns).mapInArrow(probe, "_key long, _node long, " + ", ".join(f"{c} long" for c in columns) + ", _role byte")
    return rows.repartition(partitions(spark), "_key").sortWithinPartitions("_key").mapInArrow(meet, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_distance: int = 3,
    sketch_words: int | None = None,
    sketch_distance: int = 33,
    sample_size: int = 20_000,
) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most ``max_distance`` bits.

    Equal fingerprints are first collapsed to one node, so copies in any number cost one node.
    Correlated bits share a partition; each fingerprint's partitions get thresholds by dynamic
    programming on estimated candidate counts, which keeps frequent values from being probed; the
    found candidates are verified. Groups that share a value give a forest of links, never their
    pairs. With ``sketch_words`` a 256-bit sketch of longer shingles must be within
    ``sketch_distance`` bits too.

    Returns one row per input row: ``id_col``, fingerprint (16 hex digits), component_id (the least
    id of the component). Defined cases: a text that is null, empty or without words has
    fingerprint 0 and is linked like any other; null ids don't count as least id (a component of
    null ids has null); repeated rows are separate rows of one component; an empty table gives an
    empty result; further columns are ignored.
    """
    columns = ["_fp", *(SKETCH_COLUMNS if sketch_words else [])]
    limits = [max_distance, sketch_distance]
    fps = materialize(add_fingerprints(docs, words, sketch_words, id_col, text_col), "fingerprints")
    nodes = materialize(
        fps.groupBy(*columns).agg(F.min("_id").alias("_first")).select(F.monotonically_increasing_id().alias("_node"), *columns, "_first"), "fingerprint-nodes"
    )
    grouped = components(links(nodes, columns, limits, sample_size)).withColumnRenamed("node", "_node")
    firsts = grouped.join(nodes, "_node").groupBy("component").agg(F.min("_first").alias("_least"))
    named = grouped.join(firsts, "component").select("_node", "_least")
    known = nodes.join(named, "_node", "left").select(*columns, F.coalesce("_least", "_first").alias("component_id"))
    return fps.join(known, columns).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near copies: that of least id.

    Documents link when the sets of their ``words``-word shingles have an exact Jaccard similarity of
    0.8 or more (:func:`afterbell.llm.jaccard.jaccard_components`); groups are what links connect. Of
    repeated rows one stays; rows with null ids stay only if their group has no other.
    """
    from afterbell.llm.jaccard import jaccard_components

    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    near = jaccard_components(docs.select(key.alias("_afterbell_key"), text_col), "_afterbell_key", text_col, words)
    kept = materialize(near.where(F.col("_afterbell_key") == F.col("component_id")).groupBy("_afterbell_key").agg(F.count("*").alias("_afterbell_times")), "kept")
    same = docs.withColumn("_afterbell_key", key).join(kept, "_afterbell_key").drop("_afterbell_key")
    once = same.where("_afterbell_times = 1").drop("_afterbell_times")
    if kept.where("_afterbell_times > 1").isEmpty():
        return once
    again = docs.withColumn("_afterbell_key", key).join(kept.where("_afterbell_times > 1"), "_afterbell_key").dropDuplicates(["_afterbell_key"]).drop("_afterbell_key", "_afterbell_times")
    return once.unionByName(again)
