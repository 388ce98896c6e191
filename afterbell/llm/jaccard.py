"""Near copies: SimHash links first, then all that is left; every link is an exact Jaccard similarity of shingle sets of 0.8 or more.

The SimHash step (operator 7's probing of partitioned fingerprints) finds most copies at once. What it can't
see, such as short texts and copies near the limit, comes from shared shingles: two sets of similarity 0.8 share
one of their first shingles in any order of all shingles, so none is lost. Nodes that are linked already don't meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from afterbell.llm.common import hits, in_parts, mark_cell, marks, materialize, partitions
from afterbell.llm.graph import components
from afterbell.llm.simhash import BLOCK, SHIFT_GROUP, _forest, fingerprint_of, links, shingle_hashes

#: Cells in which the documents of each shingle are counted; cells of a row that carries counts.
CELLS, CELL_ROW = 1 << 20, 1 << 16
#: Least bits of a parity bitmap, as a power of two.
LEAST_CLASS = 6
#: Rows of a posting that one task compares; larger ones are compared chunk by chunk. Partners of a set that one task compares with it.
CHUNK, PARTNERS = 16_384, 2_048


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted different hashes; a text without words has a set of its own."""
    return np.unique(hashes.astype(np.uint64)) if len(hashes) else np.zeros(1, np.uint64)


def size_class(n: int) -> int:
    """Bits of the bitmap of a set of n, as a power of two: at least n."""
    return max(LEAST_CLASS, int(n - 1).bit_length())


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the members in each cell: two bitmaps of one width differ in at most as many bits as the sets in members."""
    width = 1 << size_class(len(hashes))
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes) -> bytes:
    """The bitmap of half the width."""
    half = len(bits) // 2
    return (int.from_bytes(bits[:half], "big") ^ int.from_bytes(bits[half:], "big")).to_bytes(half, "big")


def prefix(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set in one order of all shingles, rare ones first, so many that sets of similarity 0.8 share one.

    Such a set shares at least 4/5 of its members with the other, so both can't miss among the first
    n - ceil(4 n / 5) + 1, whatever the order is: here the rank of the cell, then the hash.
    """
    order = (rank[cells_of(hashes)].astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    return hashes[np.argsort(order, kind="stable")[: len(hashes) // 5 + 1]]


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def sign(docs: DataFrame, words: int) -> DataFrame:
    """_id, _fp (SimHash), _set (digest of the set), _n (its size), _bits; and rows without a digest: the documents of each shingle, counted by cell."""
    id_type = docs.schema["_id"].dataType.simpleString()
    names = ["_id", "_fp", "_set", "_n", "_bits", "_cells", "_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_arrow = np.zeros(CELLS, np.int64), None
        for batch in in_parts(batches):
            id_arrow, n = batch.schema.field(0).type, batch.num_rows
            fps, sets = np.zeros(n, np.uint64), []
            for i, text in enumerate(_texts(batch, 1)):
                hashes = shingle_hashes(text, words)
                fps[i] = fingerprint_of(hashes)
                sets.append(shingle_set(hashes))
            counts += np.bincount(cells_of(np.concatenate(sets)) if sets else np.zeros(0, np.int64), minlength=CELLS)
            columns = [
                batch.column(0), pa.array(fps.view(np.int64)), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if id_arrow is not None:
            parts = counts.astype("<i8").reshape(-1, CELL_ROW)
            k = len(parts)
            empty = [pa.nulls(k, t) for t in (id_arrow, pa.int64(), pa.binary(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return docs.mapInArrow(run, f"_id {id_type}, _fp long, _set binary, _n long, _bits binary, _cells int, _counts binary")


def cell_ranks(signed: DataFrame) -> np.ndarray:
    """The rank of each cell by how many documents hold its shingles, over all documents; always ``CELLS`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[cells] = sums.get(cells, 0) + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["_cells", "_counts"])

    rows = signed.where("_set is null").select("_cells", "_counts").repartition(CELLS // CELL_ROW, "_cells").mapInArrow(add, "_cells int, _counts binary")
    counts = np.zeros(CELLS, np.int64)
    for row in rows.collect():  # a fixed number of cells
        counts[row._cells * CELL_ROW : (row._cells + 1) * CELL_ROW] = np.frombuffer(row._counts, "<i8")
    rank = np.empty(CELLS, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(CELLS, dtype=np.int32)
    return rank


def prefixes(docs: DataFrame, words: int, rank: Broadcast) -> DataFrame:
    """_id and _prefix."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [prefix(shingle_set(shingle_hashes(t, words)), rank.value).view(np.int64) for t in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_id", "_prefix"])

    return docs.mapInArrow(run, f"_id {id_type}, _prefix array<long>")


def postings(docs: DataFrame, nodes: DataFrame, words: int, rank: Broadcast) -> DataFrame:
    """_key, _node, _times: the nodes that share shingles of their prefixes. Shingles with the same nodes are one key, as they give the same pairs.

    (Repeated rows of one text may make keys of different shingles equal; that only adds pairs to look at.)
    """
    rows = prefixes(docs, words, rank).join(nodes.select(F.col("_first").alias("_id"), "_node"), "_id").select("_node", F.explode("_prefix").alias("_shingle"))
    same = Window.partitionBy("_shingle")
    shared = rows.withColumns({"_times": F.count("*").over(same), "_x": F.bit_xor(F.xxhash64("_node")).over(same), "_y": F.bit_xor(F.xxhash64("_node", F.lit(1))).over(same)})
    return materialize(shared.where("_times > 1").select(F.xxhash64("_times", "_x", "_y").alias("_key"), "_node", "_times").distinct(), "postings")


def _possible(bits: np.ndarray, n: np.ndarray, group: np.ndarray, guest: np.ndarray, i, j) -> np.ndarray:
    """Pairs that may have similarity 0.8: such sets differ in at most a ninth of their sizes' sum. Never false for one that has it."""
    a, b = n[i], n[j]
    ok = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (group[i] != group[j]) & ~(guest[i] & guest[j])
    if ok.any():
        ok &= 9 * sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in bits) <= a + b
    return ok


def _pairs(
    key: np.ndarray, node: np.ndarray, n: np.ndarray, group: np.ndarray, guest: np.ndarray, bits: np.ndarray, whole: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of different groups inside equal keys (sorted); of a large key a forest only, unless ``whole``."""
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)]))
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= SHIFT_GROUP, sizes)
    for shift in range(1, min(SHIFT_GROUP, int(sizes.max(initial=1)))):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
        if not len(i):
            break
        ok = _possible(bits, n, group, guest, i, i + shift)
        yield node[i[ok]], node[i[ok] + shift]
    for g in np.flatnonzero(sizes > SHIFT_GROUP):
        for a in range(bounds[g], bounds[g + 1], BLOCK):
            rows = np.arange(a, min(a + BLOCK, bounds[g + 1]))
            for b in range(a, bounds[g + 1], BLOCK):
                cols = np.arange(b, min(b + BLOCK, bounds[g + 1]))
                if 5 * n[rows].max() < 4 * n[cols].min():
                    break  # the rows of a key are sorted by size
                ok = _possible(bits, n, group, guest, rows[:, None], cols[None, :])
                i, j = np.nonzero(ok) if whole else _forest(ok)
                yield node[rows[i]], node[cols[j]]


def meet(met: DataFrame, nodes: DataFrame, whole: bool) -> DataFrame:
    """Different possible pairs (u < v) of the postings ``met``: _key, _node, _times, _group.

    Bitmaps are compared at one width: a set meets those of its class by its own bitmap, and as a
    guest, with half the width, those of the class below that are large enough.
    """
    parts = F.ceil(F.col("_times") / CHUNK).cast("long")
    own = F.pmod(F.xxhash64("_node"), parts)
    cells = F.when(parts <= 1, F.array(F.col("_key"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: F.xxhash64("_key", F.least(own, x), F.greatest(own, x)))
    )
    classes = nodes.select("_node", "_n", "_bits", F.round(F.log2(F.octet_length("_bits") * 8)).cast("int").alias("_class"))
    both = met.select("_node", "_group", F.explode(cells).alias("_key")).join(classes, "_node")
    guests = (F.col("_class") > LEAST_CLASS) & F.expr("4 * _n <= 5 * shiftleft(1L, _class - 1)")
    rows = both.select(
        "_key", "_node", "_n", "_group", "_bits",
        F.explode(F.when(guests, F.array(F.col("_class"), F.col("_class") - 1)).otherwise(F.array("_class"))).alias("_class"), F.col("_class").alias("_of"),
    ).select("_class", "_key", "_node", "_n", "_group", (F.col("_of") > F.col("_class")).alias("_guest"), "_bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            key, node, n, group, guest, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            words = np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(key), -1)
            for u, v in _pairs(key, node, n, group, guest, np.ascontiguousarray(words.T), whole):
                pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            kind, key, node, n, group = (batch.column(i).to_numpy() for i in range(5))
            guest = batch.column(5).to_numpy(zero_copy_only=False)
            bits = np.empty(len(kind), object)
            bits[:] = [folded(b) if g else b for b, g in zip(batch.column(6).to_pylist(), guest, strict=True)]
            cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)], strict=True) if len(kind) else ():
                # whole keys are compared together, up to a batch of them; each flush has one width
                if held and (now[0] != kind[a] or (now[1] != key[a] and sum(len(x[0]) for x in held) > 4 * BLOCK)):
                    yield from flush()
                now = (kind[a], key[a])
                held.append([c[a:b] for c in (key, node, n, group, guest, bits)])
        if held:
            yield from flush()

    dealt = rows.repartition(partitions(met.sparkSession), "_class", "_key").sortWithinPartitions("_class", "_key", "_n", "_node")
    return dealt.mapInArrow(run, "u long, v long").where("u <> v").distinct()


def decide(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) whose whole sets have a similarity of 0.8 or more.

    Sets are made where the texts are, only of texts that :func:`marks` lets through, so texts aren't shuffled.
    Each set goes once to its own place and once to each partner's; sets with many partners have several places.
    """
    pairs = materialize(pairs.withColumn("_center", F.col("u")), "pairs")
    places = pairs.groupBy("_center").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("_places"))
    salted = pairs.join(places, "_center").select("u", "v", F.pmod(F.xxhash64("v"), "_places").alias("_salt"))
    sent = salted.select("u", "_salt", F.explode(F.array("u", "v")).alias("_node")).distinct()
    sent = materialize(sent.join(nodes.select("_node", F.col("_first").alias("_id")), "_node"), "sent")
    wanted, bits = marks(sent, "_id")
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            batch = batch.filter(pa.array(hits(wanted, batch.column(1))))
            sets = [shingle_set(shingle_hashes(t, words)).view(np.int64) for t in _texts(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_id", "_hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            us, vs = [], []
            flat, ends = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for i, (u, salt, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                own = flat[ends[i] : ends[i + 1]].view(np.uint64)
                if node == u:
                    at, centre = (u, salt), own.copy()
                elif at == (u, salt):
                    both = np.concatenate((centre, own))
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    if 9 * same >= 4 * (len(centre) + len(own)):
                        us.append(u)
                        vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    sets = docs.select("_id", mark_cell("_id", bits).alias("_cell"), "_text").mapInArrow(run, f"_id {id_type}, _hashes array<long>")
    dealt = sets.join(sent, "_id").select("u", "_salt", "_node", "_hashes").repartition(partitions(docs.sparkSession), "u", "_salt").sortWithinPartitions("u", "_salt", F.col("_node") != F.col("u"))
    out = materialize(dealt.mapInArrow(compare, "u long, v long"), "links")
    wanted.destroy()  # the links are a table now
    return out


def jaccard_components(docs: DataFrame, id_col: str, text_col: str, words: int = 5, max_distance: int = 3) -> DataFrame:
    """``id_col`` and component_id, the least id of all documents that links of similarity 0.8 and more connect.

    Similarity is the exact Jaccard similarity of the sets of ``words``-word shingles; no pair that
    reaches 0.8 is lost. Equal sets are one node.

    1. SimHash fingerprints within ``max_distance`` bits give the first pairs.
    2. Nodes that aren't linked by then meet where their prefixes share shingles. Pairs that sizes or bitmaps
       rule out are dropped, which is a bound, not an estimate. Keys of over ``SHIFT_GROUP`` nodes first
       give a forest, then all their pairs that still aren't connected.
    3. Every pair is decided by its whole sets.

    ``id_col`` must not be null.
    """
    spark = docs.sparkSession
    docs = _keyed(docs, id_col, text_col)
    signed = materialize(sign(docs, words), "signatures")
    rank = spark.sparkContext.broadcast(cell_ranks(signed))
    rows = signed.where("_set is not null")
    grouped = rows.groupBy("_set").agg(F.min("_id").alias("_first"), *[F.first(c).alias(c) for c in ("_fp", "_n", "_bits")])
    nodes = materialize(grouped.withColumn("_node", F.monotonically_increasing_id()), "signature-nodes")

    prints = materialize(nodes.groupBy("_fp").agg(F.min("_node").alias("_first_node")).select(F.col("_first_node").alias("_node"), "_fp"), "prints")
    equal = nodes.select("_fp", F.col("_node").alias("v")).join(prints.select("_fp", F.col("_node").alias("u")), "_fp").where("u <> v").select("u", "v")
    near = links(prints, ["_fp"], [max_distance]).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    linked = decide(near.unionAll(equal).distinct(), docs, nodes, words)

    met = postings(docs, nodes, words, rank)
    rank.destroy()  # the postings are a table now

    def with_groups(met: DataFrame, linked: DataFrame) -> DataFrame:
        return met.join(components(linked).withColumnRenamed("node", "_node"), "_node", "left").withColumn("_group", F.coalesce("component", "_node"))

    linked = linked.unionAll(decide(meet(with_groups(met, linked), nodes, whole=False), docs, nodes, words))
    large = met.where(F.col("_times") > SHIFT_GROUP)
    if not large.isEmpty():
        linked = linked.unionAll(decide(meet(with_groups(large, linked), nodes, whole=True), docs, nodes, words))
    found = components(linked).withColumnRenamed("node", "_node").join(nodes.select("_node", "_first"), "_node")
    least = found.groupBy("component").agg(F.min("_first").alias("_least"))
    named = found.join(least, "component").select("_node", "_least")
    known = nodes.select("_node", "_set", "_first").join(named, "_node", "left").select("_set", F.coalesce("_least", "_first").alias("component_id"))
    return rows.select("_id", "_set").join(known, "_set").select(F.col("_id").alias(id_col), "component_id")
