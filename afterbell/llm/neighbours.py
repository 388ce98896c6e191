"""Operator 10: nearest neighbours by vantage-point trees per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from afterbell.llm.common import materialize

#: Vectors of a tree, points of a leaf, queries of a block.
SHARD_ROWS, LEAF, BLOCK = 8192, 256, 2048
#: Room for rounding: when a branch is ruled out, and, in squared lengths, when a product stands for a distance.
SLACK, ROUNDING = 1e-9, 1e-11


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        difference = queries[:, j, None] - points[None, :, j]
        total += difference * difference
    return np.sqrt(total)


class Tree:
    """Vantage-point tree over the rows of ``points``.

    nodes: vantage point (-1: leaf), radius, inner node, outer node, first and last place of its
    points in ``order``. Points at most a radius from the vantage point are inside.
    """

    def __init__(self, points: np.ndarray, seed: int = 11):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[list[float]] = []
        random = np.random.default_rng(seed)
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            number = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = number
            if b - a <= LEAF:
                self.nodes.append([-1, 0, -1, -1, a, b])
                continue
            k = int(random.integers(a, b))
            self.order[[a, k]] = self.order[[k, a]]
            d = distances(points[self.order[a : a + 1]], points[self.order[a + 1 : b]])[0]
            radius = float(np.partition(d, len(d) // 2)[len(d) // 2])
            inside = d <= radius
            if inside.all():  # many equal distances
                inside = d < radius
            rest = self.order[a + 1 : b]
            self.order[a + 1 : b] = np.concatenate((rest[inside], rest[~inside]))
            middle = a + 1 + int(inside.sum())
            self.nodes.append([int(self.order[a]), radius, -1, -1, a, b])
            if middle > a + 1 and middle < b:
                todo += [(a + 1, middle, number, 0), (middle, b, number, 1)]
            else:  # all others are equally far: one long leaf
                self.nodes[number] = [-1, 0, -1, -1, a, b]

    def pack(self) -> tuple[bytes, bytes]:
        return np.array(self.nodes, "<f8").tobytes(), self.order.astype("<i8").tobytes()

    @classmethod
    def unpack(cls, points: np.ndarray, nodes: bytes, order: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.order = points, np.frombuffer(order, "<i8")
        tree.nodes = np.frombuffer(nodes, "<f8").reshape(-1, 6).tolist()
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest points of each query but those with its own id, ties to the smaller id.

        A branch is left out if its least possible distance times ``factor`` is above the k-th
        distance so far: factor 1 leaves out only what cannot hold a neighbour. In a leaf, matrix
        products rule out what is farther than the k-th by more than rounding; the rest is measured exactly.
        """
        best = np.full((len(queries), k), np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        q2, p2 = (queries * queries).sum(axis=1), (self.points * self.points).sum(axis=1)

        def offer(rows: np.ndarray, d: np.ndarray, found: np.ndarray) -> None:
            """Distances ``d`` of points ``found`` (ids) from the queries ``rows``, one each."""
            near = (d <= best[rows, -1]) & (own[rows] != found)
            if not near.any():
                return
            rows, d, found = rows[near], d[near], found[near]
            some = np.unique(rows)
            all_rows = np.concatenate((np.repeat(some, k), rows))
            all_d, all_n = np.concatenate((best[some].ravel(), d)), np.concatenate((names[some].ravel(), found))
            order = np.lexsort((all_n, all_d, all_rows))
            top = order[np.searchsorted(all_rows[order], some)[:, None] + np.arange(k)]
            best[some], names[some] = all_d[top], all_n[top]

        def leaf(rows: np.ndarray, at: np.ndarray) -> None:
            near = q2[rows, None] + p2[None, at] - 2 * (queries[rows] @ self.points[at].T)
            room = ROUNDING * (q2[rows] + p2[at].max())
            limit = np.minimum(best[rows, -1] ** 2, np.partition(near, k, axis=1)[:, k] if len(at) > k + 1 else np.inf) + 2 * room
            i, j = np.nonzero(near <= limit[:, None])
            d = np.zeros(len(i))
            for c in range(queries.shape[1]):
                difference = queries[rows[i], c] - self.points[at[j], c]
                d += difference * difference
            offer(rows[i], np.sqrt(d), ids[at[j]])

        def visit(number: int, rows: np.ndarray) -> None:
            vantage, radius, inner, outer, a, b = self.nodes[number]
            if vantage < 0:
                at = self.order[int(a) : int(b)]
                for part in range(0, len(rows), 512):
                    for first in range(0, len(at), 4096):
                        leaf(rows[part : part + 512], at[first : first + 4096])
                return
            d = distances(queries[rows], self.points[int(vantage)][None])[:, 0]
            offer(rows, d, np.full(len(rows), ids[int(vantage)]))
            within = d <= radius
            for near, far, side in ((inner, outer, within), (outer, inner, ~within)):
                if side.any():
                    visit(int(near), rows[side])
                    least = np.abs(d[side] - radius) - SLACK
                    rest = rows[side][least * factor <= best[rows[side], -1]]
                    if len(rest):
                        visit(int(far), rest)

        if self.nodes and len(queries) and len(self.points):
            visit(0, np.arange(len(queries)))
        return best, names


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows _id and _vector (doubles) that take part: no null id or vector, no null or non-finite component, not all zero, of the most frequent length."""
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector")).where(
        F.col("_id").isNotNull()
        & F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("_vector", lambda x: x != 0)
    )
    length = v.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("_vector") == (length.n if length else 0))


def _pack(rows: DataFrame, group: str, n: int, names: dict[str, str], grow) -> DataFrame:
    """One row of bytes for each of the ``n`` groups; ``grow`` makes it from the group's sorted ids and its points."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        found = grow(ids[order], np.vstack(table.column("_vector").to_numpy())[order], table.take(order))
        return pa.table({k: pa.array([v], pa.binary() if names[k] == "binary" else pa.int64()) for k, v in found.items()})

    return rows.repartition(n, group).groupBy(group).applyInArrow(run, ", ".join(f"{k} {v}" for k, v in names.items()))


def build_index(distinct: DataFrame, k: int = 10) -> DataFrame:
    """One row per shard of about ``SHARD_ROWS`` vectors: shard, ids, points and tree, written to the shared folder. Every vector is in one tree.

    ``distinct`` has _id, _vector and _times; of rows that are equal in both, as many as a result can hold are put in.
    """
    rows = distinct.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("_times", F.lit(k)))))
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def grow(ids: np.ndarray, points: np.ndarray, table: pa.Table) -> dict:
        nodes, places = Tree(points).pack()
        return {"_shard": table.column("_shard")[0].as_py(), "ids": ids.astype("<i8").tobytes(), "points": points.astype("<f8").tobytes(), "nodes": nodes, "places": places}

    dealt = rows.select("_id", "_vector", F.pmod(F.xxhash64("_id", "_vector", "_copy"), F.lit(shards)).alias("_shard"))
    return materialize(_pack(dealt, "_shard", shards, {"_shard": "long"} | dict.fromkeys(("ids", "points", "nodes", "places"), "binary"), grow), "vector-index")


def query_blocks(queries: DataFrame) -> DataFrame:
    """One row per block of about ``BLOCK`` queries (_id, _vector, _q): their numbers, ids and vectors."""
    n = max(1, -(-queries.count() // BLOCK))

    def grow(ids: np.ndarray, points: np.ndarray, table: pa.Table) -> dict:
        numbers = table.column("_q").to_numpy()
        return {"q_numbers": numbers.astype("<i8").tobytes(), "q_ids": ids.astype("<i8").tobytes(), "q_points": points.astype("<f8").tobytes()}

    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(n)))
    return _pack(dealt, "_block", n, dict.fromkeys(("q_numbers", "q_ids", "q_points"), "binary"), grow)


def nearest_neighbours(
    vectors: DataFrame, queries: F.Column | None = None, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows (Euclidean) of every query row, among all rows but those with its own id.

    ``queries`` chooses the query rows by ``id_col`` (default: ids divisible by 100). All rows are
    indexed: hashed into shards of bounded size with one vantage-point tree each. Queries are packed into
    blocks, every block is dealt to every shard by a join on the shard's number, and a task searches
    one tree at a time; each tree gives its k nearest and the least k of these win. ``factor``
    above 1 rules out branches sooner (faster, may miss neighbours), 1 gives exact results.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer
    candidates. Defined cases: vectors that are null, zero, hold null or non-finite components, have
    a null id or another length than most take no part, as queries neither; a repeated id isn't its
    own neighbour, and each of its rows has its own result; ties go to the smaller id; an empty table
    gives an empty result; further columns are ignored.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    usable = usable_vectors(vectors, id_col, vector_col)
    distinct = materialize(usable.groupBy("_id", "_vector").agg(F.count("*").alias("_times")), "vectors")
    index = build_index(distinct, k)
    chosen = distinct.where((F.col("_id") % 100 == 0) if queries is None else queries)
    asked = materialize(chosen.withColumn("_q", F.monotonically_increasing_id()), "queries")
    numbers = index.agg(F.collect_set("_shard").alias("_shards"))  # one number per shard
    dealt = query_blocks(asked).join(F.broadcast(numbers)).withColumn("_shard", F.explode("_shards")).drop("_shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, nodes, places, q, q_ids, q_points in zip(*batch.columns, strict=True):
                ids, q, q_ids = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, q, q_ids))
                points, q_points = (np.frombuffer(x.as_buffer(), "<f8").reshape(n, -1) for x, n in ((points, len(ids)), (q_points, len(q))))
                score, found = Tree.unpack(points, nodes.as_py(), places.as_py()).search(q_points, q_ids, ids, k, factor)
                full = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[full.ravel()]), pa.array(found[full]), pa.array(score[full])], names=["_q", "vec_id", "score"])

    met = index.join(dealt, "_shard").select("ids", "points", "nodes", "places", "q_numbers", "q_ids", "q_points")
    found = met.mapInArrow(run, "_q long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    named = asked.select("_q", F.col("_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_row"))
    return named.join(ranked, "_q").select("query_id", "rank", "vec_id", "score")
