"""Connected components over edge tables, without gathering the graph anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import drop_scratch, materialize


#: Edges that one task puts together before any are joined.
EDGES = 1_000_000


def labels(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of each node's component, for edges between nodes 0, 1, ...: roots are hooked to lesser ones, then paths are cut short."""
    label = np.arange(max(u.max(initial=-1), v.max(initial=-1)) + 1)
    while True:
        a, b = label[u], label[v]
        least, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars around the least nodes of what up to about :data:`EDGES` edges of a task connect: fewer edges than nodes, however many pairs a group had."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> Iterator[pa.RecordBatch]:
        ends = np.concatenate([np.concatenate(c) for c in zip(*held, strict=True)])
        held.clear()
        nodes, at = np.unique(ends, return_inverse=True)
        label = labels(*at.reshape(2, -1))
        other = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= EDGES:
            yield from stars()
    if held:
        yield from stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's (larger or smaller) neighbours are linked to its least neighbour."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = edges.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        out = out.select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Node and least node of its component, for edges (u, v) of longs; isolated nodes don't appear.

    Alternates large-star and small-star steps until the edges are stars around the least nodes.
    Before, tasks of up to :data:`EDGES` edges turn their own into stars, so that a group whose pairs are
    all linked brings about as many edges as nodes into the joins. Each round is written to the shared folder. Self loops, repeated and reversed edges are fine.
    """
    given = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    tasks = max(1, -(-given.count() // EDGES))
    now = materialize(given.coalesce(tasks).mapInArrow(_forests, "u long, v long").distinct(), "edges")
    drop_scratch(given)
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, before = mark, now
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        drop_scratch(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
