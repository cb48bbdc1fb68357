"""Connected components of a graph of links: local forests, then alternating large and small stars over tables.

Tasks of about EDGES links each first replace their own links by stars (a forest of the same components), which ends
the work where one task holds all links. Otherwise stars alternate until nothing changes; every step that gathers by a
node is a minimum (combined before the shuffle) whose result is written to the shared folder first, so the joins that
follow read two plain tables and Spark can split a node with very many links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

EDGES = 500_000


class Forest:
    """Union-find over ids; the smallest id is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    ids = list(forest.up)
    for at in range(0, len(ids), 100_000):
        part = ids[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], names=["u", "v"])


def _with_roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(a, b), a written table -> (id, component): every node that has a link, with the smallest id it reaches."""
    tasks = max(1, -(-links.count() // EDGES))
    edges = scratch.save(links.where("a != b").select("a", "b").coalesce(tasks).mapInArrow(tidy(_contract), "u long, v long"))
    if tasks == 1:
        return _with_roots(edges)
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == mark:
            return _with_roots(edges)
        mark = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: a node's larger neighbours go to its smallest one
        large = scratch.save(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))
        # small star: so do its smaller neighbours, and itself
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        new = scratch.save(small.distinct())
        scratch.drop(edges, low, large, low2)
        edges = new
