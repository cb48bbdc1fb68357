"""Exact top-k search by inner product with a pivot-distance index.

A vector x of integers becomes a point (x, sqrt(M - |x|^2)), M the largest squared norm, and a query q the point
(q, 0): then |q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest points. Every point is keyed by
its nearest pivot and its distance to it. The points of a pivot are dealt to places of at most PLACE rows (by hashed id, so
that copies of a vector don't meet in one task) and sorted by distance there: consecutive ones form annuli of at most RING
points. Each place meets every block of queries, which expands its rings from the one nearest to each query outwards and stops
when the triangle inequality's bound for all that remain is beyond the query's k-th best score so far. A first k-th best comes from
a bounded sample of the vectors, which tasks hold against blocks of queries.
Scores are exact integers; bounds have a slack over their rounding, and ties are never cut off.

The pivots are picked on at most SAMPLE vectors (those of the smallest hashed id), each far from those before. Queries go to
places by a shuffle (``shards``), so any number of them can be asked and none pass through the driver.

Results for odd rows: vectors that are null or empty, or hold a null or a non-finite component, and rows with a null id take no
part, nor do vectors of another length than the most frequent one (of equally frequent ones the smallest); repeated ids are
separate candidates, except that a query never gets rows of its own id, and of rows that repeat a query's id the smallest vector
asks; empty tables give no rows; ties go to the smaller id, and rows that tie in score and id all count; scores beyond 63 bits
are held to 62 bits; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .shards import searched

#: Below every score.
LEAST = -(1 << 62)
PIVOTS, SAMPLE, RING, PLACE, SCALE = 32, 2048, 512, 131_072, 1024


def quantized(vectors: DataFrame, scale: int = SCALE, *others: str) -> DataFrame:
    """(vec_id, others, v): floor(scale * x) of each component x as double; rows that take no part are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *others, x.alias("embedding"))
        .where("vec_id is not null and embedding is not null and size(embedding) > 0")
        .where(~bad)
        .select("vec_id", *others, F.transform("embedding", lambda c: F.floor(F.lit(scale).cast("double") * c.cast("double")).cast("long")).alias("v"))
    )


def most_frequent_length(vectors: DataFrame) -> int | None:
    """The length that most vectors have, of equally frequent ones the smallest."""
    usual = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    return usual and usual.n


def matrix(column) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)


def _largest(a: np.ndarray) -> int:
    """The largest absolute value, at least 1 (that of the smallest 64-bit integer has no place in 64 bits)."""
    return max(1, int(a.max(initial=0)), -int(a.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; by floating point where every partial sum is exact in it."""
    most = _largest(a) * _largest(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)  # integers of any size
    return np.clip(exact, LEAST + 1, -LEAST).astype(np.int64)


def lift(v: np.ndarray, most: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def pick_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """The first point, then each time the one farthest from those taken."""
    taken = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(taken) < min(n, len(points)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken]


def _keyed(pivots: np.ndarray, most: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                p = lift(matrix(part.column(1)), most)
                d = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * p @ pivots.T, 0))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "v", "pivot", "distance"])

    return run


class Best:
    """The k best of each query so far; ties go to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LEAST)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """score: queries (rows) x candidates (ids); own: the queries' ids, which are no candidates of theirs."""
        score = np.where(ids[None, :] == own[:, None], LEAST, score)
        floor = self.score[rows, -1]
        for i in np.flatnonzero((score >= floor[:, None]).any(1) & (score.max(1, initial=LEAST) > LEAST)):
            take = np.flatnonzero((score[i] >= floor[i]) & (score[i] > LEAST))
            s, d = np.concatenate((self.score[rows[i]], score[i, take])), np.concatenate((self.id[rows[i]], ids[take]))
            order = np.lexsort((d, -s))[: self.k]
            self.score[rows[i]], self.id[rows[i]] = s[order], d[order]


class Rings:
    """The annuli of a place: pivot, least and greatest distance, ids and vectors of each."""

    def __init__(self, t: pa.Table):
        ids, pivot, dist = (t[c].to_numpy() for c in ("vec_id", "pivot", "distance"))
        v = matrix(t["v"].combine_chunks())
        narrow = v.astype(np.int32)
        v = narrow if (narrow == v).all() else v
        edge = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        cut = [(i, min(i + RING, b)) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)]) for i in range(a, b, RING)]
        self.pivot, self.lo, self.hi = np.array([pivot[i] for i, _ in cut]), np.array([dist[i] for i, _ in cut]), np.array([dist[j - 1] for _, j in cut])
        self.ids, self.v = [ids[i:j] for i, j in cut], [v[i:j] for i, j in cut]


def _floors(sample, k: int):
    """Adds to a block of queries the k-th best score of each among the sample."""
    taken_ids, taken = sample

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        best = Best(block.num_rows, k)
        if block.num_rows:
            ids, q = block.column(0).to_numpy(), matrix(block.column(1))
            best.add(np.arange(len(ids)), products(q, taken), taken_ids, ids)
        return block.append_column("floor", pa.array(best.score[:, -1]))

    return run


def _search(pivots: np.ndarray, most: float, k: int):
    def run(rings: Rings, block: pa.RecordBatch):
        q_ids, q, floor = block.column(0).to_numpy(), matrix(block.column(1)), block.column(2).to_numpy()
        points = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        square = (q.astype(np.float64) ** 2).sum(1)
        to_pivot = np.sqrt(np.maximum((points * points).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * points @ pivots.T, 0))
        best, d = Best(len(q), k), to_pivot[:, rings.pivot]
        bound = np.maximum(0, np.maximum(rings.lo - d, d - rings.hi))
        for r in np.argsort(bound.min(0), kind="stable"):
            reach = np.maximum(best.score[:, -1], floor).astype(np.float64)
            limit = np.sqrt(np.maximum(square + most - 2 * reach, 0)) * (1 + 1e-9) + 1e-3 + 1e-6 * np.sqrt(square + most)
            rows = np.flatnonzero((bound[:, r] <= limit) | (reach <= LEAST))
            if len(rows):
                best.add(rows, products(q[rows], rings.v[r].astype(np.int64)), rings.ids[r], q_ids[rows])
        i, j = np.nonzero((best.score > LEAST) & (best.score >= floor[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j])], names=["query_id", "vec_id", "score"])

    return run


_OUT = "query_id long, vec_id long, score long"
_RANKED = "query_id long, rank int, vec_id long, score long"


def places_of(keyed: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    """keyed(vec_id, key, ...) with ``place`` (0, 1, ...): each key's rows, of which there are few, in places of about ``size`` rows by
    hashed id; and how many places there are."""
    first, of, places = {}, {}, 0
    for value, n in keyed.groupBy(key).count().orderBy(key).collect():
        first[value], of[value] = places, -(-n // size)
        places += of[value]
    number = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col(key))
    return keyed.withColumn("place", (number(first) + F.pmod(F.xxhash64("vec_id"), number(of))).cast("int")), places


def rows_of_a_place(rows: int, least: int, spark) -> int:
    """As many as give each shuffle partition a place, between ``least`` and PLACE."""
    return min(PLACE, max(least, -(-rows // int(spark.conf.get("spark.sql.shuffle.partitions")))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors(vec_id, v), queries(vec_id, v) -> (query_id, rank, vec_id, score): the k largest inner products."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    usual = most_frequent_length(vectors)
    if usual is None:
        return spark.createDataFrame([], _RANKED)
    rows = scratch.save(vectors.where(F.size("v") == usual).select("vec_id", "v"))
    queries = queries.where(F.size("v") == usual).groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    most, n = rows.agg(F.coalesce(F.max(square), F.lit(0.0)), F.count("*")).first()
    most = most * (1 + 1e-12) + 1
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    taken, taken_ids = np.array(sample["v"].tolist(), np.int64), sample["vec_id"].to_numpy(np.int64)
    pivots = pick_pivots(lift(taken, most), PIVOTS)
    keyed = scratch.save(rows.mapInArrow(tidy(_keyed(pivots, most)), "vec_id long, v array<long>, pivot int, distance double"))
    index, places = places_of(keyed, "pivot", rows_of_a_place(n, RING, spark))
    found = searched(index, places, queries, Rings, _search(pivots, most, k), _OUT, ["pivot", "distance", "vec_id"], _floors((taken_ids, taken), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
