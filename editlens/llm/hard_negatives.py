"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A vector x of integers becomes a point (x, sqrt(M - |x|^2)), M the largest squared norm, and an anchor q the point (q, 0):
|q - x|^2 = |q|^2 + M - 2 q.x, so large scores are small distances, and a window of scores is an annulus around the anchor.

The top of the tree is made of at most SAMPLE vectors (those of the smallest hashed id): each node parts points by whether they are
nearer to its vantage point than the median. Every row falls through it to a cell; a cell of more rows than a place has (PLACE at most)
is dealt to several places by hashed id, so that copies of one vector don't meet in one task. Each place makes a tree of its own: nodes part
their points at the median distance down to leaves of LEAF, and keep the least and the greatest distance on either side.

A block of anchors finds, for each place, between which distances each leaf can lie (triangle inequality along its path). From
there every anchor goes through its leaves from the nearest on, a few at a time, skips those that lie outside its annulus, and stops
when the next is farther than the k-th best found so far, or than the k-th best of the sample. Scores are exact integers; bounds have
a slack over their rounding, and ties are never cut off. The first search yields an anchor's positives (rows of its label), the
second, for the window of each positive, the rows of other labels.

Results for odd rows: rows with a null id, a null label, a null or empty vector or one with a null or non-finite component take no
part, nor do vectors of another length than the most frequent one (of equally frequent ones the smallest); rows that repeat an id
are separate candidates, except that an anchor never gets rows of its own id; of rows that repeat an anchor's id the one of the
smallest label and vector asks; a positive that comes twice has its negatives once; anchors without positives, and windows without
rows (as those of negative scores), give no rows; ties go to the smaller id; scores beyond 63 bits are held to 62 bits; an
empty table gives no rows; other columns aren't read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .shards import searched
from .vector_search import LEAST, Best, lift, matrix, most_frequent_length, places_of, products, rows_of_a_place

SAMPLE, CELL, LEAF, STEP = 2048, 16, 256, 4
POSITIVES, NEGATIVES = 5, 5
#: Above every score.
MOST = -LEAST


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class Top:
    """The upper levels: node i has the children 2 i + 1 (nearer) and 2 i + 2; the leaves are cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.at, self.radius = np.zeros(((1 << depth) - 1, points.shape[1])), np.zeros((1 << depth) - 1)
        members = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            own = members.pop(node)
            if not len(own):
                members[2 * node + 1] = members[2 * node + 2] = own
                continue
            self.at[node] = points[own[-1]]
            d = apart(points[own], self.at[node][None])[:, 0]
            self.radius[node] = np.median(d)
            members[2 * node + 1], members[2 * node + 2] = own[d <= self.radius[node]], own[d > self.radius[node]]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(((points - self.at[node]) ** 2).sum(1))
            node = 2 * node + 1 + (d > self.radius[node])
        return node - ((1 << self.depth) - 1)


class Tree:
    """A vantage-point tree of the rows of a place; leaves are stretches of the rows, which are put in their order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: float):
        points = lift(v, most)
        vantage, order, self.edge, paths = [], [], [0], []
        todo = [(np.arange(len(v)), [])]
        while todo:
            own, path = todo.pop()
            if len(own) <= LEAF:
                order.append(own)
                self.edge.append(self.edge[-1] + len(own))
                paths.append(path)
                continue
            d = apart(points[own], points[own[:1]])[:, 0]
            far = np.argsort(d, kind="stable")
            node, half = len(vantage), len(own) // 2
            vantage.append(points[own[0]])
            for part in (far[half:], far[:half]):
                todo.append((own[part], [*path, (node, d[part[0]], d[part[-1]])]))
        order = np.concatenate(order)
        self.ids, self.labels, v = ids[order], labels[order], v[order]
        narrow = v.astype(np.int32)
        self.v = narrow if (narrow == v).all() else v
        self.vantage = np.array(vantage).reshape(len(vantage), points.shape[1])
        self.paths = paths

    def reach(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distance that rows of each leaf can have from points."""
        to = apart(points, self.vantage)
        least, greatest = np.zeros((len(points), len(self.paths))), np.full((len(points), len(self.paths)), np.inf)
        for leaf, path in enumerate(self.paths):
            for node, lo, hi in path:
                d = to[:, node]
                np.maximum(least[:, leaf], np.maximum(lo - d, d - hi), out=least[:, leaf])
                np.minimum(greatest[:, leaf], d + hi, out=greatest[:, leaf])
        return least, greatest


class Probes:
    """What a block asks: for each probe an anchor, whether rows of its label or of others, a window of scores, and a floor."""

    def __init__(self, block: pa.RecordBatch):
        get = lambda c: block.column(block.schema.get_field_index(c))
        self.anchor, self.label, self.lo, self.hi, self.floor = (get(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label", "lo", "hi", "floor"))
        self.same = get("same").to_numpy(zero_copy_only=False)
        self.v = matrix(get("v"))

    def scores(self, rows: np.ndarray, v: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Scores of candidates for some probes; LEAST where one is none."""
        vectors, which = np.unique(self.v[rows], axis=0, return_inverse=True)
        score = products(vectors, v.astype(np.int64))[which.reshape(-1)]
        fits = (labels[None, :] == self.label[rows][:, None]) == self.same[rows][:, None]
        fits &= (score >= self.lo[rows][:, None]) & (score <= self.hi[rows][:, None]) & (ids[None, :] != self.anchor[rows][:, None])
        return np.where(fits, score, LEAST)


def with_floor(block: pa.RecordBatch, sample, k: int) -> pa.RecordBatch:
    """The block with the k-th best score that each probe has among the sample (LEAST if there are fewer)."""
    ids, labels, v = sample
    block = block.append_column("floor", pa.array(np.full(block.num_rows, LEAST)))
    if block.num_rows:
        score = Probes(block).scores(np.arange(block.num_rows), v, labels, ids)
        floor = np.sort(score, 1)[:, -k] if len(ids) >= k else np.full(block.num_rows, LEAST)
        block = block.set_column(block.schema.get_field_index("floor"), "floor", pa.array(floor))
    return block


def nearest_first(tree: Tree, probes: Probes, most: float, k: int) -> Best:
    """The k best rows of the tree for each probe."""
    n = len(probes.anchor)
    best = Best(n, k)
    square = (probes.v.astype(np.float64) ** 2).sum(1)
    slack = 1e-3 + 1e-6 * np.sqrt(square + most)
    radius = lambda score: np.sqrt(np.maximum(square + most - 2 * score.astype(np.float64), 0))
    inner = np.where(probes.hi >= MOST, 0, radius(probes.hi) * (1 - 1e-9) - slack)
    outer = lambda score: np.where(score <= LEAST, np.inf, radius(score) * (1 + 1e-9) + slack)
    least, greatest = tree.reach(np.hstack([probes.v.astype(np.float64), np.zeros((n, 1))]))
    widest = outer(np.maximum(probes.lo, probes.floor))
    key = np.where((greatest + slack[:, None] < inner[:, None]) | (least > widest[:, None]), np.inf, np.maximum(least, inner[:, None]))
    order = np.argsort(key, 1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    for step in range(0, order.shape[1], STEP):
        limit = np.minimum(widest, outer(best.score[:, -1]))
        next_ = key[:, step : step + STEP]
        probe, j = np.nonzero((next_ <= limit[:, None]) & np.isfinite(next_))
        if not len(probe):
            break
        leaf = order[probe, step + j]
        by = np.argsort(leaf, kind="stable")
        probe, leaf = probe[by], leaf[by]
        at = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        for a, b in zip(at, [*at[1:], len(leaf)]):
            rows, part = probe[a:b], slice(tree.edge[leaf[a]], tree.edge[leaf[a] + 1])
            best.add(rows, probes.scores(rows, tree.v[part], tree.labels[part], tree.ids[part]), tree.ids[part], probes.anchor[rows])
    return best


def _search(most: float, k: int, names: list[str]):
    def run(tree, block):
        probes = Probes(block)
        best = nearest_first(tree, probes, most, k)
        i, j = np.nonzero((best.score > LEAST) & (best.score >= probes.floor[:, None]))
        asked = block.take(pa.array(i)).select(names)
        yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(best.id[i, j]), pa.array(best.score[i, j])], names=[*names, "vec_id", "score"])

    return run


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """vectors(vec_id, label, v), anchors(the same) -> for each anchor and each of its first ``positives`` rows of the same label
    the first ``negatives`` rows of other labels whose score is at least 4/5 of the positive's and at most that."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vectors, anchors = (t.select("vec_id", "label", "v").where("vec_id IS NOT NULL AND label IS NOT NULL") for t in (vectors, anchors))
    usual = most_frequent_length(vectors)
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    rows = scratch.save(vectors.where(F.size("v") == usual).withColumn("label", F.col("label").cast("long")))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    most, n = rows.agg(F.max(square), F.count("*")).first()
    most = most * (1 + 1e-12) + 1
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).toPandas()
    sample = taken["vec_id"].to_numpy(np.int64), taken["label"].to_numpy(np.int64), np.array(taken["v"].tolist(), np.int64)
    full = rows_of_a_place(n, LEAF, spark)
    depth = max(0, min(n // full, len(taken) // CELL)).bit_length()
    top = Top(lift(sample[2], most), depth)

    def dealt(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(top.cells(lift(matrix(part.column(2)), most)).astype(np.int32))], names=[*part.schema.names, "cell"])

    celled = scratch.save(rows.mapInArrow(tidy(dealt), "vec_id long, label long, v array<long>, cell int"))
    index, places = places_of(celled, "cell", full)  # at most 2 ** depth cells
    index = scratch.save(index.select("place", "vec_id", "label", "v"))
    scratch.drop(celled)

    def build(t):
        return Tree(t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"].combine_chunks()), most)

    def found(probes, k, names):
        kinds = "".join(f"{c} long, " for c in names)
        return searched(index, places, probes, build, _search(most, k, names), kinds + "vec_id long, score long", ["vec_id", "label"], lambda b: with_floor(b, sample, k))

    asking = anchors.where(F.size("v") == usual).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("own")).select("anchor_id", "own.label", "own.v")
    asking = scratch.save(asking)
    window = lambda lo, hi, same: (F.lit(lo).cast("long").alias("lo") if isinstance(lo, int) else lo, F.lit(hi).cast("long").alias("hi") if isinstance(hi, int) else hi, F.lit(same).alias("same"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = found(asking.select("*", *window(LEAST + 1, MOST, True)), positives, ["anchor_id"])
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    near = scratch.save(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).distinct())
    # 80 p <= 100 s is s >= p - floor(p / 5)
    probes = near.where("positive_score >= 0").join(asking, "anchor_id")
    probes = probes.select("anchor_id", "positive_id", "positive_score", "label", "v", *window((F.col("positive_score") - F.floor(F.expr("positive_score div 5"))).alias("lo"), F.col("positive_score").alias("hi"), False))
    hard = found(probes, negatives, ["anchor_id", "positive_id", "positive_score"])
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
