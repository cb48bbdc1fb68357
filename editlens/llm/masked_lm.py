"""Masked pseudo-likelihood scores: a bidirectional window network predicts every word from both sides.

The words of all documents are counted exactly. The VOCABULARY most frequent ones, and one leaf for all others, are the leaves
of a Huffman tree of their counts. The network adds an embedding for each of the RADIUS words on either side (by place; of
the vocabulary, else by hash) and applies tanh; every inner node of the tree has a vector that tells by a sigmoid which way
the hidden word lies, so that the probabilities of all words sum up to one. A word beyond the vocabulary has, behind
its leaf, its own exact share of the counts of such words, by a join with the counts. The log-probabilities of all words, each with
itself hidden, add up to the document's score.

Training covers every position of every document, ROUNDS times: documents are dealt by hash to shards of about SHARD_WORDS words,
a number that only the corpus decides; each shard trains a copy from the same start in numpy (Adagrad on minibatches), in the
order of the hashes, and the copies are averaged, weighted by words, through a tree of tasks. So neither the number of
tasks nor a lost executor changes the model (but for rounding), and what reaches the driver doesn't grow.

Results for odd rows: null and empty texts, and those without words, have 0 words, log-probability 0 and a null mean; an empty
table gives no rows; repeated rows are scored alike (but for rounding) and count as often as they are there; of words that tie in their count the
smaller hash comes first; texts are whole, however long; a null doc_id stays null; other columns are not read."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U64, Words, flat_gather, slices, tidy, utf8

VOCABULARY, SPARE, HIDDEN, RADIUS, BATCH, RATE = 8192, 1024, 16, 2, 8192, 0.1
OFFSETS = (*range(-RADIUS, 0), *range(1, RADIUS + 1))
#: Input numbers: words of the vocabulary, hashed others, and the edge of a text.
EDGE = VOCABULARY + SPARE
SHARD_WORDS, ROUNDS, FANIN = 4_000_000, 1, 16
#: Nodes at the top of the tree, which most steps pass, are computed for all positions by matrices.
TOP = 63


def words_of(texts: pa.Array) -> Words:
    return Words(*utf8(pc.utf8_lower(texts)), "letters")


def _count(batches):
    held, size = [], 0

    def merged():
        h, n = (np.concatenate(x) for x in zip(*held))
        values, place = np.unique(h, return_inverse=True)
        return values, np.bincount(place, n).astype(np.int64)

    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            values, n = np.unique(words_of(part.column(0)).hash, return_counts=True)
            held.append((values, n))
            size += len(values)
            if size > 1_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 700_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "n"])
                    held, size = [], 0
    if held:
        values, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["h", "n"])


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes and turns (-1, 1) on the way from the root to each leaf, one leaf after another, and offsets."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, turn = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y], turn[x], turn[y] = node, node, -1, 1
        heapq.heappush(heap, (a + b, node))
    nodes, turns, size = [], [], []
    for leaf in range(n):
        at, before = leaf, len(nodes)
        while at != 2 * n - 2:
            nodes.append(up[at] - n)
            turns.append(turn[at])
            at = up[at]
        size.append(len(nodes) - before)
    return np.array(nodes, np.int64), np.array(turns, np.float32), np.concatenate(([0], np.cumsum(size))).astype(np.int64)


class Lexicon:
    """Numbers of the most frequent words and the tree of their counts; the last leaf stands for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare: int):
        """hashes, counts: the vocabulary, most frequent first. rare: how often all other words occur."""
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], order
        self.leaves, self.rare = len(hashes) + 1, rare
        weights = np.append(counts, max(1, rare)).astype(float)
        self.nodes, self.turns, self.start = huffman(weights)
        # log-odds of the counts at each node, so that training starts from frequencies
        ways = np.zeros((2, max(1, self.leaves - 1)))
        leaf = np.repeat(np.arange(self.leaves), np.diff(self.start))
        np.add.at(ways, ((self.turns > 0).astype(int), self.nodes), weights[leaf])
        self.odds = np.log((ways[1] + 0.5) / (ways[0] + 0.5)).astype(np.float32)
        # steps at the top as a matrix of turns (0 where a way doesn't pass), the others as before
        self.top = np.sort(np.argsort(-ways.sum(0), kind="stable")[:TOP])
        at = np.full(len(self.odds), -1)
        at[self.top] = np.arange(len(self.top))
        high = at[self.nodes] >= 0
        self.top_turns = np.zeros((self.leaves, len(self.top)), np.float32)
        self.top_turns[leaf[high], at[self.nodes[high]]] = self.turns[high]
        self.passed_by = (self.top_turns == 0).sum(1)
        self.nodes, self.turns = self.nodes[~high], self.turns[~high]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(leaf[~high], minlength=self.leaves)))).astype(np.int64)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(input number, leaf) of each word."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        leaf = np.full(len(h), self.leaves - 1)
        number = VOCABULARY + (h >> U64(54)).astype(np.int64)
        if known.any():
            leaf[known] = number[known] = self.ranks[at[known]]
        return number, leaf


def lexicon(counts: DataFrame) -> Lexicon:
    """From counts(h, n) of all words."""
    top = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY).toPandas()
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Lexicon(top.h.to_numpy(np.int64).view(U64), top.n.to_numpy(np.int64), int(every - top.n.sum()))


class Network:
    """Hidden = tanh(bias + sum of place-wise embeddings); the score of a node = hidden . vector + base."""

    def __init__(self, words: Lexicon, start: np.ndarray | None = None):
        self.words = words
        inner = max(1, words.leaves - 1)
        self.shapes = ((len(OFFSETS), EDGE + 1, HIDDEN), (HIDDEN,), (inner, HIDDEN), (inner,))
        if start is None:
            rng = np.random.RandomState(5)
            self.parts = [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in self.shapes]
            self.parts[3][:] = words.odds
        else:
            cut = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
            self.parts = [x.reshape(s).copy() for x, s in zip(np.split(start, cut), self.shapes)]
        self.seen = [np.full(s, 1e-3, np.float32) for s in self.shapes]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        embed, bias, _, _ = self.parts
        out = embed[0][context[0]]
        for k in range(1, len(OFFSETS)):
            out += embed[k][context[k]]
        out += bias
        return np.tanh(out, out=out)

    def ways(self, leaf: np.ndarray):
        """Below the top: (position, node, turn) of every step to each position's leaf; positions that have steps, and where
        theirs start."""
        start = self.words.start
        size = start[leaf + 1] - start[leaf]
        at = flat_gather(start[leaf], size)
        low = np.flatnonzero(size)
        return np.repeat(np.arange(len(leaf)), size), self.words.nodes[at], self.words.turns[at], low, (np.cumsum(size) - size)[low]

    def top(self, hidden: np.ndarray, leaf: np.ndarray):
        """(turns, turns times scores) of the top's nodes for each position."""
        turns = self.words.top_turns[leaf]
        z = hidden @ self.parts[2][self.words.top].T
        z += self.parts[3][self.words.top]
        z *= turns
        return turns, z

    def log_prob(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        if self.words.leaves < 2:
            return np.zeros(len(leaf))
        hidden = self.hidden(context)
        _, z = self.top(hidden, leaf)
        # a node that isn't passed has turn 0 and log 2
        out = np.log(2) * self.words.passed_by[leaf] - np.log1p(np.exp(-np.maximum(z, -60))).sum(1)
        position, node, turn, low, first = self.ways(leaf)
        if len(low):
            score = np.einsum("ij,ij->i", hidden[position], self.parts[2][node]) + self.parts[3][node]
            out[low] -= np.add.reduceat(np.log1p(np.exp(-np.maximum(turn * score, -60))), first)
        return out

    def step(self, context: np.ndarray, leaf: np.ndarray) -> None:
        if self.words.leaves < 2:
            return
        _, _, vectors, base = self.parts
        top = self.words.top
        hidden = self.hidden(context)
        turns, z = self.top(hidden, leaf)
        turns /= 1 + np.exp(np.minimum(z, 60))
        turns /= np.float32(-len(leaf))
        back = turns @ vectors[top]
        grad, grad_base = np.zeros(vectors.shape, np.float32), np.zeros(len(base), np.float32)
        grad[top], grad_base[top] = turns.T @ hidden, turns.sum(0)
        position, node, turn, low, first = self.ways(leaf)
        if len(low):
            own, there = hidden[position], vectors[node]
            g = -turn / (1 + np.exp(np.minimum(turn * (np.einsum("ij,ij->i", own, there) + base[node]), 60))) / np.float32(len(leaf))
            there *= g[:, None]
            back[low] += np.add.reduceat(there, first, axis=0)
            own *= g[:, None]
            grad += _sums(node, own, len(base))
            grad_base += np.bincount(node, g, len(base))
        back *= 1 - hidden * hidden
        self._move(2, grad)
        self._move(3, grad_base)
        self._move(1, back.sum(0))
        for k in range(len(OFFSETS)):
            self._move(0, _sums(context[k], back, EDGE + 1), k)

    def _move(self, i: int, g: np.ndarray, k=slice(None)) -> None:
        g = g.astype(np.float32)
        self.seen[i][k] += g * g
        self.parts[i][k] -= RATE * g / np.sqrt(self.seen[i][k])


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their number."""
    width = rows.shape[1]
    index = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(index, rows.ravel(), size * width).reshape(size, width)


def contexts(w: Words, number: np.ndarray) -> np.ndarray:
    """For each place around a word the input number there, EDGE outside the text."""
    n = len(number)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    out = np.full((len(OFFSETS), n), EDGE)
    for k, o in enumerate(OFFSETS):
        a, b = max(0, -o), min(n, n - o)
        if b > a:
            out[k, a:b] = np.where(doc[a:b] == doc[a + o : b + o], number[a + o : b + o], EDGE)
    return out


def _train(shared):
    """(shard, text) sorted by shard -> the sum of the weights of all shards here, each by its words."""

    def run(batches):
        words, start = shared.value
        net, shard, seen, total, sums = None, None, 0, 0, None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist()] if len(ids) else []:
                own = batch.slice(at, int(np.searchsorted(ids, ids[at], side="right")) - at)
                if ids[at] != shard:
                    if seen:
                        total, sums = total + seen, net.flat().astype(np.float64) * seen + (0 if sums is None else sums)
                    net, shard, seen = Network(words, start), ids[at], 0
                for part in slices(own, "text"):
                    w = words_of(part.column(1))
                    number, leaf = words.look_up(w.hash)
                    context = contexts(w, number)
                    for a in range(0, len(leaf), BATCH):
                        net.step(context[:, a : a + BATCH], leaf[a : a + BATCH])
                    seen += len(leaf)
        if seen:
            total, sums = total + seen, net.flat().astype(np.float64) * seen + (0 if sums is None else sums)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

    return run


def _average(batches):
    n, total = 0, None
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * k
            n, total = n + k, own if total is None else total + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])


def train(docs: DataFrame, words: Lexicon, n_words: int) -> np.ndarray:
    """The averaged weights after ROUNDS passes over all of docs(doc_id, text)."""
    weights = Network(words).flat()
    shards = max(1, -(-n_words // SHARD_WORDS))
    mark = F.xxhash64("text", "doc_id")
    dealt = docs.select(F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"), "text").repartition("shard").sortWithinPartitions("shard", "mark").select("shard", "text")
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((words, weights))
        copies, tasks = dealt.mapInArrow(tidy(_train(shared)), "n long, weights binary"), shards
        while tasks > FANIN:
            tasks = -(-tasks // FANIN)
            copies = copies.repartition(tasks).mapInArrow(tidy(_average), "n long, weights binary")
        got = copies.toPandas()
        if len(got):
            n = got.n.to_numpy(float)
            weights = (np.stack([np.frombuffer(x, np.float32) for x in got.weights]) * (n / n.sum())[:, None]).sum(0).astype(np.float32)
    return weights


_SCORED = "doc_id long, mark long, n_words long, log_prob double"


def _score(shared):
    def run(batches):
        words, weights = shared.value
        net = Network(words, weights)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column(2))
                number, leaf = words.look_up(w.hash)
                context = contexts(w, number)
                log = np.zeros(len(leaf))
                for a in range(0, len(leaf), BATCH):
                    log[a : a + BATCH] = net.log_prob(context[:, a : a + BATCH], leaf[a : a + BATCH])
                total = np.concatenate(([0.0], np.cumsum(log)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]])], names=["doc_id", "mark", "n_words", "log_prob"])

    return run


def _rare(shared):
    """(mark, text) -> (mark, h, n): how often a text has each word beyond the vocabulary."""

    def run(batches):
        words = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column(1))
                _, leaf = words.look_up(w.hash)
                at = np.flatnonzero(leaf == words.leaves - 1)
                doc = np.repeat(np.arange(part.num_rows), np.diff(w.first))[at]
                order = np.lexsort((w.hash[at], doc))
                h, doc = w.hash[at][order], doc[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[new])), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h))))], names=["mark", "h", "n"])

    return run


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, log_prob, mean_log_prob); the model is trained on docs itself."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    texts = plain.where("text is not null")
    counts = scratch.save(texts.select("text").mapInArrow(tidy(_count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    words = lexicon(counts)
    n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((words, train(texts, words, n_words)))
    scored = plain.mapInArrow(tidy(_score(shared)), _SCORED)
    # words beyond the vocabulary have their own shares; texts that repeat bring them as often, and are counted
    found = texts.select("mark", "text").mapInArrow(tidy(_rare(spark.sparkContext.broadcast(words))), "mark long, h long, n long")
    share = F.log(F.col("count") / F.lit(float(max(1, words.rare))))
    logs = found.join(counts.withColumnRenamed("n", "count"), "h").groupBy("mark").agg(F.sum(F.col("n") * share).alias("logs"))
    logs = logs.join(texts.groupBy("mark").agg(F.count("*").alias("copies")), "mark").select("mark", (F.col("logs") / F.col("copies")).alias("logs"))
    whole = scored.join(logs, "mark", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("logs", F.lit(0.0)))
    return whole.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))
