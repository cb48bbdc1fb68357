"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features of a text: which hashed words, word pairs and pairs with one word between occur in it (a word is a run of
letters, digits and other non-ASCII characters, in lower case). The model learns on at most ``MAX_LABELLED`` labelled
documents, those of the smallest hashed doc_id; in FTRL-proximal every coordinate has its own learning rate and L1
keeps most weights at zero, so that only the few others are broadcast.

Results for odd rows: null and empty texts have no features and get the score of the bias; without any labelled row
every score is 0, and an empty table gives no rows; a null doc_id is scored like any other and isn't held out; of repeated
labels the largest counts, of labelled documents that repeat an id the smallest text; texts are whole, however long; rows
that repeat are scored alike; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chain, mix, ship, slices, tidy, utf8

BITS = 20
#: The most labelled documents that the classifier is fitted on.
MAX_LABELLED = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 10.0, 0.0, 5

MODEL = "kind int, at int, weight double"


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each occurrence, and the number of the text it is from."""
    data, offs = utf8(pc.utf8_lower(texts))
    w = Words(data, offs, "letters")
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    h = w.hash
    ids, docs = [h], [doc]
    for gap, salt in ((1, 11), (2, 13)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            ids.append(chain(h[:-gap], h[gap:])[same] ^ U64(salt))
            docs.append(doc[:-gap][same])
    return (mix(np.concatenate(ids)) >> U64(64 - BITS)).astype(np.int32), np.concatenate(docs)


def _rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            ids, docs = _features(part.column(0))
            both = np.unique(docs.astype(np.int64) << BITS | ids)
            cut = np.searchsorted(both, np.arange(part.num_rows + 1) << BITS)
            flat = (both & ((1 << BITS) - 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([lists, part.column(1), part.column(2)], names=["ids", "y", "place"])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in order, EPOCHS times; the bias has no penalty."""
    n = 1 << BITS
    z, s = np.zeros(n + 1), np.zeros(n + 1)
    rate = lambda i: (BETA + np.sqrt(s[i])) / ALPHA

    def weights(i):
        v = z[i]
        free = i == n
        cut = np.where(free, 0.0, L1)
        return np.where(np.abs(v) <= cut, 0.0, -(v - np.sign(v) * cut) / (rate(i) + np.where(free, 0.0, L2)))

    index = [np.append(r, n) for r in rows]
    for epoch in range(EPOCHS):
        for k in np.random.RandomState(epoch).permutation(len(rows)):
            i = index[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            step = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / ALPHA
            z[i] += g - step * w
            s[i] += g * g
    w = weights(np.arange(n + 1))
    return w[:n], float(w[n])


def _train(batches):
    rows, labels, places = [], [], []
    for b in batches:
        if b.num_rows:
            flat = b.column(0)
            values, cut = flat.flatten().to_numpy(), np.diff(flat.offsets.to_numpy())
            rows += np.split(values, np.cumsum(cut)[:-1])
            labels.append(b.column(1).to_numpy(zero_copy_only=False))
            places.append(b.column(2).to_numpy(zero_copy_only=False))
    if rows:
        order = np.argsort(np.concatenate(places), kind="stable")
        w, bias = fit([rows[i] for i in order], np.concatenate(labels)[order].astype(float))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.zeros(len(at), np.int32), np.int32(1))), pa.array(np.append(at, 0).astype(np.int32)), pa.array(np.append(w[at], bias))],
            names=["kind", "at", "weight"],
        )


def in_part(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids don't."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame):
    """The model (features' numbers, weights, bias) from documents whose id isn't held out; None without labels."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~in_part("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("doc_id", "y", F.xxhash64("doc_id").alias("place"))
    # at most MAX_LABELLED rows of three numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # repeated documents count once, so that the one task that fits, behind a shuffle, reads no more than these rows
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y", F.xxhash64("doc_id").alias("place"))
    model = rows.mapInArrow(tidy(_rows), "ids array<int>, y int, place long").repartition(1).mapInArrow(tidy(_train), MODEL).toPandas()
    if not len(model):
        return None
    w = model[model.kind == 0]
    return w["at"].to_numpy(np.int32), w["weight"].to_numpy(), float(model.weight[model.kind == 1].iloc[0])


def _scorer(model):
    """A function from a column of texts to their scores."""
    if model is None:
        return lambda texts: np.zeros(len(texts))
    at, w, bias = model
    dense = np.zeros(1 << BITS)
    dense[at] = w

    def scores(texts: pa.Array) -> np.ndarray:
        ids, docs = _features(texts)
        hot = np.flatnonzero(dense[ids])
        both = np.unique(docs[hot].astype(np.int64) << BITS | ids[hot])
        total = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], len(texts)) + bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    return scores


def _score(shared):
    def run(batches):
        scores = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                score = scores(part.column(part.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if part.schema.names[i] != "text"), pa.array(score)], names=[*(n for n in part.schema.names if n != "text"), "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(tidy(_score(shared)), "doc_id long, score double")
    return scored.select("doc_id", in_part("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    def run(batches):
        scores = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(scores(part.column(part.schema.get_field_index("text"))) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
