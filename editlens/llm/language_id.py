"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and all that isn't a letter becomes one blank; n-grams of one to ORDERS characters are hashed
to 2**BITS buckets. Counts are exact over all learning documents: each task counts in numpy, Spark adds the counts,
and the matrix of log-probabilities (languages x buckets) is broadcast, LANGUAGES of them (16 MB) at a time: a table of more
languages is scored block by block, and each text carries its best language and its sum of probabilities on.

Results for odd rows: a null text, and one without a letter, is ``und`` with score 0; so is every text when nothing
could be learned; rows with a null lang teach nothing; a null doc_id is predicted and teaches; an empty table gives no rows;
texts are whole, however long; repeated rows teach and are predicted each for itself; of languages that tie the first in order
is taken; extra columns are not read."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U64, mix, slices, tidy, utf8
from .toxicity import in_part

BITS, ORDERS, ALPHA, LANGUAGES = 15, 3, 0.5, 64


@functools.lru_cache(None)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each n-gram; the number of letters of each text."""
    data, offs = utf8(pc.utf8_lower(texts))
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    # Lower-casing may change byte lengths; offsets count characters from here on
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(n), np.diff(heads[offs]))
    letter = _letters()[code]
    letters = np.bincount(doc[letter], minlength=n)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    code, doc = np.where(letter, code, 0)[keep].astype(U64), doc[keep]
    ids, docs = [], []
    h = np.zeros(len(code), U64)
    for k in range(ORDERS):
        if len(code) <= k:
            break
        h = h[: len(code) - k] * U64(0x110001) + code[k:] + U64(1)
        whole = doc[: len(code) - k] == doc[k:]
        if k == 0:
            whole = whole & (code != 0)
        ids.append((mix(h[whole] + U64(k << 62)) >> U64(64 - BITS)).astype(np.int64))
        docs.append(doc[: len(code) - k][whole])
    return np.concatenate(ids), np.concatenate(docs), letters


def _count(batches):
    """(lang, text) -> (lang, bucket, n): counts of the whole task; bucket -1 has the number of texts."""
    total: dict[str, np.ndarray] = {}

    def rows():
        for name, own in total.items():
            at = np.flatnonzero(own)
            bucket = np.where(at == 1 << BITS, -1, at)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, docs, _ = ngrams(part.column(1))
            texts = np.bincount(code, minlength=len(names))
            order = np.argsort(code[docs], kind="stable")
            ids, cut = ids[order], np.searchsorted(code[docs][order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                if name not in total and len(total) >= LANGUAGES:
                    yield from rows()
                own = total.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                own[:-1] += np.bincount(ids[cut[k] : cut[k + 1]], minlength=1 << BITS)
                own[-1] += texts[k]
    yield from rows()


def learn(docs: DataFrame, scratch: Scratch):
    """Yields (languages, log-probabilities, log-priors, whether they are the last) from docs(lang, text), at most LANGUAGES in
    order at a time."""
    known = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = scratch.save(known.mapInArrow(tidy(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = counts.where("bucket = -1").orderBy("lang").select("lang", "n").toPandas()  # a row for each language
    every = texts.n.sum()
    for start in range(0, len(texts), LANGUAGES):
        some = texts.iloc[start : start + LANGUAGES]
        names = some.lang.tolist()
        number = F.element_at(F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i)))), F.col("lang"))
        own = counts.where((F.col("bucket") >= 0) & F.col("lang").between(names[0], names[-1])).select(number.alias("k"), "bucket", "n").toPandas()
        table = np.zeros((len(names), 1 << BITS))
        table[own.k.to_numpy(np.int64), own.bucket.to_numpy()] = own.n.to_numpy()
        log = np.log(table + ALPHA) - np.log(table.sum(1, keepdims=True) + ALPHA * (1 << BITS))
        yield names, np.ascontiguousarray(log.T), np.log(some.n.to_numpy() / every), start + LANGUAGES >= len(texts)


def _score(shared):
    """Rows with the best language so far and its log-probability, and the log of the sum of all, after these languages too."""

    def run(batches):
        names, log, prior, last = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids, docs, letters = ngrams(part.column(part.schema.get_field_index("text")))
                total = np.stack([np.bincount(docs, log[:, k][ids], part.num_rows) for k in range(len(names))], 1) + prior
                at = total.argmax(1)
                top = total[np.arange(len(at)), at]
                sums = top + np.log(np.exp(total - top[:, None]).sum(1))
                top = np.where(letters > 0, top, -np.inf)
                best = part.column(part.schema.get_field_index("best")).to_numpy()
                whole = np.logaddexp(part.column(part.schema.get_field_index("whole")).to_numpy(), sums)
                better = top > best  # of equals the first
                before = part.column(part.schema.get_field_index("lang_pred")).to_pylist()
                lang = [names[k] if b else x for k, b, x in zip(at, better, before)]
                columns = {"best": pa.array(np.where(better, top, best)), "whole": pa.array(whole), "lang_pred": pa.array(lang, pa.string())}
                kept = [n for n in part.schema.names if n != "text" or not last]
                yield pa.RecordBatch.from_arrays([columns.get(n, part.column(part.schema.get_field_index(n))) for n in kept], names=kept)

    return run


def language_id(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, held_out, lang_pred, score); learns on documents that aren't held out."""
    out, spark = in_part("doc_id", parts, held_out), docs.sparkSession
    low = F.lit(float("-inf"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("und").alias("lang_pred"), low.alias("best"), low.alias("whole"))
    for model in learn(docs.where(~out), Scratch(spark)):
        text = "" if model[-1] else "text string, "
        rows = rows.mapInArrow(tidy(_score(spark.sparkContext.broadcast(model))), f"doc_id long, {text}lang_pred string, best double, whole double")
    score = F.when(F.col("best") == float("-inf"), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("whole"))))
    return rows.select("doc_id", out.alias("held_out"), "lang_pred", score.alias("score"))
