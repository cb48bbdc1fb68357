"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the positions that a fixed mask keeps, so it survives substitutions at the others.
Seeds of all benchmark items form a table; every position of every document is looked up under every mask. Each hit
gives an item and a diagonal (the shift between item and document), and on each hit diagonal the words are compared
one by one: the overlap is the run of at least ``MIN_WORDS`` words (the whole item where that is shorter) with the largest
sum of +1 for an equal and -4 for a different word, and it counts if the sum isn't negative: four fifths of it are equal.
The masks miss no such run: of words that are four fifths equal, four in a row are, or else 15 words have just their 4th,
8th and 12th different, which 1110111 fits; a shorter item has three equal words in a row, or is of five words with the
middle one different, which 11011 fits. Words are runs of letters, digits and other non-ASCII characters, in lower case.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, each broadcast in turn and held against all
documents; a usual benchmark is one block.

Items of fewer than ``least_item`` words (LEAST_ITEM) would mark every document with a common phrase and overlap nothing.

Results for odd rows: null and empty texts and items overlap nothing; empty tables give no rows (and no benchmark, no
overlaps); repeated rows give repeated results; a null doc_id is reported as null; texts are whole, however long; of overlaps
of one document and item that tie the first is reported; other columns are not read (``without_contaminated`` keeps them)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, ship, slices, tidy, utf8

MASKS = ("1110111", "1111")
#: Of items shorter than MIN_WORDS, besides.
SHORT_MASKS = ("111", "11011")
MIN_WORDS, EQUAL, DIFFERENT = 13, 1, -4
LEAST_ITEM = 5
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 22
#: Hits, and words of diagonals, that are held at once.
_PIECE = 1 << 21
FOUND = "doc_id long, item_id long, words_equal int, words_covered int, item_words int, word_start int, word_end int"


def _words(texts: pa.Array) -> Words:
    return Words(*utf8(pc.utf8_lower(texts)), "letters")


def _seeds(h: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) wherever the mask fits into one text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    fits = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    out = np.full(n, len(mask) * 131 + int(mask, 2), U64)
    for p, keep in enumerate(mask):
        if keep == "1":
            out = out * U64(0xD6E8FEB86659FD93) + h[p : p + n]
    return mix(out)[fits], fits


def _pieces(size: np.ndarray):
    """Slices of rows whose sizes sum up to about _PIECE (a larger row comes alone)."""
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PIECE, side="right")))
        yield slice(start, end)
        start = end


def _different(doc: np.ndarray, item: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((zero, item, doc))
    doc, item, zero = doc[order], item[order], zero[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (zero[1:] != zero[:-1])
    return doc[new], item[new], zero[new]


def best_runs(same: np.ndarray, first: np.ndarray, size: np.ndarray, need: int):
    """Of stretches of ``same`` (starts and sizes, ``need`` or more each) the run of at least ``need`` words with the largest sum,
    where that isn't negative: (number of the stretch, start, end, equal words)."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # stretches of about one length side by side, filled up with different words
        few = order[at : at + max(1, _PIECE // int(size[order[at]]))]
        few = few[size[few] <= 2 * size[few[0]]]
        at += len(few)
        width = int(size[few].max())
        place = np.arange(width)
        inside = place < size[few][:, None]
        equal = same[np.minimum(first[few][:, None] + place, len(same) - 1)] & inside
        total = np.zeros((len(few), width + 1), np.int32)
        np.cumsum(np.where(equal, EQUAL, DIFFERENT), axis=1, out=total[:, 1:])
        lowest = np.minimum.accumulate(total[:, : width + 1 - need], axis=1)
        score = total[:, need:] - lowest
        end = score.argmax(1)
        rows = np.flatnonzero(score[np.arange(len(few)), end] >= 0)
        start = (total[rows] == lowest[rows, end[rows]][:, None]).argmax(1)
        for k, a, b in zip(rows.tolist(), start.tolist(), (end[rows] + need).tolist()):
            yield int(few[k]), a, b, int(equal[k, a:b].sum())


class Index:
    """Seeds of a block of benchmark items. Short masks are used for items shorter than MIN_WORDS only."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, least_item: int = LEAST_ITEM):
        w = _words(texts)
        long = np.diff(w.first) >= least_item
        ids, w = ids[long], w if long.all() else _words(texts.filter(pa.array(long)))
        self.ids, self.first, self.hash = ids, w.first, w.hash
        size = np.diff(w.first)
        doc = np.repeat(np.arange(len(size)), size)
        seeds, places, masks = [], [], []
        for mask in MASKS + SHORT_MASKS:
            s, p = _seeds(w.hash, doc, mask)
            if mask in SHORT_MASKS:
                short = size[doc[p]] < MIN_WORDS
                s, p = s[short], p[short]
            seeds.append(s)
            places.append(p)
        for d in np.flatnonzero((size > 0) & (size < len(SHORT_MASKS[0]))):  # one or two words: looked up word by word
            seeds.append(w.hash[w.first[d] : w.first[d] + 1])
            places.append(w.first[d : d + 1])
        self.single = np.unique(np.concatenate(seeds[len(MASKS + SHORT_MASKS) :])) if len(seeds) > len(MASKS + SHORT_MASKS) else np.zeros(0, U64)
        seed, place = np.concatenate(seeds), np.concatenate(places)
        order = np.argsort(seed, kind="stable")
        self.seed, self.place = seed[order], place[order]
        self.item = doc[self.place] if len(doc) else self.place
        self.any = np.zeros(1 << _FILTER_BITS, bool)
        self.any[self.seed >> U64(64 - _FILTER_BITS)] = True
        self.short = bool((size < MIN_WORDS).any())

    def hits(self, seeds: np.ndarray, at: np.ndarray):
        """Yields (document position, item, item position) of equal seeds, about _PIECE at a time."""
        maybe = np.flatnonzero(self.any[seeds >> U64(64 - _FILTER_BITS)])
        lo, hi = np.searchsorted(self.seed, seeds[maybe]), np.searchsorted(self.seed, seeds[maybe], side="right")
        found = hi > lo
        lo, size, at = lo[found], (hi - lo)[found], at[maybe[found]]
        for part in _pieces(size):
            n = size[part]
            index = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(at[part], n), self.item[index], self.place[index]

    def diagonals(self, w: Words, doc: np.ndarray):
        """(text, item, where the item's first word would stand in the slice's words), different ones in order."""
        out = []
        looked_up = [_seeds(w.hash, doc, mask) for mask in (MASKS + SHORT_MASKS if self.short else MASKS)]
        if len(self.single):
            looked_up.append((w.hash, np.arange(len(w.hash))))
        for seeds, places in looked_up:
            for at, item, place in self.hits(seeds, places):
                out.append(_different(doc[at], item, at - (place - self.first[item])))
        return _different(*(np.concatenate(x) for x in zip(*out))) if out else (np.zeros(0, np.int64),) * 3

    def search(self, texts: pa.Array):
        """(text, item, equal, covered, item words, start, end) of overlaps; the longest of each text and item."""
        w = _words(texts)
        if not len(w.hash) or not len(self.seed):
            return []
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        d, i, zero = self.diagonals(w, doc)
        a, b = self.first[i], self.first[i + 1]
        lo, hi = np.maximum(zero, w.first[d]), np.minimum(zero + b - a, w.first[d + 1])
        need = np.minimum(MIN_WORDS, b - a)
        best: dict[tuple[int, int], tuple] = {}
        for part in _pieces(hi - lo):
            n = (hi - lo)[part]
            first = np.cumsum(n) - n
            at = np.repeat(lo[part] - first, n) + np.arange(n.sum())
            same = w.hash[at] == self.hash[at + np.repeat((a - zero)[part], n)]
            equal = np.add.reduceat(same, first, dtype=np.int64)
            # where too few words are equal for any run, as on most diagonals of a chance hit, none is looked for
            maybe = np.flatnonzero((n >= need[part]) & (-DIFFERENT * need[part] <= (EQUAL - DIFFERENT) * equal))
            for least in np.unique(need[part][maybe]).tolist():
                some = maybe[need[part][maybe] == least]
                for k, start, end, equals in best_runs(same, first[some], n[some], least):
                    j = part.start + int(some[k])
                    key = (int(d[j]), int(i[j]))
                    shift = int(lo[j] - w.first[d[j]])
                    if key not in best or (equals, -shift - start) > (best[key][0], -best[key][3]):
                        best[key] = (equals, end - start, int(b[j] - a[j]), shift + start, shift + end)
        return [(d, i, *v) for (d, i), v in best.items()]


def blocks(benchmark: DataFrame, least_item: int = LEAST_ITEM):
    """Indexes of the benchmark, one for each block of about BLOCK_WORDS words at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    letters = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-letters // (4 * BLOCK_WORDS)))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        t = own.toPandas()
        yield Index(t["item_id"].to_numpy(), pa.array(t["text"].tolist(), pa.string()), least_item)


def _found(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = index.search(part.column(1))
                if rows:
                    d, i, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([index.ids[x] for x in i], pa.int64(), from_pandas=True), *(pa.array(x, pa.int32()) for x in rest)], names=["doc_id", "item_id", "words_equal", "words_covered", "item_words", "word_start", "word_end"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least_item: int = LEAST_ITEM) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> FOUND: a row for each document and item that overlap."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in blocks(benchmark, least_item):
        own = plain.mapInArrow(tidy(_found(docs.sparkSession.sparkContext.broadcast(index))), FOUND)
        out = own if out is None else out.union(own)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns."""
    ship(docs.sparkSession)

    def keep(shared):
        def run(batches):
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for part in slices(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in shared.value.search(part.column(at))]] = False
                    yield part.filter(pa.array(clean))

        return run

    for index in blocks(benchmark, least_item):
        docs = docs.mapInArrow(tidy(keep(docs.sparkSession.sparkContext.broadcast(index))), docs.schema)
    return docs
