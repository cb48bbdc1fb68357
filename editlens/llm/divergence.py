"""How the words of a source differ from those of the other sources of its language: a sort-based streaming audit.

1. A task sorts the terms of a slice of texts by (lang, term, source, document); the runs give occurrences and documents for
   each (lang, term, source). A document lies in one slice, so documents can be added, and a task adds the runs of its slices as
   far as ROWS of them, before anything is shuffled: a frequent term sends a row for each task and source, not for each document.
2. These rows are dealt by (lang, term) and sorted by (lang, term, source). A scan of the runs adds them up, holding one term's
   sources, and keeps terms of ``least`` documents: (lang, term, source, n).
3. With the sums of the groups (lang, source) beside them, the kept rows are dealt and sorted the same way again. Each run gives
   the terms that a source has more of than its language, and partial sums for pairs of sources that both have the term.
4. The divergence of a pair is a sum over all kept terms, also those that one of both or neither has. With p0 for a term that
   a source hasn't, the sum of f(p, q) over the terms is
   V f(p0, q0) + sum of f(p, q0) - f(p0, q0) over terms of the one + sum of f(p0, q) - f(p0, q0) over those of the other
   + sum of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) over those of both.
   The second and third depend on a source's counts alone, so how often each count occurs is enough; the fourth comes from
   the runs. Nothing is made for terms times pairs of sources.

All arithmetic is in integers: shares in billionths by long division, sums of pairs in decimals of 38 digits.

Results for odd rows: null text, lang and source count as ''; empty texts and those without a letter have no terms, but their
group takes part; every row is a document of its own, repeated rows and ids too; a language without kept terms has pairs of value
0 and no terms; a language of one source has no pairs; ties go to the item that is smaller in UTF-8; an empty table gives no
rows; texts are whole, however long; other columns aren't read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, flat_gather, slices, tidy, utf8

LEAST, TOP, BILLION = 3, 200, 1_000_000_000
#: Rows of runs that a task adds up before it sends them on, and pairs of sources that are worked on at once.
ROWS, PAIRS = 400_000, 1_000_000

_RUN = "lang string, term string, source string, docs long, n long"
_KEPT = "lang string, term string, source string, n long, head int"
_FOUND = "lang string, source string, part string, item string, value long"


def _arrow(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def term_runs(part: pa.RecordBatch) -> pa.Table:
    """(lang, text, source) of some documents -> (lang, term, source, docs, n), by runs of (lang, term, source, document)."""
    data, offs = utf8(part.column(1))
    words = Words(data, offs, "terms")
    if not len(words.hash):
        return _arrow(_RUN).empty_table()
    spelling = _lower(data)
    seen, first, term = np.unique(words.hash, return_index=True, return_inverse=True)
    size = words.end - words.start
    if (size != size[first[term]]).any() or (spelling[flat_gather(words.start, size)] != spelling[flat_gather(words.start[first[term]], size)]).any():
        raw = spelling.tobytes()  # a hash stands for two terms
        own = np.array([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())], object)
        seen, first, term = np.unique(own, return_index=True, return_inverse=True)
    (lang, langs), (source, sources) = _codes(part.column(0)), _codes(part.column(2))
    doc = np.repeat(np.arange(part.num_rows), np.diff(words.first))
    key, n = np.unique(((lang[doc] * len(seen) + term) * len(sources) + source[doc]) * part.num_rows + doc, return_counts=True)
    group = key // part.num_rows
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    docs, n, group = np.diff(np.append(at, len(group))), np.add.reduceat(n, at), group[at]
    term = group // len(sources) % len(seen)
    start, width = words.start[first[term]], size[first[term]]
    names = pa.StringArray.from_buffers(len(term), pa.py_buffer(np.concatenate(([0], np.cumsum(width))).astype(np.int32).tobytes()), pa.py_buffer(spelling[flat_gather(start, width)].tobytes()))
    return pa.table([langs.take(pa.array(group // len(sources) // len(seen))), names, sources.take(pa.array(group % len(sources))), pa.array(docs), pa.array(n)], schema=_arrow(_RUN))


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _added(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("docs", "sum"), ("n", "sum")])
    return whole.rename_columns({"docs_sum": "docs", "n_sum": "n"}).select(["lang", "term", "source", "docs", "n"])


def _runs(batches):
    held, rows = [], 0
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            held.append(term_runs(part))
            rows += len(held[-1])
            if rows > ROWS:
                held = [_added(held)]
                rows = len(held[0])
                if rows > ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _added(held).to_batches()


def _breaks(columns: list[pa.Array]) -> np.ndarray:
    """Where rows begin that differ from the one before in a column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole(batches, keys: list[str], shorten=lambda t: t):
    """Tables of sorted rows that hold all rows of each key. ``shorten`` works on the rows that wait for more."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now.cast(held.schema)]).combine_chunks()
        cut = int(_breaks([_one(now[k]) for k in keys])[-1])
        if cut:
            yield now.slice(0, cut)
        held = shorten(now.slice(cut))
    if held is not None:
        yield held


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _by_source(t: pa.Table) -> pa.Table:
    """Rows of (lang, term, source) added up."""
    at = _breaks([_one(t[k]) for k in ("lang", "term", "source")])
    sums = [pa.array(np.add.reduceat(t[k].to_numpy(), at)) for k in ("docs", "n")]
    return pa.table([*(t[k].take(pa.array(at)) for k in ("lang", "term", "source")), *sums], schema=t.schema)


def _kept(least: int):
    """Sorted runs -> the rows of terms of at least so many documents; ``head`` is 1 at the first row of a term."""

    def run(batches):
        for t in _whole(batches, ["lang", "term"], _by_source):
            t = _by_source(t)
            at = _breaks([_one(t["lang"]), _one(t["term"])])
            docs = np.add.reduceat(t["docs"].to_numpy(), at)
            head = np.zeros(len(t), np.int32)
            head[at] = 1
            keep = np.repeat(docs >= least, np.diff(np.append(at, len(t))))
            out = pa.table([t["lang"], t["term"], t["source"], t["n"], pa.array(head)], schema=_arrow(_KEPT))
            yield from out.filter(pa.array(keep)).to_batches()

    return run


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / whole), exact as far as a thousand times ``whole`` has 63 bits."""
    out, rest = count // whole, count % whole
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _found(batches):
    """Sorted (lang, term, source, n, total, terms, lang_total) -> what the terms of a source and pairs of sources gather from runs."""
    for t in _whole(batches, ["lang", "term"]):
        (lang, langs), (source, sources) = (_codes(_one(t[k])) for k in ("lang", "source"))
        n, total, terms, lang_total = (t[k].to_numpy() for k in ("n", "total", "terms", "lang_total"))
        at = _breaks([_one(t["lang"]), _one(t["term"])])
        size = np.diff(np.append(at, len(t)))
        p, p0 = shares(n + 1, total + terms), shares(np.ones_like(n), total + terms)
        q = shares(np.repeat(np.add.reduceat(n, at), size) + 1, lang_total + terms)
        more = np.flatnonzero(p > q)
        yield _out(t["lang"].take(pa.array(more)), t["source"].take(pa.array(more)), "term", t["term"].take(pa.array(more)), distances(p, q)[more])
        much = np.cumsum(size * size)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(much, (much[first - 1] if first else 0) + PAIRS, side="right")))
            k, start = size[first:last], at[first:last]
            rows = flat_gather(start, k)
            a, b = np.repeat(rows, np.repeat(k, k)), flat_gather(np.repeat(start, k), np.repeat(k, k))
            apart = a != b
            a, b = a[apart], b[apart]
            value = distances(p[a], p[b]) - distances(p[a], p0[b]) - distances(p0[a], p[b]) + distances(p0[a], p0[b])
            pair, which = np.unique((lang[a] * len(sources) + source[a]) * len(sources) + source[b], return_inverse=True)
            gathered = np.zeros(len(pair), np.int64)
            np.add.at(gathered, which, value)
            group = pair // len(sources)
            yield _out(langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), "pair", sources.take(pa.array(pair % len(sources))), gathered)
            first = last


def _out(lang, source, part: str, item, value) -> pa.RecordBatch:
    flat = [_one(c) if isinstance(c, pa.ChunkedArray) else c for c in (lang, source, item)]
    return pa.RecordBatch.from_arrays([flat[0], flat[1], pa.array([part] * len(value), pa.string()), flat[2], pa.array(value)], schema=_arrow(_FOUND))


def _share(count: str, whole: str) -> str:
    return f"(1 + (CAST({count} AS DECIMAL(20, 0)) * 1000000000) div ({whole}))"


def _distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, part, item, value, rank).

    part ``pair``: the divergence of a source from each other of its language; part ``term``: the ``top`` terms that it has more
    of than its language."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = docs.select(text("lang"), text("text"), text("source"))
    runs = plain.mapInArrow(tidy(_runs), _RUN).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = scratch.save(runs.mapInArrow(tidy(_kept(least)), _KEPT))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    groups = plain.groupBy("lang", "source").agg(F.lit(1).alias("there")).join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("heads", F.lit(0)).alias("heads"))
    of = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"))
    groups = scratch.save(groups.drop("heads").join(of, "lang"))
    rows = kept.drop("head").join(groups, ["lang", "source"])
    rows = rows.select("lang", "term", "source", "n", "total", "terms", "lang_total").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = scratch.save(rows.mapInArrow(tidy(_found), _FOUND))
    # what pairs gather from each source's counts alone, and from terms that neither has
    other = groups.select("lang", F.col("source").alias("item"), F.expr(_share("1", "total + terms")).alias("q0")).where("terms > 0")
    none = groups.where("terms > 0").withColumn("p0", F.expr(_share("1", "total + terms")))
    both = none.join(other, "lang").where("source != item")
    base = both.select("lang", "source", "item", F.expr(f"terms * {_distance('p0', 'q0')}").cast("decimal(38,0)").alias("value"))
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("often"))
    alone = counts.join(none, ["lang", "source"]).withColumn("p", F.expr(_share("n + 1", "total + terms"))).join(other, "lang").where("source != item")
    often = lambda e: F.expr(f"CAST(often AS DECIMAL(20, 0)) * ({e})").cast("decimal(38,0)").alias("value")
    one = alone.select("lang", "source", "item", often(f"{_distance('p', 'q0')} - {_distance('p0', 'q0')}"))
    two = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), often(f"{_distance('q0', 'p')} - {_distance('q0', 'p0')}"))
    three = found.where("part = 'pair'").select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    zero = groups.select("lang", "source", "terms").join(groups.select("lang", F.col("source").alias("item")), "lang").where("terms = 0 AND source != item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    pairs = base.union(one).union(two).union(three).union(zero).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = ranked(found.where("part = 'term'").select("lang", "source", "item", "value"), "term").where(F.col("rank") <= top)
    return ranked(pairs, "pair").union(terms)
