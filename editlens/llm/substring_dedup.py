"""Substring deduplication by content-defined chunking with a gear rolling hash.

The hash of the last 16 bytes, h = (h << 2) + G[byte] in 32 bits, ends a chunk wherever it is among the smallest
1/RATE of all values and no such place lies among the QUIET bytes before (where the 16 bytes hold DENSE blanks or more, so that
words are short, borders are closer), so chunk borders move with their content and an insertion upsets only the chunks around it. A chunk that would be longer than MOST bytes (as in texts that go on repeating
themselves) ends at the last place of the smallest hash within them. Chunks are compared by 64-bit digests. A chunk is repeated when a document of
a smaller id has it, and votes for the place where one has it: a document and the shift between both. Where both have it several
times (texts that go on repeating themselves), the first votes for the first, the second for the second, so that all vote for one shift; if the
other has it fewer times, m, each m do so, and the last m for the last m. Where it comes OFTEN, the first of all votes for the second and
the last for the one before its own, as what repeats may begin or end before its chunks do. Neighbouring
repeated chunks form runs. For each place that chunks of a run vote for, both documents' bytes are compared from REACH
before its first vote to REACH after its last (CONTEXT beyond the run at most), so that a chunk within a passage may vote
for another place; where the equal bytes go on to the end of what was compared (FOLLOWED of them or more), twice as much is
compared, again and again; places of the same two texts and shift that overlap by then are compared as one. Stretches of equal bytes, cut back to words that are whole in both documents, are passages if they have
``min_words`` words: each stands in one piece in its ``first_doc_id``. Passages within others aren't reported.

Before the shuffle by digest a slice of texts keeps one document's rows of each digest; the others' rows, known to be
repeated, bypass it (they are dealt by their own place). So a chunk that many documents share sends a row for each
slice, not for each document. Texts move compressed, and only contexts of runs move further.

Rows of one doc_id with different texts are told apart by their texts' hashes (``row``), so each is cut by its own passages.

Results for odd rows: null and empty texts and rows with a null doc_id repeat nothing and stay as they are; repeats within
one document, and between rows of the same doc_id, don't count; rows that repeat id and text are cut alike; of several documents that have a passage (ties included) the
smallest id keeps it; an empty table gives no rows; texts are whole, however long; a document of which no word is left is
dropped by ``without_repeats``; other columns are kept by it and not read here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_kinds, fresh, slices, span_hash, tidy, utf8

RATE, QUIET, WINDOW, MOST = 24, 7, 16, 96
#: Blanks within WINDOW bytes from which on words count as short, and RATE and QUIET there.
DENSE, DENSE_RATE, DENSE_QUIET = 5, 6, 4
#: A run of whole chunks must cover so many bytes or word starts to be looked at; bytes compared beyond a run and beyond votes.
LEAST_RUN, LEAST_STARTS, CONTEXT, REACH = 64, 8, 256, 512
#: From so many places of a chunk on in both texts, what repeats is looked for a chunk earlier and later too.
OFTEN = 8
#: Places of a document that one row gathers.
PLACES = 1000
#: Equal bytes at an edge of what was compared that are followed beyond it.
FOLLOWED = 8
#: Ids that may be broadcast.
FEW_IDS = 1_000_000
MIN_WORDS = 50

_GEAR = np.random.RandomState(31).randint(0, 1 << 32, 256, np.int64).astype(np.uint32)


_APART = byte_kinds("exact")[1]


def word_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many words begin before each byte of consecutive texts, and in all."""
    begins = ~_APART[data]
    begins[1:] &= _APART[data[:-1]]
    first = offs[:-1][offs[:-1] < offs[1:]]
    begins[first] = ~_APART[data[first]]
    return np.concatenate(([0], np.cumsum(begins)))


def chunk_ends(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the chunks of consecutive texts, ascending."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        later = h.copy()
        later[width:] += h[:-width] << np.uint32(2 * width)
        h = later
    blanks = np.cumsum(_APART[data])
    blanks[WINDOW:] -= blanks[:-WINDOW].copy()
    dense = blanks >= DENSE
    cut = h < np.where(dense, np.uint32((1 << 32) // DENSE_RATE), np.uint32((1 << 32) // RATE))
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    cut &= place >= WINDOW - 1
    at = np.flatnonzero(cut)
    last = np.concatenate(([-QUIET - 1], at[:-1])) if len(at) else at
    at = at[(at - last > np.where(dense[at], DENSE_QUIET, QUIET)) | (place[at] - (at - last) < 0)]
    ends = np.union1d(at + 1, offs[1:][offs[1:] > offs[:-1]])
    starts = np.concatenate(([0], ends[:-1]))
    more = []
    for k in np.flatnonzero(ends - starts > MOST):
        s = int(starts[k])
        while ends[k] - s > MOST:
            window = h[s + WINDOW - 1 : s + MOST]
            s += WINDOW + len(window) - 1 - int(window[::-1].argmin())
            more.append(s)
    return np.union1d(ends, np.array(more, np.int64)) if more else ends


def votes(digest: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The row that each of rows sorted by (digest, doc, row, pos) votes for: one of the first text that has its digest."""

    def begins(*columns):
        return np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))

    places = begins(digest, doc, row, pos)  # rows that repeat id and text count once
    at = np.flatnonzero(places)
    kinds, texts = begins(digest[at]), begins(digest[at], doc[at], row[at])
    start = np.flatnonzero(texts)
    size, text = np.diff(np.append(start, len(at))), np.cumsum(texts) - 1
    lead = text[kinds][np.cumsum(kinds) - 1]
    nth, all_, there = np.arange(len(at)) - start[text], size[text], size[lead]
    vote = np.where(nth < all_ - there, nth % there, nth - np.maximum(all_ - there, 0))
    vote += np.where(np.minimum(all_, there) < OFTEN, 0, (nth == 0).astype(np.int64) - (nth == all_ - 1))
    vote += start[lead]
    return at[vote][np.cumsum(places) - 1]


_CHUNK = "route long, digest long, doc long, row long, pos int, len int, starts int, ref_doc long, ref_row long, ref_pos int"


def _chunks(batches):
    """(doc, text, row) -> the chunks of texts."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            data, offs = utf8(part.column(1))
            if not len(data):
                continue
            end = chunk_ends(data, offs)
            start = np.concatenate(([0], end[:-1]))
            at = np.searchsorted(offs, start, side="right") - 1
            digest = span_hash(data, start, end).view(np.int64)
            begun = word_starts(data, offs)
            doc, row = part.column(0).to_numpy()[at], part.column(2).to_numpy()[at]
            pos, size, starts = (start - offs[at]).astype(np.int32), (end - start).astype(np.int32), (begun[end] - begun[start]).astype(np.int32)
            order = np.lexsort((pos, row, doc, digest))
            digest, doc, row, pos, size, starts = (x[order] for x in (digest, doc, row, pos, size, starts))
            vote = votes(digest, doc, row, pos)
            known = doc != doc[vote]
            own = (doc * np.int64(0x9E3779B97F4A7C1 | 1)) ^ (pos.astype(np.int64) * np.int64(0x632BE59BD9B4E019 | 1))
            route = np.where(known, own, digest)
            ref = [pa.array(x[vote], mask=~known) for x in (doc, row, pos)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (route, digest, doc, row, pos, size, starts)), *ref], names=[x.split()[0] for x in _CHUNK.split(", ")])


_REPEATED = "doc long, row long, pos int, len int, starts int, ref_doc long, ref_row long, ref_pos int"


def _repeated(batches):
    """Rows sorted by (digest, doc, row, pos): those that a smaller document has too, with a place where it stands."""
    held, first = None, None  # rows of the last text and digest; digest, doc, row, pos of the first text that has the last digest

    def out(t):
        nonlocal first
        names = _CHUNK.split(", ")
        at = {x.split()[0]: t.column(i) for i, x in enumerate(names)}
        known = at["ref_doc"].is_valid().to_numpy(zero_copy_only=False)
        ref = [at[c].fill_null(0).to_numpy().copy() for c in ("ref_doc", "ref_row", "ref_pos")]
        open_, keep = np.flatnonzero(~known), known.copy()
        if len(open_):
            own = [at[c].to_numpy()[open_] for c in ("digest", "doc", "row", "pos")]
            before = len(first[0]) if first and first[0][0] == own[0][0] else 0
            if before:
                own = [np.concatenate(x) for x in zip(first, own)]
            vote = votes(*own)
            for r, x in zip(ref, own[1:]):
                r[open_] = x[vote][before:]
            keep[open_] = ref[0][open_] != own[1][before:]
            a = int(np.searchsorted(own[0] == own[0][-1], True)) if own[0][0] != own[0][-1] else 0
            b = a + int(np.count_nonzero((own[1][a:] == own[1][a]) & (own[2][a:] == own[2][a])))
            first = [x[a:b].copy() for x in own]
        kept = [*(at[c] for c in ("doc", "row", "pos", "len", "starts")), *map(pa.array, ref)]
        return pa.RecordBatch.from_arrays(kept, names=[x.split()[0] for x in _REPEATED.split(", ")]).filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.select([x.split()[0] for x in _CHUNK.split(", ")])
        if held is not None:
            t = pa.concat_batches([held, t])
        own = [t.column(i).to_numpy() for i in (1, 2, 3)]
        breaks = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in own])) + 1
        cut = int(breaks[-1]) if len(breaks) else 0
        held = t.slice(cut)
        if cut:
            yield out(t.slice(0, cut))
    if held is not None:
        yield out(held)


_PLACE = "doc long, row long, start int, end int, ref_doc long, ref_row long, ref_start int"
_BLANK = b" \t\n\x0b\x0c\r"


def _batch(columns, spec: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, kinds = zip(*(x.split() for x in spec.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns or [()] * len(names), kinds)], names=names)


def _places(batches):
    """Rows sorted by (doc, row, pos) -> the places that long enough runs of neighbouring chunks vote for."""
    held = None

    def out(doc, row, pos, size, starts, ref, ref_row, place):
        end, shift = pos + size, place - pos
        run = np.cumsum(np.concatenate(([False], _parted(doc, row, pos, end))))
        first, last = np.searchsorted(run, np.arange(run[-1] + 1)), np.searchsorted(run, np.arange(run[-1] + 1), side="right") - 1
        from_, to = pos[first], end[last]
        words = np.add.reduceat(starts, first)
        long = np.flatnonzero(((to - from_ >= LEAST_RUN) | (words >= LEAST_STARTS))[run])
        if not len(long):
            return _batch(None, _PLACE)
        order = long[np.lexsort((pos[long], shift[long], ref_row[long], ref[long], run[long]))]
        r, d, e, s = run[order], ref[order], ref_row[order], shift[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (s[1:] != s[:-1])))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(order)) - 1
        start = np.maximum(pos[order[a]] - REACH, from_[r[a]] - CONTEXT)
        start = np.maximum(start, np.maximum(0, -s[a]))  # both texts begin at 0
        stop = np.minimum(end[order[b]] + REACH, to[r[a]] + CONTEXT)
        return _batch((doc[order[a]], row[order[a]], start.astype(np.int32), stop.astype(np.int32), d[a], e[a], (start + s[a]).astype(np.int32)), _PLACE)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = [c.to_numpy().astype(np.int64) for c in batch.columns]
        if held is not None:
            t = [np.concatenate(x) for x in zip(held, t)]
        breaks = np.flatnonzero(_parted(t[0], t[1], t[2], t[2] + t[3])) + 1
        cut = int(breaks[-1]) if len(breaks) else 0
        held = [x[cut:] for x in t]
        if cut:
            yield out(*(x[:cut] for x in t))
    if held is not None:
        yield out(*held)


def _parted(doc, row, pos, end) -> np.ndarray:
    """Where a chunk doesn't follow on the one before."""
    return (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (pos[1:] > end[:-1])


#: Bytes of texts or pieces that are worked on at once.
_HELD = 1 << 21
_SEEN = "kind int, doc long, row long, start int, end int, ref_doc long, ref_row long, ref_start int, ref_end int, bytes binary, more int"


def _packed(batches):
    """(doc, row, text) -> texts compressed before they are shuffled."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offs = utf8(part.column(2))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([squeeze.compress(raw[a:b]) for a, b in zip(offs, offs[1:])], pa.binary())], names=["doc", "row", "packed"])


def _contexts(batches):
    """(doc, row, packed, wants) -> the bytes of places, one more on either side: kind 0 the document's own, kind 1 those that
    others are held against; ``more``: 1 if the text has more before them, 2 behind them, 3 both."""
    expand = zstandard.ZstdDecompressor()
    rows, held = [], 0
    for batch in batches:
        for part in slices(batch, "packed", _HELD):
            for doc, row, packed, wants in zip(*(part.column(i).to_pylist() for i in range(4))):
                text = expand.decompress(packed)
                for w in wants:
                    a, b = w["start"], w["end"]
                    # a blank stands for the start and the end of the text
                    piece = (text[a - 1 : a] if a else b"") or b" "
                    piece += text[a:b] + (text[b : b + 1] or b" ")
                    more = (a > 0) + 2 * (b < len(text))
                    if w["kind"]:
                        rows.append((1, None, None, None, None, doc, row, a, b, piece, more))
                    else:
                        rows.append((0, doc, row, a, b, w["ref_doc"], w["ref_row"], w["ref_start"], w["ref_start"] + b - a, piece, more))
                    held += len(piece)
                    if held > _HELD:
                        yield _batch(list(zip(*rows)), _SEEN)
                        rows, held = [], 0
    yield _batch(list(zip(*rows)), _SEEN)


def passages(own: bytes, there: bytes, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of the passages of ``min_words`` whole words that stand at the same place of both pieces, which
    have one byte more on either side."""
    n = min(len(own), len(there)) - 2
    if n < 2 * min_words - 1:
        return []
    same = np.frombuffer(own, np.uint8, n, 1) == np.frombuffer(there, np.uint8, n, 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
    out = []
    for s, e in zip((edge[::2] + 1).tolist(), (edge[1::2] + 1).tolist()):
        if e - s < 2 * min_words - 1:
            continue
        if own[s - 1] not in _BLANK or there[s - 1] not in _BLANK:
            while s < e and own[s] not in _BLANK:
                s += 1
        if own[e] not in _BLANK or there[e] not in _BLANK:
            while e > s and own[e - 1] not in _BLANK:
                e -= 1
        piece = own[s:e]
        words = len(piece.split())
        if words >= min_words:
            out.append((s - 1 + len(piece) - len(piece.lstrip(_BLANK)), s - 1 + len(piece.rstrip(_BLANK)), words))
    return out


_PASSAGE = "doc_id long, row long, start int, end int, n_words int, first_doc_id long"
_COMPARED = _PASSAGE + ", ref_row long, ref_start int, again boolean"


def goes_on(own: bytes, there: bytes, more: int) -> tuple[bool, bool]:
    """Whether equal bytes reach the start and the end of both pieces where both texts have more beyond."""
    n = min(len(own), len(there)) - 2
    if n < FOLLOWED:
        return False, False
    return bool(more & 1 and own[1 : 1 + FOLLOWED] == there[1 : 1 + FOLLOWED]), bool(more & 2 and own[1 + n - FOLLOWED : 1 + n] == there[1 + n - FOLLOWED : 1 + n])


def _compared(min_words: int):
    """(doc, row, start, end, ref_doc, ref_row, ref_start, own bytes, the other's, more) -> passages, or a wider place to compare."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, row, start, end, ref, ref_row, ref_start, own, there, more in (x for part in slices(batch, "bytes", _HELD) for x in zip(*(c.to_pylist() for c in part.columns))):
                before, behind = goes_on(own, there, more)
                if before or behind:
                    wider = min(end - start, start, ref_start) if before else 0
                    rows.append((doc, row, start - wider, end + (end - start if behind else 0), None, ref, ref_row, ref_start - wider, True))
                else:
                    rows += [(doc, row, start + s, start + e, words, ref, None, None, False) for s, e, words in passages(own, there, min_words)]
            yield _batch(list(zip(*rows)), _COMPARED)

    return run


def _outer(batches):
    """Passages sorted by (doc_id, row, start, end descending, first_doc_id) -> those that lie within no other."""
    last, reached = None, 0
    for batch in batches:
        keep = []
        for doc, row, end in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (doc, row) != last:
                last, reached = (doc, row), 0
            keep.append(end > reached)
            reached = max(reached, end)
        yield batch.filter(pa.array(keep, pa.bool_()))


def row_numbers(docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """docs with a number (long) in ``name`` that tells the different texts of one doc_id apart; 0 where an id doesn't repeat."""
    doc = F.col("doc_id").cast("long")
    repeated = scratch.save(docs.where("doc_id is not null").groupBy(doc.alias(f"{name}of")).count().where("count > 1").select(f"{name}of"))
    if repeated.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    joined = docs.join(repeated, doc == F.col(f"{name}of"), "left")
    return joined.withColumn(name, F.when(F.col(f"{name}of").isNull(), 0).otherwise(F.xxhash64(F.col("text").cast("string")))).drop(f"{name}of")


def _in_parts(wanted: DataFrame) -> DataFrame:
    """(doc, row, wants): places of a document, PLACES or so in a row."""
    busy = wanted.groupBy("doc", "row").count().where(F.col("count") > PLACES).withColumn("parts", F.ceil(F.col("count") / PLACES)).drop("count")
    dealt = wanted.join(busy, ["doc", "row"], "left").withColumn("part", F.pmod(F.hash("kind", "start", "end", "ref_doc", "ref_start"), F.coalesce(F.col("parts"), F.lit(1))))
    return dealt.groupBy("doc", "row", "part").agg(F.collect_list(F.struct("kind", "start", "end", "ref_doc", "ref_row", "ref_start")).alias("wants")).drop("part")


def _joined_up(places: DataFrame) -> DataFrame:
    """places with those of the same two texts and shift that overlap as one: none is compared twice, however far each is followed."""
    of = ["doc", "row", "ref_doc", "ref_row", "shift"]
    along = Window.partitionBy(*of).orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = places.withColumn("shift", F.col("ref_start") - F.col("start")).withColumn("apart", F.coalesce((F.col("start") > reached).cast("int"), F.lit(0)))
    parts = apart.withColumn("part", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = parts.groupBy(*of, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.select("doc", "row", "start", "end", "ref_doc", "ref_row", (F.col("start") + F.col("shift")).alias("ref_start"))


def _passages(plain: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """plain(doc, text, row) -> _PASSAGE."""
    places = (
        plain.where("text is not null")
        .mapInArrow(tidy(_chunks), _CHUNK)
        .repartition("route")
        .sortWithinPartitions("digest", "doc", "row", "pos")
        .mapInArrow(tidy(_repeated), _REPEATED)
        .repartition("doc", "row")
        .sortWithinPartitions("doc", "row", "pos")
        .mapInArrow(tidy(_places), _PLACE)
    )
    places, found = scratch.save(_joined_up(places)), None
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    while True:
        own = places.select("doc", "row", F.lit(0).alias("kind"), "start", "end", "ref_doc", "ref_row", "ref_start")
        asked = places.select(F.col("ref_doc").alias("doc"), F.col("ref_row").alias("row"), F.lit(1).alias("kind"), F.col("ref_start").alias("start"), (F.col("ref_start") + F.col("end") - F.col("start")).alias("end"), null("long", "ref_doc"), null("long", "ref_row"), null("int", "ref_start")).distinct()
        wants = scratch.save(_in_parts(own.union(asked)))
        texts = plain
        if found is not None and wants.count() <= FEW_IDS:  # only these texts are moved again
            texts = plain.join(F.broadcast(wants.select("doc", "row").distinct()), ["doc", "row"], "left_semi")
        moved = texts.select("doc", "row", "text").mapInArrow(tidy(_packed), "doc long, row long, packed binary")
        seen = scratch.save(moved.join(wants, ["doc", "row"]).select("doc", "row", "packed", "wants").mapInArrow(tidy(_contexts), _SEEN))
        key = ["ref_doc", "ref_row", "ref_start", "ref_end"]
        there = seen.where("kind = 1").select(*key, F.col("bytes").alias("there"), F.col("more").alias("more_there"))
        both = seen.where("kind = 0").join(there, key)
        both = both.select("doc", "row", "start", "end", "ref_doc", "ref_row", "ref_start", "bytes", "there", F.col("more").bitwiseAND(F.col("more_there")).alias("more"))
        compared = scratch.save(both.mapInArrow(tidy(_compared(min_words)), _COMPARED))
        scratch.drop(places, wants, seen)
        here = compared.where("not again").select("doc_id", "row", "start", "end", "n_words", "first_doc_id")
        found = here if found is None else found.union(here)
        again = compared.where("again").select(F.col("doc_id").alias("doc"), "row", "start", "end", F.col("first_doc_id").alias("ref_doc"), "ref_row", "ref_start")
        if again.isEmpty():
            break
        places = scratch.save(_joined_up(again))
    order = ("doc_id", "row", "start", F.desc("end"), "first_doc_id")
    return scratch.save(found.repartition("doc_id", "row").sortWithinPartitions(*order).mapInArrow(tidy(_outer), _PASSAGE))


def _plain(docs: DataFrame, row: str) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), F.col(row).alias("row"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start, end, n_words, first_doc_id): passages, in bytes of the UTF-8 text, that
    a document of a smaller id, first_doc_id, has too, in one piece."""
    scratch = Scratch(docs.sparkSession)
    numbered = row_numbers(docs.select("doc_id", "text"), "row", scratch)
    return _passages(_plain(numbered, "row"), min_words, scratch).drop("row")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut from ``text`` (``n_chars``, if there, counts anew); columns stay the same."""
    scratch, own = Scratch(docs.sparkSession), fresh(docs.columns)
    numbered = row_numbers(docs, own, scratch)
    found = _passages(_plain(numbered, own), min_words, scratch).groupBy(F.col("doc_id").alias(f"{own}doc"), F.col("row").alias(f"{own}row")).agg(F.collect_list(F.struct("start", "end")).alias(f"{own}cuts"))
    joined = numbered.join(found, (F.col("doc_id").cast("long") == F.col(f"{own}doc")) & (F.col(own) == F.col(f"{own}row")), "left").drop(own, f"{own}doc", f"{own}row")
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            at, cuts = names.index("text"), len(names)
            hit = np.flatnonzero(batch.column(cuts).is_valid().to_numpy(zero_copy_only=False))
            if not len(hit):
                yield batch.select(range(len(names)))
                continue
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for i in hit.tolist():
                raw, out, last = (texts[i] or "").encode(), [], 0
                for c in sorted(batch.column(cuts)[i].as_py(), key=lambda c: c["start"]):
                    if c["start"] > last:
                        out.append(raw[last : c["start"]])
                    last = max(last, c["end"])
                texts[i] = b"".join([*out, raw[last:]]).decode()
                keep[i] = bool(texts[i].strip())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.column(at).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                counted = columns[n].to_pylist()
                for i in hit.tolist():
                    counted[i] = len(texts[i])
                columns[n] = pa.array(counted, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(tidy(run), schema)
