"""MinHash near-duplicate detection by a multi-index Hamming join.

Each different shingle set gets MINIMA minima. The first CHUNKS * WIDTH of them, 16 bits each, are its signature; two
sets of similarity s differ in each position with probability 1 - s. The signature is cut into CHUNKS chunks of WIDTH
positions; if two signatures differ in at most T = CHUNKS * (ERRORS + 1) - 1 positions, then by the pigeonhole
principle some chunk has at most ERRORS differences, so leaving out each choice of ERRORS of its positions and matching
the rest finds the pair. With 14 chunks of 6 and one error T is 27 of 84, and a pair of similarity 0.8 shares no key at
all with probability 0.345 ** 14 = 3e-7; more similar pairs are lost less. One mixed bit of each of all MINIMA minima is a sketch
that travels with the keys: of 128 bits 12.8 differ on average at similarity 0.8, and more than REJECT with probability 2e-9. Only
such pairs aren't candidates.

No pairs are emitted within a bucket of keys, only a forest of its members' close pairs. Its components over all buckets
are clusters. Full sets are compared within clusters:

* a cluster of up to BLOCK documents and BLOCK_SHINGLES shingles goes to one task, each text once, and an inverted index compares
  documents that aren't linked yet;
* in a larger one each document is first held against the smallest one of a bucket of its, then, where that leaves it in
  another component, against the others that it is close to; each is one shuffle of as many texts as there are such pairs.
  Documents of clusters that aren't one component by then are compared by prefixes: of two sets of that similarity, the
  rarest fifth of the shingles (by their counts within the cluster) has one in common, so only documents of different components
  that share a shingle there are held against each other. No pair of a cluster escapes that, and documents that
  share only what is frequent in the cluster, as pages of one template do, make no pairs.

Components of the links are the result.

Results for odd rows: a null text counts as empty; a text without words has no shingles, is linked with nothing and
kept; a row whose doc_id is null is linked with nothing, has a null component and is kept; rows that repeat a doc_id
count as one document with all their sets; texts are whole, however long; sets that tie with the threshold are linked; an empty
table gives no rows. Other columns are not read, so clashing names do no harm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chain, fresh, mix, Scratch, shingles, slices, tidy, U64, utf8, Words
from .components import Forest, connected_components

CHUNKS, WIDTH, ERRORS = 14, 6, 1
K = CHUNKS * WIDTH
MINIMA = 128
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
REJECT = 36
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
#: Documents that a task holds against one.
STAR = 512

_RNG = np.random.RandomState(7)
_A = (_RNG.randint(0, 1 << 31, MINIMA, np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.randint(0, 1 << 32, MINIMA, np.int64).astype(np.uint32)
_SKETCH_SALT = np.arange(1, MINIMA + 1, dtype=np.uint64) << U64(16)
_SALT = mix(np.arange(1, K * 2 + 1, dtype=np.uint64))


def sets_of(batch: pa.RecordBatch, k: int, text: str = "text"):
    """Yields (slice of the batch, list of sorted arrays of different shingle hashes)."""
    for part in slices(batch, text):
        data, offs = utf8(part.column(part.schema.get_field_index(text)))
        h, o = shingles(Words(data, offs, "ascii"), k)
        yield part, [np.unique(h[o[i] : o[i + 1]]) for i in range(part.num_rows)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA 16-bit minima for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), MINIMA), np.uint16)
    h, high = np.empty_like(flat), np.empty_like(flat)
    for j in range(MINIMA):
        np.multiply(flat, _A[j], out=h)
        h += _B[j]
        # a linear function alone would order the few members of a small set alike for many j
        np.right_shift(h, np.uint32(15), out=high)
        h ^= high
        h *= np.uint32(0x2C1B3C6D)
        np.right_shift(h, np.uint32(12), out=high)
        h ^= high
        out[:, j] = np.minimum.reduceat(h, starts).astype(np.uint16)
    return out


def sketches(minima: np.ndarray) -> np.ndarray:
    """A bit of the mixed value of every minimum and its number, in two 64-bit values."""
    bits = mix(minima.astype(U64) + _SKETCH_SALT) >> U64(63)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, s1 long, s2 long"


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for part, sets in sets_of(batch, k):
                full = [i for i, s in enumerate(sets) if len(s)]
                none = [None] * len(sets)
                sig, d1, d2, s1, s2 = none[:], none[:], none[:], none[:], none[:]
                if full:
                    rows = signatures([sets[i] for i in full])
                    for i, r, s in zip(full, rows, sketches(rows).tolist()):
                        sig[i], (s1[i], s2[i]) = r[:K].tobytes(), s
                        d = xxhash.xxh3_128_digest(sets[i].tobytes())
                        d1[i], d2[i] = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                longs = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], d1, d2, s1, s2)]
                yield pa.RecordBatch.from_arrays([part.column(0), *longs[:3], pa.array(sig, pa.binary()), *longs[3:]], names=["doc_id", "n_shingles", "d1", "d2", "sig", "s1", "s2"])

    return run


def _keys(batches):
    """A row for each chunk and each choice of ERRORS (one) positions left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            if not part.num_rows:
                continue
            sig = utf8(part.column(1))[0].view(np.uint16).astype(U64).reshape(-1, CHUNKS, WIDTH)
            out = []
            for c in range(CHUNKS):
                for left_out in range(WIDTH):
                    h = np.full(len(sig), _SALT[c * WIDTH + left_out], U64)
                    for p in range(WIDTH):
                        if p != left_out:
                            h = chain(h, sig[:, c, p] + U64(1))
                    out.append(h.view(np.int64))
            others = [pa.array(np.tile(part.column(i).to_numpy(zero_copy_only=False), len(out))) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *others], names=["key", "id", "s1", "s2"])


def bucket_forest(ids: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> list[tuple[int, int]]:
    """A forest of close pairs of one bucket: the members near its first, then each other one against all."""
    far = lambda i: np.bitwise_count(s1 ^ s1[i]) + np.bitwise_count(s2 ^ s2[i]).astype(np.int64) > REJECT
    apart = far(0)
    out = [(int(x), int(ids[0])) for x in ids[~apart] if x != ids[0]]
    if apart.any():
        group = np.where(apart, np.arange(len(ids)), 0)
        for i in np.flatnonzero(apart):
            near = np.flatnonzero(~far(i) & (group != group[i]))
            for g in np.unique(group[near]).tolist():
                out.append((int(ids[i]), int(ids[near[group[near] == g][0]])))
                group[group == g] = group[i]
    return out


_EDGE = "a long, b long"


def _edges(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _buckets(batches):
    """Rows sorted by (key, id) -> close pairs (a, b), a > b where from the bucket's first. A key may span batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        t[2:] = [x.view(U64) for x in t[2:]]  # bits of signed numbers would be counted on absolute values
        if held is not None:
            t = [np.concatenate(x) for x in zip(held, t)]
        cut = np.flatnonzero(np.concatenate(([True], t[0][1:] != t[0][:-1])))
        held = [x[cut[-1] :] for x in t]
        size = np.diff(cut)
        pairs = set()
        two = cut[:-1][size == 2]
        if len(two):
            near = np.bitwise_count(t[2][two] ^ t[2][two + 1]) + np.bitwise_count(t[3][two] ^ t[3][two + 1]).astype(np.int64) <= REJECT
            pairs.update(zip(t[1][two + 1][near].tolist(), t[1][two][near].tolist()))
        for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            pairs.update(bucket_forest(*(x[a : a + n] for x in t[1:])))
        yield _edges(pairs)
    if held is not None and len(held[0]) > 1:
        yield _edges(bucket_forest(*held[1:]))


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([squeeze.compress(t or b"") for t in texts], pa.binary())], names=["doc_id", "packed"])


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed before they are shuffled."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(tidy(_pack), "doc_id long, packed binary")


def links_within(ids: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links between documents, by an inverted index of their shingles."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    values, first = np.unique(flat[order], return_index=True)
    end = np.append(first[1:], len(flat))
    forest, out = Forest(), []
    root = np.arange(n)
    for i in range(n):
        others = root != root[i]
        if not others.any():
            continue
        at = np.searchsorted(values, sets[i])
        count = end[at] - first[at]
        places = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owner[places], minlength=n)
        for j in np.flatnonzero(others & (100 * both >= percent * (size + size[i] - both))).tolist():
            if root[j] != root[i] and forest.join(i, j):
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return out


def unpacked_sets(packed: pa.Array, k: int):
    """The shingle set of each compressed text, in order, about a megabyte of them at a time."""
    expand = zstandard.ZstdDecompressor()
    for part in slices(pa.record_batch([packed], ["packed"]), "packed", 1 << 19):
        texts = pa.record_batch([pa.array([expand.decompress(x) for x in part.column(0).to_pylist()], pa.binary())], ["text"])
        for _, sets in sets_of(texts, k):
            yield from sets


def _compare(k: int, percent: int):
    """Rows (cluster, id, packed) sorted by cluster -> links (a, b)."""

    def run(batches):
        ids, sets, tag = [], [], None
        for batch in batches:
            out = []
            for c, doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked_sets(batch.column(2), k)):
                if c != tag:
                    out += links_within(ids, sets, percent) if len(ids) > 1 else []
                    ids, sets, tag = [], [], c
                ids.append(doc)
                sets.append(own)
            yield _edges(out)
        if len(ids) > 1:
            yield _edges(links_within(ids, sets, percent))

    return run


def _stars(k: int, percent: int):
    """Rows (b, part, kind, id, packed) sorted so, b's own text first (kind 0) -> links of the others with b."""

    def run(batches):
        heads, tag = [], None
        for batch in batches:
            out = []
            for b, part, kind, doc, own in zip(*(batch.column(i).to_pylist() for i in range(4)), unpacked_sets(batch.column(4), k)):
                if (b, part) != tag:
                    heads, tag = [], (b, part)
                if kind == 0:
                    heads.append(own)
                    continue
                for head in heads:
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(head) - both):
                        out.append((doc, b))
                        break
            yield _edges(out)

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets, of texts(doc_id, packed), are similar enough. A document b of many pairs is dealt in
    parts, each with its text."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    others = dealt.join(texts, F.col("a") == F.col("doc_id")).select("b", "part", F.lit(1).alias("kind"), F.col("a").alias("id"), "packed")
    heads = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts, F.col("b") == F.col("doc_id"))
    rows = others.unionByName(heads.select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("id"), "packed"))
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "kind", "id").mapInArrow(tidy(_stars(k, percent)), _EDGE)


_SHINGLE = "own long, n int, h long"


def _shingled(k: int):
    """(cluster, packed) -> a row for each shingle, hashed with the cluster; ``own`` is its set."""

    def run(batches):
        for batch in batches:
            for c, own in zip(batch.column(0).to_pylist(), unpacked_sets(batch.column(1), k)):
                n = len(own)
                h = mix(own ^ mix(np.array([c], np.int64).view(U64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, set_number(own))), pa.array(np.full(n, n, np.int32)), pa.array(h)], names=["own", "n", "h"])

    return run


def set_number(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _numbered(k: int):
    """(doc_id, packed) -> (doc_id, own)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_number(own) for own in unpacked_sets(batch.column(1), k)], pa.int64())], names=["doc_id", "own"])

    return run


def _prefix_pairs(percent: int):
    """Rows (h, n, id, component) sorted so -> pairs of different components whose sizes allow the similarity."""

    def pairs(n, ids, component):
        if (component == component[0]).all():
            return
        for i in range(1, len(ids)):
            lo = int(np.searchsorted(n, -(-percent * int(n[i]) // 100)))
            near = ids[lo:i][component[lo:i] != component[i]]
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(near, ids[i])), pa.array(np.minimum(near, ids[i]))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                t = [np.concatenate(x) for x in zip(held, t)]
            cut = np.flatnonzero(np.concatenate(([True], t[0][1:] != t[0][:-1])))
            held = [x[cut[-1] :] for x in t]
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a > 1:
                    yield from pairs(*(x[a:b] for x in t[1:]))
        if held is not None and len(held[0]) > 1:
            yield from pairs(*held[1:])

    return run


def links_of_large(texts: DataFrame, close: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links within clusters, texts(doc_id, cluster, packed), that connect what is linked in them; close(a, b): candidate pairs."""
    large = scratch.save(texts.select("doc_id", "cluster").distinct())
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    near = scratch.save(close.select(*ends).distinct().join(large.select(F.col("doc_id").alias("a")), "a", "left_semi"))

    def component_of(links, name):
        known = connected_components(links, scratch).withColumnRenamed("id", "doc_id")
        return scratch.save(large.select("doc_id").join(known, "doc_id", "left").select(F.col("doc_id").alias(name), F.coalesce("component", "doc_id").alias(f"of_{name}")))

    links = scratch.save(confirmed(near.groupBy("a").agg(F.min("b").alias("b")), texts, k, percent))
    comp = component_of(links, "a")
    open_ = near.join(comp, "a").join(comp.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b").where("of_a != of_b").select("a", "b")
    links = scratch.save(links.union(confirmed(scratch.save(open_), texts, k, percent)))
    comp = component_of(links, "doc_id").withColumnRenamed("of_doc_id", "component")
    where = comp.join(large, "doc_id")
    apart = where.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("cluster")
    rest = scratch.save(texts.join(where.join(apart, "cluster", "left_semi").select("doc_id", "component"), "doc_id"))
    sets = rest.select("doc_id", "packed").mapInArrow(tidy(_numbered(k)), "doc_id long, own long").join(rest.select("doc_id", "component").distinct(), "doc_id")
    rows = rest.select("cluster", "packed").mapInArrow(tidy(_shingled(k)), _SHINGLE)
    counted = rows.withColumn("count", F.count("*").over(Window.partitionBy("h"))).where("count > 1")
    # shingles of one set only come first in a set's order: they are counted, not ranked
    of_set = Window.partitionBy("own")
    place = F.row_number().over(of_set.orderBy("count", "h")) + F.col("n") - F.count("*").over(of_set)
    first = counted.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("own", "n", "h")
    dealt = first.join(sets, "own").select("h", "n", F.col("doc_id").alias("id"), "component").repartition("h").sortWithinPartitions("h", "n", "id")
    pairs = scratch.save(dealt.mapInArrow(tidy(_prefix_pairs(percent)), _EDGE).distinct())
    return scratch.save(links.union(confirmed(pairs, texts, k, percent)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(plain.mapInArrow(tidy(_sign(k)), _SIGNED))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # classes of the same set; the smallest doc_id stands for each
    classes = scratch.save(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    own = lambda *names: (F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in names)
    members = scratch.save(usable.join(classes, ["d1", "d2"]).select("doc_id", "rep", *own("n_shingles", "sig", "s1", "s2")))
    keys = members.where("sig is not null").select(F.col("rep").alias("id"), "sig", "s1", "s2").mapInArrow(tidy(_keys), "key long, id long, s1 long, s2 long")
    close = scratch.save(keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(tidy(_buckets), _EDGE).distinct())
    clusters = scratch.save(connected_components(close, scratch).join(members.where("n_shingles is not null").groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), F.col("id") == F.col("doc_id")).select("doc_id", F.col("component").alias("cluster"), "n"))
    sizes = scratch.save(clusters.groupBy("cluster").agg(((F.count("*") > BLOCK) | (F.sum("n") > BLOCK_SHINGLES)).alias("large")))
    placed = scratch.save(clusters.join(sizes, "cluster").select("doc_id", "cluster", "large"))
    # placed grows with the documents: one plan at every size
    texts = scratch.save(packed_texts(plain).join(placed.hint("merge"), "doc_id").select("doc_id", "cluster", "large", "packed"))
    small = texts.where("not large").select("cluster", F.col("doc_id").alias("id"), "packed").repartition("cluster").sortWithinPartitions("cluster", "id")
    # rows that repeat a doc_id bring several classes together
    same = members.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    links = small.mapInArrow(tidy(_compare(k, percent)), _EDGE).union(same)
    large = texts.where("large").select("doc_id", "cluster", "packed")
    if not large.isEmpty():
        links = links.union(links_of_large(large, close, k, percent, scratch))
    links = scratch.save(links)
    comp = scratch.save(connected_components(links, scratch))
    ends = scratch.save(
        members.select("doc_id", "rep").distinct().join(comp, F.col("doc_id") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    scratch.drop(classes, members, close, clusters, sizes, placed, texts, links, comp)
    out = signed.select("doc_id", "n_shingles").join(ends, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. Of rows that repeat a doc_id and its text the
    one whose columns have the smallest hash stays; rows of one doc_id with different texts all stay."""
    own = fresh(docs.columns)
    kept = Scratch(docs.sparkSession).save(near_duplicates(docs, k, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(f"{own}kept")).distinct())
    known = docs.join(kept, F.col("doc_id").cast("long") == F.col(f"{own}kept"), "left_semi")
    # rows of a doc_id are together after this join, so telling repeats moves nothing more
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    first = Window.partitionBy("doc_id").orderBy(f"{own}text", f"{own}row")
    marks = known.withColumn(f"{own}text", F.xxhash64("text")).withColumn(f"{own}row", F.xxhash64(*plain))
    marks = marks.withColumn(f"{own}before", F.lag(f"{own}text").over(first))
    return marks.where(F.col(f"{own}before").isNull() | (F.col(f"{own}before") != F.col(f"{own}text"))).drop(f"{own}text", f"{own}row", f"{own}before").unionByName(docs.where("doc_id is null"))
