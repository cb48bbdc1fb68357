"""What the corpus operators share: scratch tables, shipping of code, and hashing of words in numpy."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import functools
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: A slice of a batch holds this many bytes of text, or one longer text.
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- Spark side


def ship(spark: SparkSession) -> None:
    """Give the package to executors that don't have the repository on their path (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_editlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "editlens_code.zip")
        with zipfile.ZipFile(out, "w") as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.join("editlens", os.path.relpath(full, root)))
        with open(out, "rb") as f:
            kept = os.path.join(tempfile.mkdtemp(prefix="editlens"), "editlens_code.zip")
            with open(kept, "wb") as g:
                g.write(f.read())
    sc.addPyFile(kept)
    sc._editlens_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, and only where it is unset (tests), a folder of our own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_editlens_scratch", None)
    if own is None:
        own = spark.sparkContext._editlens_scratch = "file://" + tempfile.mkdtemp(prefix="editlens-scratch")
    return own


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    ``drop`` deletes one that is no longer read; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/editlens-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._editlens_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t._editlens_path)

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None or sc._jsc.sc().isStopped():
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone when the driver ends
            pass


def tidy(run):
    """A function of Arrow batches that gives memory back when a task ends: Python workers live on and idle."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(c := ctypes.CDLL(libc), "malloc_trim"):
        c.malloc_trim(0)


def fresh(columns: list[str]) -> str:
    """A name that none of the columns begins with, for columns of our own beside those of a caller."""
    name = "_own"
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text in numpy


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    bufs = wide.buffers()
    offs = np.frombuffer(bufs[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8, int(offs[-1] - offs[0]), int(offs[0]))
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Parts of a batch of at most ``limit`` bytes of text; a longer text comes alone, whole."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    _, offs = utf8(column)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@functools.lru_cache(None)
def byte_kinds(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The byte that each byte counts as, and which bytes part words.

    ``ascii``: words are runs without space, tab, LF, VT, FF, CR; A-Z count as a-z.
    ``letters``: words are runs of letters, digits and bytes of 128 and more; A-Z count as a-z.
    ``terms``: as ``letters``, without digits.
    ``exact``: as ``ascii``, with letter case."""
    counts_as, apart = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    if kind in ("letters", "terms"):
        apart[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123))[kind == "terms" :]:
            apart[a:b] = False
    else:
        apart[[32, 9, 10, 11, 12, 13]] = True
    if kind != "exact":
        counts_as[65:91] = counts_as[97:123]
    return counts_as, apart


class Words:
    """64-bit hashes of the words of consecutive texts, where they start and end, and each text's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: str):
        counts_as, apart = byte_kinds(kind)
        n = len(data)
        if n == 0:
            self.hash, self.start, self.end = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.first = np.zeros(len(offs), np.int64)
            return
        inside = ~apart[data]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        full = offs[:-1] < offs[1:]
        a, b = offs[:-1][full], offs[1:][full] - 1
        begin[a] |= inside[a]
        stop[b] |= inside[b]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.hash = span_hash(counts_as[data], self.start, self.end)
        self.first = np.searchsorted(self.start, offs)


_C = U64(0xD6E8FEB86659FD93)
#: The lowest bytes that are left of eight, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Longer spans are hashed one by one.
_LONG = 256


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of non-empty spans of bytes; equal contents hash alike wherever they stand.

    Eight bytes at a time go through ``mix``, which is no linear function of them, so that no family of texts collides."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    size = end - start
    h = mix(size.astype(U64) * _C)
    live, done = np.flatnonzero(size <= _LONG), 0
    while len(live):
        left = size[live] - done
        h[live] = mix(h[live] * _C ^ eight[start[live] + done] & _LOW[np.minimum(left, 8)])
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs."""
    with np.errstate(over="ignore"):
        return mix(left * _C + ((right << U64(23)) | (right >> U64(41))))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, with repeats, and offsets.

    A text of fewer words, but some, has its whole sequence as one; a text without words none."""
    n = len(words.hash)
    first = words.first
    count = np.diff(first)
    h = words.hash.copy()
    for j in range(1, k):
        if n > j:
            h[: n - j] = chain(h[: n - j], words.hash[j:])
    own = np.maximum(count - (k - 1), 0)
    short = (count > 0) & (count < k)
    size = np.where(short, 1, own)
    offs = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(first[:-1] - offs[:-1], size) + np.arange(offs[-1])
    out = h[index] if offs[-1] else np.zeros(0, U64)
    for d in np.flatnonzero(short):
        v = words.hash[first[d] : first[d] + 1]
        for j in range(1, count[d]):
            v = chain(v, words.hash[first[d] + j : first[d] + j + 1])
        out[offs[d]] = mix(v ^ U64(0xA5A5A5A5A5A5A5A5))[0]
    return out, offs


def flat_gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1 for all i, one after another."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.cumsum(size) - size
    return np.repeat(start - out, size) + np.arange(total)


def spelled(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Items one after another, and offsets."""
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in items], dtype=np.int64)))


def spell(ids: np.ndarray, offs: np.ndarray, items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the items (``spelled``) that consecutive lists of ids name, and offsets."""
    size = at[ids + 1] - at[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    return items[flat_gather(at[ids], size)], total[offs]


def list_slices(batch: pa.RecordBatch, column: int, limit: int = 200_000):
    """Parts of a batch with lists of at most ``limit`` items in all, or one longer list."""
    lists = batch.column(column)
    total = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
