"""A data source for full-history PBF files, read by tasks of some 64 MB that find the borders of blobs themselves.

``read_history(spark, path)`` gives element versions, of the asked element types and times only: elements of other types
aren't decoded. It is short for ``spark.dataSource.register(HistoryPbf)`` and ``spark.read.format("history_pbf")`` with the options
``elementTypes``, ``since`` and ``until``. Types and times are options, not filters that Spark pushes, because Spark 4.1 reads with what it
pushed for one query of a DataFrame in the next one as well. Planning reads the file's size and first blob only.

The wire format is read directly; only the public layout of blocks is assumed (headers whose type comes first, dense and
plain nodes, ways, relations). Elements without information are left out, invisible nodes have no coordinate. What stands
between two blobs and is no blob ends the job, as does a blob that is cut off."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.schema import ELEMENT_VERSIONS

SUPPORTED = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"}
PARTITION_BYTES = 64 << 20
#: How a blob's header begins, by its type, and the greatest lengths of headers and blobs that the format allows.
HEADERS = {"OSMData": b"\x0a\x07OSMData", "OSMHeader": b"\x0a\x09OSMHeader"}
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
_LOOK = 1 << 20
_FOLLOWING = 3


def fields(data: bytes):
    """(number, value) of a message: integers for varints and fixed widths, bytes for the rest."""
    at, n = 0, len(data)
    while at < n:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<I", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<Q", data, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += zigzag(v)
        out.append(total)
    return out


def blob_at(read, size: int, at: int):
    """(type, offset, length) of the blob whose header's length stands at ``at``; ``read(offset, length)`` gives bytes."""
    try:
        head = struct.unpack(">I", read(at, 4))[0]
        if not 0 < head <= MOST_HEADER:
            raise ValueError
        found = dict(fields(read(at + 4, head)))
        kind, offset, length = found[1].decode(), at + 4 + head, found[3]
        if not 0 <= length <= MOST_BLOB or offset + length > size:
            raise ValueError
    except (struct.error, ValueError, LookupError, AttributeError, TypeError) as e:
        raise ValueError(f"no whole blob at byte {at}") from e
    return kind, offset, length


def _is_border(read, size: int, at: int) -> bool:
    """Whether a blob begins at ``at``: it and the ones that follow (up to three) must be whole, and the last end with the file."""
    for _ in range(_FOLLOWING + 1):
        if at == size:
            return True
        try:
            kind, offset, length = blob_at(read, size, at)
        except ValueError:
            return False
        if kind not in HEADERS:
            return False
        at = offset + length
    return True


def first_border(read, size: int, start: int, end: int) -> int | None:
    """The first place in [start, end) where a blob begins, or None."""
    if start == 0:
        return 0 if size else None
    longest = 4 + max(map(len, HEADERS.values()))
    for at in range(start, end, _LOOK):
        window = read(at, min(_LOOK, end - at) + longest)
        places = []
        for sign in HEADERS.values():
            found = window.find(sign, 4)
            while found >= 0:
                places.append(at + found - 4)
                found = window.find(sign, found + 1)
        for place in sorted(places):
            if place < end and _is_border(read, size, place):
                return place
    return None


def blobs(read, size: int, start: int, end: int):
    """(type, offset, length) of the blobs that begin in [start, end)."""
    at = first_border(read, size, start, end)
    while at is not None and at < min(end, size):
        kind, offset, length = blob_at(read, size, at)
        yield kind, offset, length
        at = offset + length


def unpack(blob: bytes) -> bytes:
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("a blob is compressed in a way that isn't supported")


def check_header(block: bytes) -> None:
    unknown = {v.decode() for k, v in fields(block) if k == 4} - SUPPORTED
    if unknown:
        raise ValueError(f"required features aren't supported: {sorted(unknown)}")


_KINDS = {1: "NODE", 2: "NODE", 3: "WAY", 4: "RELATION"}


def versions(block: bytes, kinds: frozenset = frozenset(_KINDS.values())):
    """Rows of ELEMENT_VERSIONS of a data block; elements of other types than ``kinds`` aren't decoded."""
    strings, groups, step, lat0, lon0, date_step = [], [], 100, 0, 0, 1000
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            step = v
        elif k == 18:
            date_step = v
        elif k == 19:
            lat0 = signed(v)
        elif k == 20:
            lon0 = signed(v)
    when = lambda t: datetime.fromtimestamp(t * date_step / 1000, timezone.utc)
    place = lambda base, v: round((base + step * v) * 1e-9, 9)

    def info(data: bytes):
        f = dict(fields(data))
        return f.get(1, -1), f.get(4, 0), strings[f[5]] if 5 in f else "", when(signed(f.get(2, 0))), signed(f.get(3, 0)), bool(f.get(6, 1))

    def plain(data: bytes):
        f: dict[int, bytes | int] = {}
        for k, v in fields(data):
            f[k] = v
        tags = dict(zip((strings[i] for i in packed(f.get(2, b""))), (strings[i] for i in packed(f.get(3, b"")))))
        return f, tags

    for group in groups:
        for k, v in fields(group):
            if _KINDS.get(k) not in kinds:
                continue
            if k == 2:
                yield from _dense(v, strings, when, lambda y: place(lat0, y), lambda x: place(lon0, x))
                continue
            f, tags = plain(v)
            if 4 not in f:
                continue
            version, uid, name, ts, changeset, visible = info(f[4])
            if k == 1:
                x, y = (place(lon0, zigzag(f[9])), place(lat0, zigzag(f[8]))) if visible else (None, None)
                yield ("NODE", zigzag(f[1]), version, uid, name, ts, changeset, visible, tags, x, y, None, None)
            elif k == 3:
                yield ("WAY", f[1], version, uid, name, ts, changeset, visible, tags, None, None, running(packed(f.get(8, b""))), None)
            else:
                kinds = ("NODE", "WAY", "RELATION")
                members = [(kinds[t], i, strings[r]) for t, i, r in zip(packed(f.get(10, b"")), running(packed(f.get(9, b""))), packed(f.get(8, b"")))]
                yield ("RELATION", f[1], version, uid, name, ts, changeset, visible, tags, None, None, None, members)


def _dense(data: bytes, strings, when, lat, lon):
    f = dict(fields(data))
    ids, ys, xs = (running(packed(f.get(k, b""))) for k in (1, 8, 9))
    if 5 not in f:
        return
    i = dict(fields(f[5]))
    version = packed(i.get(1, b""))
    ts, changeset, uid, name = (running(packed(i.get(k, b""))) for k in (2, 3, 4, 5))
    visible = [bool(v) for v in packed(i[6])] if 6 in i else [True] * len(ids)
    tags, at = packed(f.get(10, b"")), 0
    for n in range(len(ids)):
        own = {}
        while at < len(tags) and tags[at]:
            own[strings[tags[at]]] = strings[tags[at + 1]]
            at += 2
        at += 1
        yield ("NODE", ids[n], version[n], uid[n], strings[name[n]], when(ts[n]), changeset[n], visible[n], own, lon(xs[n]) if visible[n] else None, lat(ys[n]) if visible[n] else None, None, None)


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))


def opened(path: str):
    """A file to read at any place: of a file system that Arrow knows by its URI (s3, gs, abfs, hdfs, file), or by local path."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


class _Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, kinds: frozenset, since: datetime, until: datetime):
        self.path, self.partition_bytes, self.kinds, self.since, self.until = path, partition_bytes, kinds, since, until

    def _reading(self, f):
        def read(at, n):
            f.seek(at)
            return f.read(n)

        return read, f.size()

    def partitions(self):
        with opened(self.path) as f:
            read, size = self._reading(f)
            if size:
                self._check(read, *blob_at(read, size, 0))
        return [Range(at, min(at + self.partition_bytes, size)) for at in range(0, size, self.partition_bytes)] or [Range(0, 0)]

    def _check(self, read, kind, at, n):
        if kind == "OSMHeader":
            check_header(unpack(read(at, n)))

    def read(self, partition):
        with opened(self.path) as f:
            read, size = self._reading(f)
            for kind, at, n in blobs(read, size, *partition.value):
                self._check(read, kind, at, n)
                if kind == "OSMData":
                    for row in versions(unpack(read(at, n)), self.kinds):
                        if self.since <= row[5] <= self.until:
                            yield row


def _time(text: str) -> datetime:
    time = datetime.fromisoformat(text)
    return time if time.tzinfo else time.replace(tzinfo=timezone.utc)


class HistoryPbf(DataSource):
    """A file in storage that all executors reach; ``partitionBytes`` of it are a task. ``elementTypes`` are names with commas
    between, ``since`` and ``until`` the earliest and latest time (ISO 8601, without a zone in UTC) of the versions that are read."""

    @classmethod
    def name(cls) -> str:
        return "history_pbf"

    def schema(self):
        return ELEMENT_VERSIONS

    def reader(self, schema):
        every = frozenset(_KINDS.values())
        kinds = frozenset(k.strip().upper() for k in self.options["elementTypes"].split(",")) if "elementTypes" in self.options else every
        if kinds - every:
            raise ValueError(f"unknown element types: {sorted(kinds - every)}")
        size = int(self.options.get("partitionBytes", PARTITION_BYTES))
        if size < 1:
            raise ValueError("partitionBytes must be positive")
        since, until = (_time(self.options[k]) if k in self.options else end.replace(tzinfo=timezone.utc) for k, end in (("since", datetime.min), ("until", datetime.max)))
        return _Reader(self.options["path"], size, kinds, since, until)


def read_history(spark: SparkSession, path: str, element_types: tuple[str, ...] = (), since: datetime | None = None, until: datetime | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Element versions of a full-history file: of some types, or of all if none is named, from ``since`` to ``until`` inclusive."""
    spark.dataSource.register(HistoryPbf)
    options = {"elementTypes": ",".join(element_types) or None, "since": since and since.isoformat(), "until": until and until.isoformat()}
    return spark.read.format("history_pbf").options(partitionBytes=partition_bytes, **{k: v for k, v in options.items() if v}).load(path)
