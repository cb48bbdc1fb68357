"""Queries against an index in shards: every shard meets every block of queries, in tasks of bounded memory.

The index is a table with a ``place`` (0, 1, ...) of bounded size in each row. Queries are packed to blocks of QUERIES rows, and a
block goes to every place. Both are dealt by place, the index rows of a place before its blocks; a task gathers a place's rows,
makes something to search of them and then streams the blocks. Nothing passes through the driver, and nothing is broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Queries of a block.
QUERIES = 256


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _blocks(prepare):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                yield pa.RecordBatch.from_arrays([pa.array([packed(prepare(batch.slice(at, QUERIES)))], pa.binary())], names=["block"])

    return run


def _streamed(build, search, columns: int):
    def run(batches):
        place, held, made = None, [], None
        for batch in batches:  # sorted by place, the index first
            places, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = 0
            while at < batch.num_rows:
                if places[at] != place:
                    place, held, made = places[at], [], None
                if kinds[at] == 0:
                    end = at + int(((places[at:] == place) & (kinds[at:] == 0)).argmin() or batch.num_rows - at)
                    held.append(batch.slice(at, end - at).select(range(3, 3 + columns)))
                    at = end
                    continue
                if made is None and held:
                    made, held = build(pa.Table.from_batches(held)), []
                if made is not None:
                    yield from search(made, unpacked(batch.column(2)[at].as_py()))
                at += 1

    return run


def searched(
    index: DataFrame,
    places: int,
    queries: DataFrame,
    build: Callable[[pa.Table], object],
    search: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    out: str,
    order: list[str],
    prepare: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda b: b,
) -> DataFrame:
    """index(place int, ...), queries(...) -> what ``search(build(rows of a place), block)`` yields for all places and blocks.

    The rows of a place come in ``order``; ``prepare`` adds to blocks what a query needs before it meets the index."""
    names = [c for c in index.columns if c != "place"]
    blocks = queries.mapInArrow(tidy(_blocks(prepare)), "block binary")
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"), F.lit(1).alias("kind"), "block", *(F.lit(None).cast(index.schema[c].dataType).alias(c) for c in names))
    rows = index.select("place", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("block"), *names).union(asked)
    return rows.repartition("place").sortWithinPartitions("place", "kind", *order).mapInArrow(tidy(_streamed(build, search, len(names))), out)
