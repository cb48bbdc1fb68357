"""A sink that leaves one file: tasks write parts, and the commit joins them in the order of partitions.

``write_one_file(rows, path)`` writes the column ``value`` of rows, with ``between`` after each value but the last, ``before`` at
the start and ``after`` at the end. Where rows have the columns ``west``, ``south``, ``east`` and ``north``, ``{bounds}`` in ``before``
becomes their least and greatest values (``null`` without any). Rows whose value is null are left out.

Parts stand in a folder beside the file, in storage that all executors reach. A task that runs again writes a part of its own, and only
the parts of tasks that succeeded are joined. They are copied through a buffer of fixed size, and the file takes its place by one
move, so readers see the old file or the new one. Results that need many disks are better left as folders (``write.text``)."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BOUNDS = ("west", "south", "east", "north")
_BUFFER = 8 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (by URI where it has a scheme, else local) and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    bounds: list[float] | None


def _joined(bounds: list[list[float]]) -> list[float] | None:
    return [f(b[i] for b in bounds) for i, f in enumerate((min, min, max, max))] if bounds else None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, parts: str, before: str, between: str, after: str):
        self.path, self.parts, self.before, self.between, self.after = path, parts, before, between, after

    def write(self, iterator):
        files, folder = store(self.parts)
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}"
        count, bounds, between = 0, [], self.between.encode()
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                values = batch.column("value").drop_null()
                if len(values):
                    out.write((between if count else b"") + between.join(v.as_py().encode() for v in values))
                    count += len(values)
                if set(BOUNDS) <= set(batch.schema.names):
                    ends = [(pc.min if b in BOUNDS[:2] else pc.max)(batch.column(b)).as_py() for b in BOUNDS]
                    if None not in ends:
                        bounds.append(ends)
        return _Part(context.partitionId(), name, count, _joined(bounds))

    def commit(self, messages):
        found = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        bounds = _joined([m.bounds for m in found if m.bounds])
        files, folder = store(self.parts)
        _, path = store(self.path)
        with files.open_output_stream(f"{folder}/joined") as out:
            out.write(self.before.replace("{bounds}", json.dumps(bounds)).encode())
            fresh = True
            for part in (m for m in found if m.rows):
                if not fresh:
                    out.write(self.between.encode())
                fresh = False
                with files.open_input_stream(f"{folder}/{part.name}") as there:
                    while block := there.read(_BUFFER):
                        out.write(block)
            out.write(self.after.encode())
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)  # what an earlier run wrote as a folder
        files.move(f"{folder}/joined", path)
        files.delete_dir(folder)

    def abort(self, messages):
        files, folder = store(self.parts)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite):
        if "value" not in schema.names:
            raise ValueError("rows need a column 'value'")
        path = self.options["path"]
        files, at = store(path)
        if not overwrite and files.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists")
        parts = f"{path}.{uuid.uuid4().hex}.parts"
        folder = store(parts)[1]
        files.create_dir(folder, recursive=True)
        return _Writer(path, parts, *(self.options.get(k, "") for k in ("before", "between", "after")))


def write_one_file(rows: DataFrame, path: str, before: str = "", between: str = "", after: str = "", overwrite: bool = True) -> None:
    """rows(value, and bounds if they have them) as one file; without ``overwrite`` a path where something is fails."""
    rows.sparkSession.dataSource.register(OneFile)
    path = path if "://" in path else os.path.abspath(path)
    kept = [c for c in ("value", *BOUNDS) if c in rows.columns]
    rows.select(*kept).write.format("one_file").mode("overwrite" if overwrite else "append").options(before=before, between=between, after=after).save(path)
