"""A store of operations that updates rewrite in part: folders by ranges of ids, and a manifest that says which of them are in force.

``OperationStore(spark, path)``; ``create`` deals operations to ranges of about ``per_range`` rows of one geometry type each, ``replace``
gives features a new history and writes the ranges anew in which they are, ``remove`` takes features out. A range that has grown
beyond twice its size is split. ``read`` reads all, types or a span of ids, ``read_features`` a table of ids: only the folders of
ranges that hold one of them.

Nothing that a manifest names is ever changed: an update writes new folders, then a manifest with the next number, by one move.
Readers take the newest manifest when they plan and so see the state before or after, and one that has begun goes on with its own,
until ``vacuum`` removes the folders that the last manifests don't name. A store has one writer at a time.

The manifest has a border and a folder for each range, so the driver holds numbers in proportion to the ranges, not to rows
(10^12 operations: 200,000). The rows of one feature are in one range, however many they are; tasks share them where they
outgrow a partition. Features without a type or an id are refused; tables without rows make no folders; columns other than those of
operations aren't kept. An updating table is read several times and so should be a table, or persisted."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import FEATURE
from ..plans.schema import OPERATION_COLUMNS, OPERATIONS, canonical_order
from .one_file import store
from .tables import OPERATIONS_PER_FILE

OPERATIONS_PER_RANGE = 5_000_000


class Ranges:
    """Of each geometry type the ids at which its ranges begin (the first has no beginning), and each range's folder or None."""

    def __init__(self, types: dict[str, tuple[list[int], list[str | None]]]):
        self.types = types
        self.first, n = {}, 0
        for kind, (borders, _) in types.items():
            self.first[kind] = n
            n += len(borders) + 1

    def number(self) -> Column:
        """A range's number, of geometry_type and oid."""
        table = {kind: (self.first[kind], np.array(borders, "int64")) for kind, (borders, _) in self.types.items()}

        @F.pandas_udf("int")
        def number(kinds: pd.Series, ids: pd.Series) -> pd.Series:
            out = np.full(len(ids), -1, "int32")
            for kind, (first, borders) in table.items():
                there = (kinds == kind).to_numpy()
                out[there] = first + np.searchsorted(borders, ids.to_numpy("int64")[there], side="right")
            return pd.Series(out)

        return number("geometry_type", "oid")

    def folders(self, kinds=None, low: int | None = None, high: int | None = None) -> list[str]:
        out = []
        for kind, (borders, folders) in self.types.items():
            if kinds is not None and kind not in kinds:
                continue
            from_ = 0 if low is None else int(np.searchsorted(borders, low, side="right"))
            to = len(borders) if high is None else int(np.searchsorted(borders, high, side="right"))
            out += [f for f in folders[from_ : to + 1] if f]
        return out

    def at(self, numbers) -> list[str]:
        every = [f for _, folders in self.types.values() for f in folders]
        return [every[n] for n in sorted(numbers) if every[n]]


class OperationStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # manifests

    def _versions(self) -> list[int]:
        files, folder = store(f"{self.path}/manifest")
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> tuple[int, int, Ranges]:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no store at {self.path}")
        version = versions[-1] if version is None else version
        files, folder = store(f"{self.path}/manifest")
        with files.open_input_stream(f"{folder}/{version}.json") as f:
            said = json.loads(f.read())
        return version, said["per_range"], Ranges({k: (t["borders"], t["folders"]) for k, t in said["types"].items()})

    def _commit(self, version: int, per_range: int, ranges: Ranges) -> None:
        files, folder = store(f"{self.path}/manifest")
        files.create_dir(folder, recursive=True)
        if version in self._versions():
            raise RuntimeError(f"another writer has changed {self.path}")
        fresh = f"{folder}/{uuid.uuid4().hex}.part"
        with files.open_output_stream(fresh) as f:
            f.write(json.dumps({"per_range": per_range, "types": {k: {"borders": b, "folders": d} for k, (b, d) in ranges.types.items()}}).encode())
        files.move(fresh, f"{folder}/{version}.json")

    # reading

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], OPERATIONS)
        return self.spark.read.schema(OPERATIONS).parquet(*(f"{self.path}/{f}" for f in folders)).select(*OPERATION_COLUMNS)

    def read(self, geometry_types=None, low: int | None = None, high: int | None = None, version: int | None = None) -> DataFrame:
        """Operations of the newest state (or an earlier one that is still there), of some types and of ids from low to high."""
        ranges = self._manifest(version)[2]
        rows = self._rows(ranges.folders(geometry_types, low, high))
        if geometry_types is not None:
            rows = rows.where(F.col("geometry_type").isin(*geometry_types))
        if low is not None:
            rows = rows.where(F.col("oid") >= low)
        return rows if high is None else rows.where(F.col("oid") <= high)

    def read_features(self, wanted: DataFrame) -> DataFrame:
        """Operations of wanted(geometry_type, oid); features that aren't there or have no id give none."""
        ranges = self._manifest()[2]
        wanted = wanted.select(*FEATURE).dropna()
        numbers = [r[0] for r in wanted.select(ranges.number().alias("no")).where("no >= 0").distinct().collect()]
        return self._rows(ranges.at(numbers)).join(wanted.distinct(), FEATURE, "left_semi")

    # writing

    def create(self, operations: DataFrame, per_range: int = OPERATIONS_PER_RANGE) -> None:
        if self._versions():
            raise FileExistsError(f"there is a store at {self.path}")
        rows = operations.select(*OPERATION_COLUMNS)
        kinds = self._kinds(rows)
        ranges = self._split(rows, Ranges({k: ([], [None]) for k in kinds}), per_range, per_range)
        self._commit(1, per_range, self._written(rows, ranges, range(sum(len(b) + 1 for b, _ in ranges.types.values()))))

    def replace(self, operations: DataFrame) -> int:
        """The features of operations get these as their whole history; the number of ranges written."""
        return self._update(operations.select(*OPERATION_COLUMNS), operations.select(*FEATURE).distinct())

    def remove(self, features: DataFrame) -> int:
        """Takes features(geometry_type, oid) out; the number of ranges written."""
        return self._update(self.spark.createDataFrame([], OPERATIONS), features.select(*FEATURE).dropna().distinct())

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all manifests but the last ``keep``, and the folders that none of these names; how many folders."""
        versions = self._versions()
        kept, old = versions[-max(keep, 1) :], versions[: -max(keep, 1)]
        used = {f for v in kept for f in self._manifest(v)[2].folders()}
        files, base = store(self.path)
        for v in old:
            files.delete_file(f"{base}/manifest/{v}.json")
        gone = 0
        for write in files.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)):
            for part in files.get_file_info(fs.FileSelector(write.path)):
                if part.type == fs.FileType.Directory and f"data/{write.base_name}/{part.base_name}" not in used:
                    files.delete_dir(part.path)
                    gone += 1
        return gone

    @staticmethod
    def _kinds(rows: DataFrame) -> list[str]:
        found = rows.groupBy("geometry_type").agg(F.count_if(F.col("oid").isNull()).alias("n")).collect()
        if any(r.geometry_type is None or r.n for r in found):
            raise ValueError("operations without a geometry type or an id")
        return sorted(r.geometry_type for r in found)

    @staticmethod
    def _split(rows: DataFrame, ranges: Ranges, per_range: int, most: int) -> Ranges:
        """ranges, with those cut that have more than ``most`` of rows: rows of all ranges that are written."""
        sizes = {r.no: r.n for r in rows.groupBy(ranges.number().alias("no")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}
        if not sizes:
            return ranges
        steps = {no: -(-n // per_range) for no, n in sizes.items()}
        fine = max(steps.values())
        places = F.percentile_approx("oid", [i / fine for i in range(1, fine)], max(10_000, 20 * fine))
        cuts = {r.no: r.at for r in rows.withColumn("no", ranges.number()).where(F.col("no").isin(*sizes)).groupBy("no").agg(places.alias("at")).collect()} if fine > 1 else {}
        types = {}
        for kind, (borders, folders) in ranges.types.items():
            b, f = [], []
            for i, folder in enumerate(folders):
                no, low = ranges.first[kind] + i, borders[i - 1] if i else None
                b += borders[i - 1 : i] if i else []
                f.append(folder)
                if no in cuts:
                    k = steps[no]
                    new = sorted({cuts[no][round(j * fine / k) - 1] for j in range(1, k)} - {low})
                    b += new
                    f += [folder] * len(new)
            types[kind] = (b, f)
        return Ranges(types)

    def _written(self, rows: DataFrame, ranges: Ranges, numbers) -> Ranges:
        """ranges with a new folder for each of ``numbers`` that has rows; rows are all of theirs."""
        write = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("no", ranges.number()).hint("rebalance", "no").sortWithinPartitions("no", *FEATURE, *canonical_order())
        dealt.write.partitionBy("no").option("maxRecordsPerFile", OPERATIONS_PER_FILE).parquet(f"{self.path}/{write}")
        files, folder = store(f"{self.path}/{write}")
        there = {f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))}
        numbers, types = set(numbers), {}
        for kind, (borders, folders) in ranges.types.items():
            own = [f if (no := ranges.first[kind] + i) not in numbers else f"{write}/no={no}" if f"no={no}" in there else None for i, f in enumerate(folders)]
            types[kind] = (borders, own)
        return Ranges(types)

    def _update(self, fresh: DataFrame, features: DataFrame) -> int:
        version, per_range, ranges = self._manifest()
        ranges = Ranges({**ranges.types, **{k: ([], [None]) for k in self._kinds(fresh) if k not in ranges.types}})
        touched = [r[0] for r in features.select(ranges.number().alias("no")).where("no >= 0").distinct().collect()]
        if not touched:
            return 0
        rows = self._rows(ranges.at(touched)).join(features, FEATURE, "left_anti").select(*OPERATION_COLUMNS).unionByName(fresh)
        parted = self._split(rows, ranges, per_range, 2 * per_range)
        numbers = [no for was, no in self._descent(ranges, parted) if was in set(touched)]
        self._commit(version + 1, per_range, self._written(rows, parted, numbers))
        return len(numbers)

    @staticmethod
    def _descent(before: Ranges, after: Ranges):
        """(number of a range, number of a range that it became, itself or a part)"""
        for kind, (borders, _) in after.types.items():
            old = before.types[kind][0]
            for i in range(len(borders) + 1):
                was = int(np.searchsorted(old, borders[i - 1], side="right")) if i else 0
                yield before.first[kind] + was, after.first[kind] + i
