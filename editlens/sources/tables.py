"""Where operations are kept, and the files that analyses write."""

from __future__ import annotations

import json
import time
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import number_text
from ..plans.config import AnalysisConfig, Region
from ..plans.schema import OPERATION_COLUMNS, OPERATIONS, lookup
from .one_file import BOUNDS, write_one_file

OPERATIONS_PER_FILE = 500_000


def write_operations(operations: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by geometry type, in ranges of ids: files hold few ids' ranges, so that readers skip most of them.

    ``append`` adds files; ``overwrite`` replaces the geometry types that there are rows of and leaves the others."""
    rows = operations.select(*OPERATION_COLUMNS).repartitionByRange("geometry_type", "oid").sortWithinPartitions("geometry_type", "oid", "version", "ts", "seq")
    rows.write.mode(mode).option("maxRecordsPerFile", OPERATIONS_PER_FILE).option("partitionOverwriteMode", "dynamic").partitionBy("geometry_type").parquet(path)


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPERATIONS).parquet(path).select(*OPERATION_COLUMNS)


def write_quadtree(operations: DataFrame, paths: DataFrame, path: str) -> None:
    """Operations by quadrant (``quadrant`` of paths(geometry_type, oid, quadrant)); read back with ``read_quadrants``."""
    rows = operations.join(paths.select("geometry_type", "oid", F.when(F.col("quadrant") == "", "/").otherwise(F.col("quadrant")).alias("qt_path")), ["geometry_type", "oid"])
    rows.repartition("qt_path", F.pmod(F.xxhash64("oid"), F.lit(16))).sortWithinPartitions("qt_path", "oid", "version", "seq").write.mode("overwrite").option("maxRecordsPerFile", OPERATIONS_PER_FILE).partitionBy("qt_path").parquet(path)


def read_quadrants(spark: SparkSession, path: str, regions: list[Region] | None = None) -> DataFrame:
    """Operations of quadrants that touch a region: the others' folders aren't listed in the scan. With regions,
    ``localized`` tells whether one of them lies WITHIN the quadrant or else OVERLAPS it (null: it holds the quadrant)."""
    from ..operators.regions import localized, quadrants_of

    rows = spark.read.parquet(path)
    if regions is None:
        return rows
    there = quadrants_of(regions, [r[0] for r in rows.select("qt_path").distinct().collect()])  # a row for each quadrant
    return rows.where(F.col("qt_path").isin(there)).withColumn("localized", lookup("qt_path", {p: localized(regions, p) for p in there}))


def operations_of(spark: SparkSession, config: AnalysisConfig) -> DataFrame:
    """The operations of a profile's data folder: of quadrants that touch its regions, if it reads the quadtree, or all."""
    if config.read_quadtree:
        return read_quadrants(spark, f"{config.data_folder}/quadtree", list(config.regions) or None).select(*OPERATION_COLUMNS)
    return read_operations(spark, f"{config.data_folder}/operations")


def write_regions(grid: DataFrame, path: str) -> None:
    """grid(id, wkt) as lines of WKT;label, as ``read_regions`` reads them."""
    grid.select(F.concat_ws(";", "wkt", "id").alias("value")).write.mode("overwrite").text(path)


def read_regions(spark: SparkSession, path: str) -> list[Region]:
    """Lines of WKT;label; lines without a polygon are left out."""
    from ..functions.geo import parse_wkt

    out = []
    for row in spark.read.text(path).toLocalIterator():
        wkt, _, label = row[0].rpartition(";")
        try:
            if parse_wkt(wkt)[0] == "POLYGON":
                out.append(Region(label.strip(), wkt.strip()))
        except ValueError:
            continue
    return out


def _text(column: Column, kind: str, decimals: bool, null: str) -> Column:
    if kind.startswith("timestamp"):
        text = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    elif decimals and kind in ("double", "float", "bigint", "int"):
        text = number_text(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(null))


def csv_lines(rows: DataFrame, columns: list[str] | None = None, header: list[str] | None = None, trailing: bool = True, decimals: tuple[str, ...] = (), null: str = "", quoted: tuple[str, ...] = ()) -> DataFrame:
    """(value): lines of fields with semicolons; ``decimals`` are written as 3.0, nulls as ``null``, ``quoted`` in quotes."""
    columns = columns or rows.columns
    kinds = dict(rows.dtypes)
    fields = [_text(F.col(c), kinds[c], c in decimals, null) for c in columns]
    fields = [F.concat(F.lit('"'), f, F.lit('"')) if c in quoted else f for c, f in zip(columns, fields)]
    body = rows.select(F.concat(F.concat_ws(";", *fields), F.lit(";" if trailing else "")).alias("value"))
    return body if header is None else rows.sparkSession.createDataFrame([(";".join(header) + (";" if trailing else ""),)], "value string").union(body)


#: File names, headers, whether lines end with a semicolon, columns with decimals, how nulls are written.
FILES = {
    "OperationPerType": ("operation_per_type.csv", ["operation_type", "time_period", "count"], True, (), ""),
    "ActionPerType": ("action_per_type.csv", ["action_type", "time_period", "count"], True, (), ""),
    "ActionPerFeatureType": ("action_per_featuretype.csv", None, True, (), ""),
    "UserPerAction": ("user_per_action.csv", None, False, "rest", ""),
    "UserPerOperation": ("user_per_operation.csv", ["uid", "operation_type", "time_period", "count"], True, (), ""),
    "Tags": ("tags.csv", ["time_period", "tag_key", "OP_ADD_TAG", "OP_MODIFY_TAG_VALUE", "OP_REMOVE_TAG"], False, (), "null"),
    "HourOfDay": ("action_timestamp_per_hour.csv", ["uid", "00_06", "06_12", "12_18", "18_00"], True, (), ""),
    "GeometryType": ("features_per_geometry_type.csv", None, True, (), ""),
    "ActionDetails": ("action_details.csv", ["action_id", "oid", "geometry_type", "feature_type", "action_type", "operation_type", "uid", "version", "timestamp", "changeset", "coordinate", "key", "value", "ref_id", "position"], True, (), ""),
    "FeatureStability": ("feature_stability.csv", ["durationUntilEdit", "featureCount"], False, (), ""),
    "Update": ("update.csv", None, False, (), "null"),
    "UpdateGeometry": ("update_geometry.csv", ["wayId", "nodeCount", "updatesCount", "sumCoordinateDelta"], False, (), ""),
    "BatchGeneral": ("analysis_batch_feature_type.csv", ["region", "feature_type", "time_period", "action_type", "action_count", "affected_count", "user_count"], False, (), ""),
    "BatchContributor": ("analysis_batch_summary.csv", ["region", "num_user", "num_actions", "avg_actions_per_user", "top_user_id", "top_user_action_count"], True, (), ""),
    "BatchUserActionType": ("analysis_batch_user_action_type.csv", None, True, (), ""),
}
_TAG_FILES = {"OP_ADD_TAG": "added_tag_per_key.csv", "OP_MODIFY_TAG_VALUE": "modified_tag_per_key.csv", "OP_REMOVE_TAG": "removed_tag_per_key.csv"}


def write_csv(rows: DataFrame, path: str, as_folder: bool = False, header: list[str] | None = None, trailing: bool = True, **how) -> None:
    """One file, with a header if there is one; ``as_folder`` leaves a folder of what tasks write, the header in the first file only."""
    if as_folder:
        csv_lines(rows, header=header, trailing=trailing, **how).write.mode("overwrite").text(path)
        return
    lines = csv_lines(rows, trailing=trailing, **how)
    write_one_file(lines.select(F.concat("value", F.lit("\n")).alias("value")), path, before="" if header is None else ";".join(header) + (";\n" if trailing else "\n"))


def write_results(results: dict[str, DataFrame], folder: str, config: AnalysisConfig, as_folders: bool = False) -> dict[str, float]:
    """Each analyzer's file (folders if asked for); milliseconds that each took."""
    write = partial(write_csv, as_folder=as_folders)
    took = {}
    for name, rows in results.items():
        began = time.time()
        if name == "UserPerTags":
            for kind, file in _TAG_FILES.items():
                write(rows.where(F.col("operation_type") == kind).drop("operation_type"), f"{folder}/{file}", header=["uid", "tag_key", "count(n)", "count(w)", "count(r)"], trailing=False)
        elif name == "ActionDetails":
            place = F.when(F.col("lon").isNotNull(), F.format_string("(%s, %s, NaN)", F.col("lon").cast("string"), F.col("lat").cast("string")))
            rows = rows.withColumn("coordinate", place).drop("lon", "lat")
            header = FILES[name][1]
            write(rows, f"{folder}/{FILES[name][0]}", columns=["action_id", "oid", "geometry_type", "feature_type", "action_type", "operation_type", "uid", "version", "ts", "changeset", "coordinate", "key", "value", "ref_id", "position"], header=header, quoted=tuple(header[-5:]))
        elif name == "ChangeDetection":
            for kind in ("building", "buildingPoint", "street"):
                write(rows.where(F.col("feature_type") == kind), f"{folder}/change_detection_{kind}.csv", header=rows.columns, trailing=False)
        else:
            file, header, trailing, decimals, null = FILES[name]
            if "region" not in rows.columns and name.startswith("Batch"):
                rows = rows.select(F.lit("").alias("region"), *rows.columns)
            write(rows, f"{folder}/{file}", header=header or rows.columns, trailing=trailing, decimals=tuple(rows.columns[2:]) if decimals == "rest" else decimals, null=null)
        took[name] = (time.time() - began) * 1000
    return took


def geojson_features(features: DataFrame, properties: list[str]) -> DataFrame:
    """(value, west, south, east, north): a GeoJSON feature on each line and its bounds, of features that aren't deleted; seven decimals."""
    kind = F.regexp_extract("geom_wkt", "^([A-Z]+)", 1)
    numbers = F.regexp_replace(F.regexp_replace(F.regexp_extract("geom_wkt", r"^[A-Z]+ (.*)$", 1), r"(-?\d+\.\d+) (-?\d+\.\d+)", "[$1,$2]"), ", ", ",")
    flat = F.regexp_replace(numbers, "[()]", "")
    coordinates = F.when(kind == "POINT", flat).when(kind == "LINESTRING", F.concat(F.lit("["), flat, F.lit("]"))).otherwise(F.translate(numbers, "()", "[]"))
    name = F.when(kind == "POINT", "Point").when(kind == "LINESTRING", "LineString").otherwise("Polygon")
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), name, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))
    place = lambda n: F.transform(F.regexp_extract_all("geom_wkt", F.lit(r"(-?[\d.]+) (-?[\d.]+)"), F.lit(n)), lambda x: x.cast("double"))
    ends = (end(place(n)).alias(b) for b, end, n in zip(BOUNDS, (F.array_min, F.array_min, F.array_max, F.array_max), (1, 2, 1, 2)))
    return features.where("NOT deleted").select(line.alias("value"), *ends)


def write_geojson(features: DataFrame, properties: list[str], path: str) -> None:
    """A folder of files with a feature on each line."""
    geojson_features(features, properties).select("value").write.mode("overwrite").text(path)


def write_feature_collection(features: DataFrame, properties: list[str], path: str) -> None:
    """One document with bounds (null if it has no feature), in one file."""
    before = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:4326"}},"bbox":{bounds},"features":[\n'
    write_one_file(geojson_features(features, properties), path, before, ",\n", "\n]}\n")


def write_metadata(spark: SparkSession, config: AnalysisConfig, took: dict[str, float], path: str) -> None:
    """Settings and times as one JSON line."""
    said = {"setting": config.name, "folder": config.data_folder, "filter_timestamp": str(config.filter_timestamp), "start": str(config.start), "end": str(config.end), "resolution": config.temporal_resolution, "gap_ms": config.action_gap_ms, "feature_types": [t.name for t in config.feature_types], "analyzers": {a.name: a.settings for a in config.analyzers}, "milliseconds": took, "total_milliseconds": sum(took.values())}
    write_one_file(spark.createDataFrame([(json.dumps(said),)], "value string"), path, after="\n")
