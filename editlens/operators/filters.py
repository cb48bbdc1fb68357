"""Filters of features, operations and actions, and time buckets."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import AnalysisConfig, FeatureType
from ..plans.schema import ELEMENT_TO_GEOMETRY

TAG_SET = ("OP_ADD_TAG", "OP_MODIFY_TAG_VALUE")
FEATURE = ["geometry_type", "oid"]


def time_period(ts: str | Column, resolution: str, start: datetime | None = None) -> Column:
    """The day, month, year, decade or century of a time as its first date; for anything else the analysis' start."""
    day = F.to_date(ts)
    years = lambda n: F.make_date((F.floor(F.year(day) / n) * n).cast("int"), F.lit(1), F.lit(1))
    made = {"day": day, "month": F.trunc(day, "month"), "year": F.trunc(day, "year"), "decade": years(10), "century": years(100)}
    return made.get(resolution, F.lit(start.date() if start else None).cast("date"))


def tag_predicate(tags: dict[str, tuple[str, ...]] | None) -> Column:
    """Whether a tag operation sets one of the keys (to one of the values, where there are any)."""
    if not tags:
        return F.lit(True)
    hit = F.lit(False)
    for key, values in sorted(tags.items()):
        hit = hit | ((F.col("key") == key) & (F.col("value").isin(*values) if values else F.lit(True)))
    return F.col("operation_type").isin(*TAG_SET) & hit


def features_with_tags(operations: DataFrame, tags: dict[str, tuple[str, ...]] | None) -> DataFrame:
    """Operations of features that ever had one of the tags; no tags let all pass."""
    if not tags:
        return operations
    return operations.join(operations.where(tag_predicate(tags)).select(*FEATURE).distinct(), FEATURE, "left_semi")


def relations_with_tags(operations: DataFrame, tags: dict[str, tuple[str, ...]] | None) -> DataFrame:
    """As on import: relations are held to the tags, points and lines are kept."""
    if not tags:
        return operations
    return operations.where("geometry_type != 'RELATION'").unionByName(features_with_tags(operations.where("geometry_type = 'RELATION'"), tags))


def of_element_type(operations: DataFrame, kind: str | None) -> DataFrame:
    """Operations of one geometry type (POINT, LINE, RELATION; UNDEFINED or None for all)."""
    kind = ELEMENT_TO_GEOMETRY.get(kind, kind)
    return operations if kind in (None, "", "UNDEFINED") else operations.where(F.col("geometry_type") == kind)


def by_ids(operations: DataFrame, points: list[int] | None = None, lines: list[int] | None = None, relations: list[int] | None = None) -> DataFrame:
    """Features of the given ids; None lets all of a type pass, an empty list none."""
    keep = F.lit(False)
    for kind, ids in (("POINT", points), ("LINE", lines), ("RELATION", relations)):
        keep = keep | ((F.col("geometry_type") == kind) & (F.lit(True) if ids is None else F.col("oid").isin(*ids) if ids else F.lit(False)))
    return operations.where(keep)


def by_id_table(operations: DataFrame, ids: DataFrame) -> DataFrame:
    """Features named in ids(geometry_type, oid)."""
    return operations.join(ids.select(*FEATURE).distinct(), FEATURE, "left_semi")


def instant(rows: DataFrame, ts: datetime, column: str = "ts") -> Column:
    """A time to hold ``column`` against: in UTC where that has no time zone."""
    if dict(rows.dtypes)[column] == "timestamp_ntz":
        return F.lit(str(ts.astimezone(timezone.utc).replace(tzinfo=None) if ts.tzinfo else ts)).cast("timestamp_ntz")
    return F.lit(ts)


def before(operations: DataFrame, ts: datetime | None) -> DataFrame:
    """Operations strictly before a time, as a reader does."""
    return operations if ts is None else operations.where(F.col("ts") < instant(operations, ts))


def until(operations: DataFrame, ts: datetime | None) -> DataFrame:
    """Operations not after a time, as an importer does."""
    return operations if ts is None else operations.where(F.col("ts") <= instant(operations, ts))


def in_window(rows: DataFrame, start: datetime | None, end: datetime | None, ts: str = "ts") -> DataFrame:
    """Rows of actions or features whose (first) time is within the window, both ends included; None is open."""
    if start is not None:
        rows = rows.where(F.col(ts) >= instant(rows, start, ts))
    return rows if end is None else rows.where(F.col(ts) <= instant(rows, end, ts))


def features_in_window(actions: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """All actions of the features whose first action is within the window; later ones may lie outside it."""
    if start is None and end is None:
        return actions
    first = Window.partitionBy(*FEATURE).orderBy("action_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return in_window(actions.withColumn("_first_ts", F.first("ts").over(first)), start, end, "_first_ts").drop("_first_ts")


def only_properties(operations: DataFrame, feature_type: FeatureType) -> DataFrame:
    """Operations without those on tags that aren't properties of the feature type."""
    tagged = F.col("operation_type").isin(*TAG_SET, "OP_REMOVE_TAG")
    return operations.where(~(tagged & ~F.col("key").isin(*feature_type.properties)))


def feature_types_of(tags: str | Column, types: tuple[FeatureType, ...]) -> Column:
    """Names of all feature types that a map of tags has, in the order of the configuration.

    A key without values matches every value but the excluded ones, ``_value`` alone every value, and others themselves."""
    tags = F.col(tags) if isinstance(tags, str) else tags

    def matches(t: FeatureType) -> Column:
        hit = F.lit(False)
        for key, values in t.include.items():
            v = F.element_at(tags, F.lit(key))
            if not values:
                banned = t.exclude.get(key, ())
                hit = hit | (v.isNotNull() & (~v.isin(*banned) if banned else F.lit(True)))
            elif values == ("_value",):
                hit = hit | v.isNotNull()
            else:
                hit = hit | F.coalesce(v.isin(*values), F.lit(False))
        return hit

    named = [F.when(matches(t), F.lit(t.name)) for t in types]
    return F.filter(F.array(*named), lambda x: x.isNotNull()) if named else F.array().cast("array<string>")


def bounding_boxes(operations: DataFrame) -> DataFrame:
    """(geometry_type, oid, xmin, ymin, xmax, ymax) over all coordinates that a feature ever had."""
    return operations.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy(*FEATURE).agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"))


def scan(operations: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The operations that an analysis reads: element type, cut-off, contributor and tags."""
    rows = before(of_element_type(operations, config.element_type), config.filter_timestamp)
    if config.filter_uid is not None:
        rows = rows.where(F.col("uid") == config.filter_uid)
    return features_with_tags(rows, config.filter_tags)
