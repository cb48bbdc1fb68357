"""Joins between features: coordinates of way nodes as of a time, moves of member nodes, relation members, split and merged ways.

As-of values come from windows over the union of both sides, sorted by time within the key: one shuffle on the key and
no pairs, however many versions a node has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import OPERATION_COLUMNS, canonical_order

#: Operations that give a node a coordinate.
LOCATED = ("OP_CREATE_NODE", "OP_RECREATE_NODE", "OP_MODIFY_COORDINATE")


def dealt(rows: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys to so many tasks; with None Spark chooses."""
    return rows if partitions is None else rows.repartition(partitions, *keys)


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], order: list[str], fallback: bool = True, partitions: int | None = None) -> DataFrame:
    """left with ``values`` of the latest right row of the same key that isn't later (of equal times the last by ``order``).

    With ``fallback``, a left row before all right rows gets the first one's (by ``order``). Rows of left without a
    match, and those with a null key, stay with nulls. ``partitions``: how many tasks both sides are dealt to."""
    names = left.columns
    r = right.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*(F.col(c) for c in order)).alias("_order"), F.struct(*(F.col(v) for v in values)).alias("_value"), F.lit(None).cast(left.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("_row")
    )
    blank = r.schema
    lft = left.select(
        F.col(key).alias("_key"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(blank["_order"].dataType).alias("_order"), F.lit(None).cast(blank["_value"].dataType).alias("_value"), F.struct(*names).alias("_row")
    )
    w = Window.partitionBy("_key").orderBy("_ts", "_side", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = dealt(r.unionByName(lft), partitions, "_key")
    found = both.withColumn("_found", F.last("_value", True).over(w))
    if fallback:  # over the same sorted rows; left rows have no order, so they are passed over
        found = found.withColumn("_found", F.coalesce("_found", F.min_by("_value", "_order").over(Window.partitionBy("_key"))))
    found = found.where("_side = 1")
    got = F.when(F.col("_key").isNotNull(), F.col("_found"))
    return found.select(*(F.col("_row")[n].alias(n) for n in names if n not in values), *(got[v].alias(v) for v in values))


def with_node_coordinates(operations: DataFrame, fallback: bool = True) -> DataFrame:
    """operations with the coordinate of the node as of each ADD_NODE (the node's first one where all are later)."""
    located = operations.where(F.col("operation_type").isin(*LOCATED) & F.col("lon").isNotNull()).select(F.col("oid").alias("ref_id"), "ts", "version", "seq", "lon", "lat")
    adds = operations.where("operation_type = 'OP_ADD_NODE' AND geometry_type = 'LINE'")
    rest = operations.where("NOT (operation_type = 'OP_ADD_NODE' AND geometry_type = 'LINE')")
    return rest.unionByName(as_of(adds, located, "ref_id", "ts", "ts", ["lon", "lat"], ["version", "seq"], fallback).select(*operations.columns))


def way_coordinate_changes(operations: DataFrame, respect_removal: bool = False, partitions: int | None = None) -> DataFrame:
    """MODIFY_WAY_COORDINATE operations: each move of a node, for every way that it had been added to before.

    Without ``respect_removal`` a node still counts for ways that it was removed from; with it, only while it was added
    more often than removed. ``version`` is the way's as of the move. ``partitions``: how many tasks join moves and ways."""
    moves = operations.where("operation_type = 'OP_MODIFY_COORDINATE'").select(F.col("oid").alias("node"), "uid", "ts", "changeset", "lon", "lat", F.col("seq").alias("move_seq"), F.col("version").alias("node_version"))
    ways = operations.where("geometry_type = 'LINE'")
    if respect_removal:
        steps = ways.where("operation_type IN ('OP_ADD_NODE', 'OP_REMOVE_NODE')").select(F.col("oid").alias("way"), F.col("ref_id").alias("node"), "ts", F.when(F.col("operation_type") == "OP_ADD_NODE", 1).otherwise(-1).alias("step"))
        # each move once for each way of its node; how often it is in there by then is a running sum, steps first
        due = moves.join(steps.select("way", "node").distinct(), "node")
        w = Window.partitionBy("way", "node").orderBy("ts", F.col("step").isNull()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        hit = due.withColumn("step", F.lit(None).cast("int")).unionByName(steps, allowMissingColumns=True).withColumn("n", F.sum("step").over(w)).where("step IS NULL AND n > 0").drop("n", "step")
    else:
        first = ways.where("operation_type = 'OP_ADD_NODE'").groupBy(F.col("oid").alias("way"), F.col("ref_id").alias("node")).agg(F.min("ts").alias("since"))
        hit = dealt(moves, partitions, "node").join(dealt(first, partitions, "node"), "node").where("since <= ts").drop("since")
    versions = ways.select(F.col("oid").alias("way"), "ts", "version", "seq")
    dated = as_of(hit.withColumn("version", F.lit(None).cast("int")), versions, "way", "ts", "ts", ["version"], ["version", "seq"])
    seq = F.row_number().over(Window.partitionBy("way", "version").orderBy("ts", "node", "node_version", "move_seq")) + 1_000_000
    return dated.select(
        F.lit("LINE").alias("geometry_type"), F.col("way").alias("oid"), "version", seq.cast("int").alias("seq"), F.lit("OP_MODIFY_WAY_COORDINATE").alias("operation_type"), "uid", "ts", "changeset", "lon", "lat", F.lit("").alias("key"), F.lit("").alias("value"), F.col("node").alias("ref_id"), F.lit(-1).alias("position")
    ).select(*OPERATION_COLUMNS)


def with_members(operations: DataFrame) -> DataFrame:
    """(oid, members): the different elements ever added to each relation."""
    kind = F.when(F.col("key") == "n", "POINT").when(F.col("key") == "w", "LINE").otherwise("RELATION")
    return operations.where("operation_type = 'OP_ADD_MEMBER'").groupBy("oid").agg(F.sort_array(F.collect_set(F.struct(kind.alias("geometry_type"), F.col("ref_id").alias("oid")))).alias("members"))


def referenced(operations: DataFrame) -> DataFrame:
    """Each reference of ways and relations with the feature it names, or null (left outer): (geometry_type, oid, ref_type, ref_id, found)."""
    kind = F.when(F.col("operation_type") == "OP_ADD_NODE", "POINT").when(F.col("key") == "n", "POINT").when(F.col("key") == "w", "LINE").otherwise("RELATION")
    refs = operations.where("operation_type IN ('OP_ADD_NODE', 'OP_ADD_MEMBER')").select("geometry_type", "oid", kind.alias("ref_type"), "ref_id").distinct()
    features = operations.groupBy(F.col("geometry_type").alias("ref_type"), F.col("oid").alias("ref_id")).agg(F.lit(True).alias("found"))
    return refs.join(features, ["ref_type", "ref_id"], "left")


def split_and_merged_ways(operations: DataFrame, partitions: int | None = None) -> DataFrame:
    """SPLIT_WAY and MERGE_WAY operations. A way created in a changeset where a node that it adds is removed from a way
    is split off; one deleted where a node that it removes is added to a way is merged. One operation for each way,
    changeset and position, however many ways it has in common; the first creation or deletion of the changeset counts.
    ``partitions``: how many tasks ways and nodes of changesets are dealt to."""
    is_ = lambda name: F.col("operation_type") == name
    has = lambda name, *keys: F.max(is_(name)).over(Window.partitionBy(*keys))
    lines = dealt(operations.where("geometry_type = 'LINE' AND oid IS NOT NULL AND changeset IS NOT NULL"), partitions, "oid", "changeset")
    way, node = ("oid", "changeset"), ("ref_id", "changeset")
    ends = lines.withColumn("_created", has("OP_CREATE_WAY", *way)).withColumn("_deleted", has("OP_DELETE_WAY", *way))
    nodes = dealt(ends.where("operation_type IN ('OP_ADD_NODE', 'OP_REMOVE_NODE') AND ref_id IS NOT NULL"), partitions, *node)
    both = nodes.withColumn("_both", has("OP_ADD_NODE", *node) & has("OP_REMOVE_NODE", *node))
    hit = both.where(F.col("_both") & F.when(is_("OP_ADD_NODE"), F.col("_created")).otherwise(F.col("_deleted")))
    first = Window.partitionBy("oid", "changeset", "operation_type", "position").orderBy(*canonical_order())
    kept = hit.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    made = kept.withColumn("operation_type", F.when(F.col("operation_type") == "OP_ADD_NODE", "OP_SPLIT_WAY").otherwise("OP_MERGE_WAY"))
    return made.withColumn("key", F.lit("")).withColumn("value", F.lit("")).withColumn("seq", F.col("seq") + 2_000_000).select(*OPERATION_COLUMNS)


def enriched(operations: DataFrame, respect_removal: bool = False) -> DataFrame:
    """operations with node coordinates in ways and the operations that node moves mean for ways."""
    return with_node_coordinates(operations).unionByName(way_coordinate_changes(operations, respect_removal))
