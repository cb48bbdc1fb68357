"""Record schemas and the dimension of edit operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = T.StructType([T.StructField("element_type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("role", T.StringType())])

ELEMENT_VERSIONS = T.StructType(
    [
        T.StructField("element_type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("username", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("changeset", T.LongType()),
        T.StructField("visible", T.BooleanType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("members", T.ArrayType(MEMBER)),
    ]
)

OPERATIONS = T.StructType(
    [
        T.StructField("geometry_type", T.StringType()),
        T.StructField("oid", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("changeset", T.LongType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ref_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
    ]
)
OPERATION_COLUMNS = OPERATIONS.fieldNames()

ACTIONS = T.StructType(
    [
        T.StructField("geometry_type", T.StringType()),
        T.StructField("oid", T.LongType()),
        T.StructField("action_no", T.IntegerType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("action_name", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("first_operation", T.StringType()),
        T.StructField("n_operations", T.IntegerType()),
        T.StructField("operations", T.ArrayType(OPERATIONS)),
        T.StructField("geom_wkt", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)

#: Operation types with their ids and hierarchy levels.
OPERATION_TYPES = (
    ("RECREATE_NODE", 0, 40),
    ("RECREATE_WAY", 1, 40),
    ("RECREATE_RELATION", 2, 40),
    ("REPLACE_NODE", 3, 39),
    ("REPLACE_WAY", 4, 39),
    ("REPLACE_RELATION", 5, 39),
    ("SPLIT_WAY", 6, 35),
    ("MERGE_WAY", 7, 34),
    ("CREATE_NODE", 8, 30),
    ("CREATE_WAY", 9, 30),
    ("CREATE_RELATION", 10, 30),
    ("DELETE_NODE", 11, 25),
    ("DELETE_WAY", 12, 25),
    ("DELETE_RELATION", 13, 25),
    ("ADD_TAG", 18, 12),
    ("MODIFY_TAG_VALUE", 19, 11),
    ("REMOVE_TAG", 20, 10),
    ("REVERSE_WAY", 21, 9),
    ("REMOVE_NODE", 23, 8),
    ("ADD_NODE", 22, 7),
    ("REMOVE_MEMBER", 25, 5),
    ("ADD_MEMBER", 24, 4),
    ("REORDER_NODE", 36, 3),
    ("REORDER_MEMBER", 37, 3),
    ("MODIFY_COORDINATE", 26, 2),
    ("MODIFY_WAY_COORDINATE", 27, 2),
    ("MODIFY_ROLE", 28, 1),
    ("UNDEFINED", 29, 0),
)
OPERATION_TYPES = tuple((f"OP_{n}", i, h) for n, i, h in OPERATION_TYPES)
HIERARCHY = {n: h for n, _, h in OPERATION_TYPES}

#: Element types in their order of rank.
GEOMETRY_TYPES = ("POINT", "LINE", "RELATION")
ELEMENT_TO_GEOMETRY = {"NODE": "POINT", "WAY": "LINE", "RELATION": "RELATION"}


def operation_dimension(spark: SparkSession) -> DataFrame:
    """(operation_type, id, hierarchy), one row for each operation type."""
    return spark.createDataFrame(list(OPERATION_TYPES), "operation_type string, id int, hierarchy int")


def lookup(column: str | Column, values: dict, default=None) -> Column:
    """A value for each key of a small fixed table, as one expression."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(default)
    for key, value in reversed(list(values.items())):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def hierarchy(column: str = "operation_type") -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HIERARCHY.items() for x in kv)), F.col(column)), F.lit(0))


def geometry_rank(column: str = "geometry_type") -> Column:
    return lookup(column, {g: i for i, g in enumerate(GEOMETRY_TYPES)}, len(GEOMETRY_TYPES))


def canonical_order() -> list[Column]:
    """Version, then time, then hierarchy downwards, then order of emission."""
    return [F.col("version").asc(), F.col("ts").asc(), hierarchy().desc(), F.col("seq").asc()]
