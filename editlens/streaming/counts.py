"""Operations as a stream: counts by type and day, and gap sessions of contributors at features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import FEATURE


def operation_counts(operations: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, operation_type, count) of a stream of operations with ``ts``; rows later than ``late`` are left out."""
    return operations.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "operation_type").agg(F.count("*").alias("count")).select(F.to_date("window.start").alias("day"), "operation_type", "count")


def edit_sessions(operations: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(geometry_type, oid, uid, start, end, operations): edits of a contributor at a feature with no gap over ``gap``."""
    rows = operations.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *FEATURE, "uid").agg(F.count("*").alias("operations"), F.max("ts").alias("end"))
    return rows.select(*FEATURE, "uid", F.col("session_window.start").alias("start"), "end", "operations")
