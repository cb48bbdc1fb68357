"""Moves alone are those of the whole diff, and lists without moves don't reach Python."""

import random

from pyspark.sql import functions as F

from editlens.operators import diff
from editlens.plans.schema import OPERATION_COLUMNS


def _ways(spark, lists):
    rows = [(i // 2, i % 2 + 1, nodes) for i, nodes in enumerate(lists)]
    df = spark.createDataFrame(rows, "id long, version int, nodes array<bigint>")
    members = F.lit(None).cast("array<struct<element_type:string,id:bigint,role:string>>").alias("members")
    none = F.lit(None).cast("double")
    return df.select(F.lit("WAY").alias("element_type"), "id", "version", F.lit(1).alias("uid"), F.lit("").alias("username"), F.timestamp_seconds("version").alias("ts"), F.lit(1).cast("long").alias("changeset"), F.lit(True).alias("visible"), F.create_map(F.lit("a"), F.col("version").cast("string")).alias("tags"), none.alias("lon"), none.alias("lat"), "nodes", members)


def test_moves_alone_are_those_of_the_whole_diff(spark):
    rng = random.Random(5)
    lists = [rng.choice([None, [], *[[rng.randint(1, 6) for _ in range(rng.randint(1, 7))]] * 8, rng.sample(range(1, 8), 5)]) for _ in range(1200)]
    ways = _ways(spark, lists)
    want = sorted(map(str, diff.version_diff(ways).where("operation_type = 'OP_REORDER_NODE'").select(*OPERATION_COLUMNS).collect()))
    got = sorted(map(str, diff.node_moves(ways).select(*OPERATION_COLUMNS).collect()))
    assert got == want and len(want) > 100


def test_each_orders_lines_are_gathered_once(spark, tmp_path):
    from datetime import date

    from editlens.plans import adapters

    rng = random.Random(9)
    day = date(1996, 1, 1)
    lines = [(k, n, rng.randint(1, 5), 1, day, 1.0, rng.choice(["R", "A", "N", None])) for k in range(60) for n in range(rng.randint(0, 6))]
    orders = [(k, k % 7, day, "O", rng.choice(["1", None])) for k in range(60)] + [(3, 3, day, "O", "1"), (3, 3, day, "O", "2"), (4, 4, day, "F", "1")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    nodes = "transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))), x -> x.l_partkey)"
    want = spark.sql(adapters.WAY_VERSIONS.replace("{nodes_not_r}", nodes), l=adapters.table(spark, str(tmp_path), "lineitem"), o=adapters.table(spark, str(tmp_path), "orders"))
    made = adapters.way_versions(spark, str(tmp_path))
    got = made.select("id", "version", "uid", "ts", "nodes", F.col("tags")["status"].alias("status"), F.col("tags")["priority"].alias("priority"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lineitem") <= 1
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
