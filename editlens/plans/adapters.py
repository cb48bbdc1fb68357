"""Driver tables as edit histories: the mappings that queries and their SQL have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.actions import sessions
from .schema import HIERARCHY, OPERATION_COLUMNS

#: events as operations; {json} reads the key k of props. Five users edit fifteen features, so there are more of them with more users.
EVENT_OPERATIONS = """
SELECT CASE oid % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINE' ELSE 'RELATION' END AS geometry_type,
  oid, CAST(version AS INT) AS version, CAST(0 AS INT) AS seq,
  CASE WHEN version = 1 THEN CASE oid % 3 WHEN 0 THEN 'OP_CREATE_NODE' WHEN 1 THEN 'OP_CREATE_WAY' ELSE 'OP_CREATE_RELATION' END
    WHEN event_type = 'click' THEN 'OP_ADD_TAG' WHEN event_type = 'view' THEN 'OP_MODIFY_TAG_VALUE' WHEN event_type = 'error' THEN 'OP_REMOVE_TAG'
    WHEN oid % 3 = 0 THEN 'OP_MODIFY_COORDINATE'
    WHEN event_type = 'signup' THEN CASE oid % 3 WHEN 1 THEN 'OP_ADD_NODE' ELSE 'OP_ADD_MEMBER' END
    ELSE CASE oid % 3 WHEN 1 THEN 'OP_REMOVE_NODE' ELSE 'OP_REMOVE_MEMBER' END END AS operation_type,
  CAST(uid AS INT) AS uid, ts, CAST(uid * 100 + day(ts) AS BIGINT) AS changeset,
  CASE WHEN oid % 3 = 0 AND (version = 1 OR event_type IN ('signup', 'purchase')) OR oid % 3 = 1 AND version > 1 AND event_type = 'signup'
    THEN CAST(9.5 AS DOUBLE) + CAST(event_id % 700 AS DOUBLE) / 100 END AS lon,
  CASE WHEN oid % 3 = 0 AND (version = 1 OR event_type IN ('signup', 'purchase')) OR oid % 3 = 1 AND version > 1 AND event_type = 'signup'
    THEN CAST(46.4 AS DOUBLE) + CAST(event_id % 260 AS DOUBLE) / 100 END AS lat,
  CASE WHEN version > 1 AND event_type IN ('click', 'view', 'error') THEN CASE k % 5 WHEN 0 THEN 'highway' WHEN 1 THEN 'building' WHEN 2 THEN 'amenity' WHEN 3 THEN 'name' ELSE 'natural' END ELSE '' END AS key,
  CASE WHEN version > 1 AND event_type IN ('click', 'view') THEN concat('v', CAST(k % 7 AS STRING)) ELSE '' END AS value,
  CASE WHEN version > 1 AND oid % 3 > 0 AND event_type IN ('signup', 'purchase') THEN k ELSE CAST(-1 AS BIGINT) END AS ref_id,
  CAST(CASE WHEN version > 1 AND oid % 3 > 0 AND event_type IN ('signup', 'purchase') THEN 0 ELSE -1 END AS INT) AS position
FROM (SELECT event_id, ts, event_type, CAST({json} AS BIGINT) AS k, (user_id - user_id % 5) * 3 + event_id % 15 AS oid, user_id % 5 AS uid,
  row_number() OVER (PARTITION BY (user_id - user_id % 5) * 3 + event_id % 15 ORDER BY ts, event_id) AS version FROM {events}) e
"""

#: lineitem and orders as versions of ways: nodes of a version are parts in line order.
WAY_VERSIONS = """
SELECT o_orderkey AS id, CAST(version AS INT) AS version, CAST(o_custkey AS INT) AS uid, ts, nodes, status, priority
FROM (
  SELECT o_orderkey, 1 AS version, o_custkey, o_orderdate AS ts, o_orderstatus AS status, CAST(NULL AS STRING) AS priority, {nodes_not_r} AS nodes FROM {l} JOIN {o} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderstatus
  UNION ALL
  SELECT o_orderkey, 2 AS version, o_custkey, o_orderdate + INTERVAL 1 DAY AS ts, o_orderstatus AS status, o_orderpriority AS priority, {nodes_not_r} AS nodes FROM {l} JOIN {o} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A' GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority) v
"""


#: events as versions of 97 nodes; every error hides one.
NODE_VERSIONS = """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS INT) AS version, CAST(user_id % 5 AS INT) AS uid, ts, event_type <> 'error' AS visible, event_type AS kind,
  CASE WHEN event_type <> 'error' THEN CAST(9.5 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / 100 END AS lon, CASE WHEN event_type <> 'error' THEN CAST(46.4 AS DOUBLE) + CAST(event_id % 3 AS DOUBLE) / 100 END AS lat
FROM (SELECT *, event_id % 97 AS id FROM {events}) e
"""

#: lineitem and orders as operations: parts are nodes that move when they are shipped, orders are ways that get their parts
#: when they are made.
PART_OPERATIONS = """
SELECT DISTINCT 'LINE' AS geometry_type, l_orderkey AS oid, 1 AS version, 'OP_ADD_NODE' AS operation_type, o_orderdate AS ts, CAST(NULL AS DOUBLE) AS lon, l_partkey AS ref_id FROM {l} JOIN {o} ON l_orderkey = o_orderkey
UNION ALL
SELECT 'POINT', l_partkey, 1, 'OP_MODIFY_COORDINATE', l_shipdate, max(l_extendedprice), CAST(-1 AS BIGINT) FROM {l} GROUP BY l_partkey, l_shipdate
"""

#: lineitem and orders as edits of ways in changesets of a customer: open orders create a way, finished ones delete it, and
#: returned parts are taken out of theirs.
WAY_EDITS = """
SELECT DISTINCT l_orderkey AS oid, 1 AS version, CASE WHEN l_returnflag = 'R' THEN 'OP_REMOVE_NODE' ELSE 'OP_ADD_NODE' END AS operation_type, o_custkey AS changeset, o_orderdate AS ts, l_partkey AS ref_id, l_linenumber AS position FROM {l} JOIN {o} ON l_orderkey = o_orderkey
UNION ALL
SELECT o_orderkey, 1, CASE o_orderstatus WHEN 'O' THEN 'OP_CREATE_WAY' ELSE 'OP_DELETE_WAY' END, o_custkey, o_orderdate, CAST(-1 AS BIGINT), -1 FROM {o} WHERE o_orderstatus IN ('O', 'F')
"""

#: orders as operations of customers, whose times go up and down.
ORDER_EDITS = "SELECT o_custkey AS oid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version, o_orderdate AS ts FROM {o}"


#: orders as shapes of customers' buildings and streets in whole metres, each order one that follows on the one before.
PLANAR_SHAPES = """
SELECT o_custkey AS oid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS action_no, o_orderdate AS ts, o_orderkey AS k,
  o_orderkey % 3 * 30 AS bx, CAST(floor(o_orderkey / 3) AS BIGINT) % 2 * 10 AS bn, 10 + CAST(floor(o_orderkey / 6) AS BIGINT) % 2 * 10 AS bw,
  CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 150 END AS sx, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 21 WHEN 3 THEN 42 ELSE 5 END AS sy,
  CASE CAST(floor(o_orderkey / 7) AS BIGINT) % 4 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 99 ELSE 140 END AS sw
FROM {o}"""


def planar_actions(spark: SparkSession, sf_dir: str, feature_type: str) -> DataFrame:
    """ACTIONS' columns that change detection reads. Rings start at any corner, go either way round and may have a node on an
    edge; streets run along the x-axis in either direction, some with a node between."""
    rows = spark.sql(PLANAR_SHAPES, o=table(spark, sf_dir, "orders"))
    p = lambda x, y: F.format_string("%.7f %.7f", x.cast("double"), y.cast("double"))
    c, k = F.col, F.col("k")
    if feature_type == "building":
        x, y, w, h = c("bx"), c("bn"), c("bw"), 10
        corners = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))
        corners = F.when(k % 7 < 3, F.concat(F.slice(corners, 1, 1), F.array(p(x + 3, y)), F.slice(corners, 2, 3))).otherwise(corners)
        turned = F.concat(F.slice(corners, k % 3 + 1, F.size(corners)), F.slice(corners, F.lit(1), k % 3))
        turned = F.when(k % 2 == 0, F.reverse(turned)).otherwise(turned)
        wkt = F.concat(F.lit("POLYGON (("), F.array_join(F.concat(turned, F.slice(turned, 1, 1)), ", "), F.lit("))"))
    else:
        nodes = F.when(k % 7 < 3, F.array(p(c("sx"), c("sy")), p(c("sx") + 33, c("sy")), p(c("sx") + c("sw"), c("sy")))).otherwise(F.array(p(c("sx"), c("sy")), p(c("sx") + c("sw"), c("sy"))))
        wkt = F.concat(F.lit("LINESTRING ("), F.array_join(F.when(k % 2 == 0, F.reverse(nodes)).otherwise(nodes), ", "), F.lit(")"))
    op = F.struct(F.lit("OP_MODIFY_WAY_COORDINATE").alias("operation_type"), (c("action_no") + 1).alias("version"), k.alias("changeset"), c("ts").cast("timestamp").alias("ts"), F.lit("").alias("key"), F.lit("").alias("value"))
    return rows.select(F.lit("LINE").alias("geometry_type"), "oid", "action_no", F.lit(feature_type).alias("feature_type"), F.lit("UPDATE").alias("action_type"), F.array(op).alias("operations"), wkt.alias("geom_wkt"))


def _operations(rows: DataFrame) -> DataFrame:
    """OPERATIONS of rows that have some of its columns."""
    blank = {"geometry_type": "LINE", "operation_type": "OP_ADD_TAG", "uid": 0, "seq": 0, "changeset": 0, "lon": None, "lat": None, "key": "", "value": "", "ref_id": -1, "position": -1}
    types = {"uid": "int", "seq": "int", "changeset": "long", "lon": "double", "lat": "double", "ref_id": "long", "position": "int", "version": "int"}
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(blank[c])).cast(types.get(c, dict(rows.dtypes).get(c, "string"))).alias(c) for c in OPERATION_COLUMNS))


def part_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = joined_lines(spark, sf_dir)
    by_part = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").repartition(line_tasks(spark, sf_dir), "l_partkey")
    rows = spark.sql(PART_OPERATIONS.replace("FROM {l} GROUP BY", "FROM {p} GROUP BY"), l=line, o=orders, p=by_part)
    return _operations(rows.withColumn("lat", F.col("lon")))


def way_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = joined_lines(spark, sf_dir)
    return _operations(spark.sql(WAY_EDITS, l=line, o=orders))


def order_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operations(spark.sql(ORDER_EDITS, o=table(spark, sf_dir, "orders")))


def node_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELEMENT_VERSIONS of nodes from events, with one tag while they are visible."""
    rows = spark.sql(NODE_VERSIONS, events=table(spark, sf_dir, "events"))
    members = F.lit(None).cast("array<struct<element_type:string,id:bigint,role:string>>")
    tags = F.when(F.col("visible"), F.create_map(F.lit("kind"), "kind"))
    return rows.select(F.lit("NODE").alias("element_type"), "id", "version", "uid", F.lit("").alias("username"), "ts", F.col("uid").cast("long").alias("changeset"), "visible", tags.alias("tags"), "lon", "lat", F.lit(None).cast("array<bigint>").alias("nodes"), members.alias("members"))


def relation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELEMENT_VERSIONS of relations: the ways of ``way_versions``, with their parts as members that change their role."""
    kind = lambda n: F.when(n % 3 == 0, "NODE").when(n % 3 == 1, "WAY").otherwise("RELATION")
    member = F.transform("nodes", lambda n: F.struct(kind(n).alias("element_type"), n.alias("id"), F.concat(F.lit("r"), F.col("version")).alias("role")))
    return way_versions(spark, sf_dir).withColumn("element_type", F.lit("RELATION")).withColumn("members", member).withColumn("nodes", F.lit(None).cast("array<bigint>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem for each task of a join or a window.
TASK_ROWS = 250_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the rows of lineitem are dealt to: as many as Spark is set to, more where there are more rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def joined_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem and orders, dealt by order."""
    n = line_tasks(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_extendedprice")
    return line.repartition(n, "l_orderkey"), table(spark, sf_dir, "orders").repartition(n, "o_orderkey")


def event_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPERATIONS from events: fifteen features of every five users."""
    sql = EVENT_OPERATIONS.replace("{json}", "get_json_object(props, '$.k')")
    return spark.sql(sql, events=table(spark, sf_dir, "events")).select(*OPERATION_COLUMNS)


def way_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELEMENT_VERSIONS of ways from lineitem and orders."""
    # WAY_VERSIONS with each order's lines gathered once, and joined as one row; orders that come again have their lines as often
    line, orders, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), F.col
    lines = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag"))).alias("lines"))
    once = orders.groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").agg(F.collect_list(F.struct("o_orderpriority")).alias("own"))
    parts = lambda flag: F.transform(F.filter("lines", lambda x: x["l_returnflag"] != flag), lambda x: x["l_partkey"])
    again = lambda nodes, n: F.when(n == 1, nodes).otherwise(F.flatten(F.transform(nodes, lambda x: F.array_repeat(x, n))))
    first = F.struct(F.lit(1).alias("version"), F.lit(None).cast("string").alias("priority"), again(parts("R"), F.size("own")).alias("nodes"))
    second = F.transform(F.array_distinct("own"), lambda o: F.struct(F.lit(2).alias("version"), o["o_orderpriority"].alias("priority"), again(parts("A"), F.size(F.filter("own", lambda x: x.eqNullSafe(o)))).alias("nodes")))
    rows = lines.join(once, c("l_orderkey") == c("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", F.explode(F.concat(F.array(first), second)).alias("v")).where(F.size("v.nodes") > 0)
    ts = F.when(c("v.version") == 1, c("o_orderdate")).otherwise(F.expr("o_orderdate + INTERVAL 1 DAY"))
    rows = rows.select(c("o_orderkey").alias("id"), c("v.version").alias("version"), c("o_custkey").cast("int").alias("uid"), ts.alias("ts"), c("v.nodes").alias("nodes"), c("o_orderstatus").alias("status"), c("v.priority").alias("priority"))
    tags = F.map_from_entries(F.filter(F.array(F.struct(F.lit("status").alias("key"), F.col("status").alias("value")), F.struct(F.lit("priority").alias("key"), F.col("priority").alias("value"))), lambda e: e["value"].isNotNull()))
    members = F.lit(None).cast("array<struct<element_type:string,id:bigint,role:string>>")
    return rows.select(
        F.lit("WAY").alias("element_type"), "id", "version", "uid", F.lit("").alias("username"), "ts", F.col("uid").cast("long").alias("changeset"), F.lit(True).alias("visible"), tags.alias("tags"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), "nodes", members.alias("members")
    )


HIERARCHY_SQL = "CASE operation_type " + " ".join(f"WHEN '{n}' THEN {h}" for n, h in HIERARCHY.items()) + " ELSE 0 END"
GAP_MS = 43_200_000


def session_actions(operations: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Sessions as actions, for statistics that need no rules: named by their highest operation."""
    high = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HIERARCHY.items() for x in kv)), F.col("operation_type")), F.lit(0))
    rows = sessions(operations, gap_ms).withColumn("_high", high)
    op = F.struct(*OPERATION_COLUMNS)
    groups = rows.groupBy("geometry_type", "oid", "uid", "session").agg(
        F.min_by(op, F.struct(-F.col("_high"), F.col("version"))).alias("first"), F.count("*").cast("int").alias("n_operations"), F.min("version").alias("_from"), F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_high"), F.col("version"), op.alias("op")))), lambda x: x["op"]).alias("operations")
    )
    no = F.row_number().over(Window.partitionBy("geometry_type", "oid").orderBy("_from")) - 1
    kind = F.col("first.operation_type")
    return groups.select(
        "geometry_type", "oid", no.alias("action_no"), F.when(F.col("first.key") == "", "none").otherwise(F.col("first.key")).alias("feature_type"), F.concat(F.lit("AC_"), F.substring(kind, 4, 99)).alias("action_name"),
        F.when(kind.startswith("OP_CREATE"), "CREATE").when(kind == "OP_REMOVE_TAG", "DELETE").otherwise("UPDATE").alias("action_type"), "uid", F.col("first.ts").alias("ts"), kind.alias("first_operation"), "n_operations", "operations",
    )


#: The same in SQL, as parts of a WITH clause.
CTE_OPERATIONS = "ops AS (" + EVENT_OPERATIONS.replace("{json}", "json_extract_string(props, '$.k')").replace("{events}", "events") + ")"
CTE_SESSIONS = f"""s AS (
  SELECT *, {HIERARCHY_SQL} AS high, CAST(sum(fresh) OVER (PARTITION BY geometry_type, oid, uid ORDER BY version) AS BIGINT) AS session
  FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > {GAP_MS * 1000} THEN 1 ELSE 0 END AS fresh
        FROM ops WINDOW w AS (PARTITION BY geometry_type, oid, uid ORDER BY version)) x)"""
CTE_ACTIONS = """first_ops AS (
  SELECT *, row_number() OVER (PARTITION BY geometry_type, oid, uid, session ORDER BY high DESC, version) AS n,
    count(*) OVER (PARTITION BY geometry_type, oid, uid, session) AS n_operations, min(version) OVER (PARTITION BY geometry_type, oid, uid, session) AS from_version FROM s),
actions AS (
  SELECT geometry_type, oid, row_number() OVER (PARTITION BY geometry_type, oid ORDER BY from_version) - 1 AS action_no,
    CASE WHEN key = '' THEN 'none' ELSE key END AS feature_type, concat('AC_', substr(operation_type, 4)) AS action_name,
    CASE WHEN operation_type LIKE 'OP_CREATE%' THEN 'CREATE' WHEN operation_type = 'OP_REMOVE_TAG' THEN 'DELETE' ELSE 'UPDATE' END AS action_type,
    uid, ts, operation_type AS first_operation, n_operations, session
  FROM first_ops WHERE n = 1)"""
