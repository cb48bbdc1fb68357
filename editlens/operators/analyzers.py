"""The analyzers: statistics of operations, actions and features, each a table of its own.

Inputs have ``ts``; where a result goes by time, ``period`` is the bucket that ``with_period`` adds. Where rows have a
``region``, every analyzer gives each region a result of its own, told by that column. Pivots take their columns from the configuration
where they are given, so no job looks for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.config import AnalysisConfig
from ..plans.schema import geometry_rank
from .filters import FEATURE, time_period

TAG_EDITS = ("OP_ADD_TAG", "OP_MODIFY_TAG_VALUE", "OP_REMOVE_TAG")
#: Hours until the second action of a feature that has one only: the largest number of milliseconds as hours.
NEVER_HOURS = 2**63 // 3_600_000
#: Ids that are numbered together.
ID_BUCKET = 65_536


def with_period(rows: DataFrame, config: AnalysisConfig) -> DataFrame:
    return rows.withColumn("period", time_period("ts", config.temporal_resolution, config.start))


def by_region(rows: DataFrame, *keys: str) -> list[str]:
    """The keys, after the region where rows have one."""
    return [*(c for c in ("region",) if c in rows.columns), *keys]


def _count() -> Column:
    return F.count("*").alias("count")


def _slot(column: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in column)


def _pivot(rows: DataFrame, keys: list[str], column: str, values: list[str] | None) -> DataFrame:
    """Counts of each value as columns; nothing counted is null."""
    keys = by_region(rows, *keys)
    if values is None:
        return rows.groupBy(*keys).pivot(column).count()
    return rows.groupBy(*keys).agg(*(F.nullif(F.count_if(F.col(column) == v), F.lit(0)).alias(v) for v in values))


def operation_per_type(operations: DataFrame) -> DataFrame:
    """Operations of each type and period."""
    return operations.groupBy(*by_region(operations, "operation_type", "period")).agg(_count())


def action_per_type(actions: DataFrame) -> DataFrame:
    """Actions of each name and period."""
    return actions.groupBy(*by_region(actions, "action_name", "period")).agg(_count())


def action_per_feature_type(actions: DataFrame, feature_types: list[str] | None = None) -> DataFrame:
    """Actions of each contributor and period, a column for each feature type."""
    return _pivot(actions, ["uid", "period"], "feature_type", feature_types)


def user_per_action(actions: DataFrame, names: list[str] | None = None, merge: bool = False) -> DataFrame:
    """Actions of each contributor and period, a column for each action name in order (or one for all)."""
    if merge:
        return actions.groupBy(*by_region(actions, "uid", "period")).agg(F.count("*").alias("AC_UNDEFINED"))
    return _pivot(actions, ["uid", "period"], "action_name", sorted(set(names)) if names is not None else None)


def user_per_operation(operations: DataFrame, merge: bool = False) -> DataFrame:
    """Operations of each contributor, type (or all as one) and period."""
    rows = operations.withColumn("operation_type", F.lit("OP_UNDEFINED")) if merge else operations
    return rows.groupBy(*by_region(rows, "uid", "operation_type", "period")).agg(_count())


def user_per_tags(operations: DataFrame, tag_key: str = "") -> DataFrame:
    """For each kind of tag operation, contributor and key (or value of ``tag_key``): counts at points, lines, relations."""
    rows = operations.where(F.col("operation_type").isin(*TAG_EDITS))
    if tag_key:
        rows = rows.where(F.col("key") == tag_key)
    slot = lambda g: F.nullif(F.count_if(g), F.lit(0))
    line, relation = F.col("geometry_type") == "LINE", F.col("geometry_type") == "RELATION"
    named = rows.withColumn("tag", geo.clean_text(F.col("value" if tag_key else "key")))
    return named.groupBy(*by_region(named, "operation_type", "uid", "tag")).agg(slot(~line & ~relation).alias("n"), slot(line).alias("w"), slot(relation).alias("r"))


def tags(operations: DataFrame, tag_key: str = "", strict: bool = False) -> DataFrame:
    """Added, modified and removed tags of each period and key (or value of ``tag_key``).

    ``strict`` keeps a row for keys that only other operations have (nodes' empty key, members' kinds)."""
    rows = operations.where(F.col("key") == tag_key) if tag_key else operations
    if not strict:
        rows = rows.where(F.col("operation_type").isin(*TAG_EDITS))
    rows = rows.withColumn("tag", F.col("value" if tag_key else "key"))
    return rows.groupBy(*by_region(rows, "period", "tag")).agg(*(F.nullif(F.count_if(F.col("operation_type") == t), F.lit(0)).alias(n) for t, n in zip(TAG_EDITS, ("added", "modified", "removed"))))


def hour_of_day(actions: DataFrame, all_users: DataFrame | None = None, regions: list[str] | None = None) -> DataFrame:
    """Actions of each contributor in the quarters of the day (UTC); ``all_users`` (uid) adds empty rows for others, in each of
    ``regions`` where actions have regions (without them the actions are asked)."""
    quarter = F.floor(F.hour("ts") / 6)
    keys = by_region(actions, "uid")
    out = actions.groupBy(*keys).agg(*(F.nullif(F.count_if(quarter == i), F.lit(0)).alias(n) for i, n in enumerate(("h00_06", "h06_12", "h12_18", "h18_00"))))
    if all_users is None:
        return out
    users = all_users.select("uid").distinct()
    if len(keys) > 1:
        if regions is None:
            regions = [r[0] for r in actions.select("region").distinct().collect()]
        users = users.withColumn("region", F.explode(F.array(*map(F.lit, regions)).cast("array<string>")))
    return users.join(out, keys, "left")


def geometry_type(actions: DataFrame, feature_types: list[str] | None = None) -> DataFrame:
    """Actions of each geometry type, a column for each feature type."""
    return _pivot(actions, ["geometry_type"], "feature_type", feature_types)


def action_details(actions: DataFrame, include_operations: bool = True) -> DataFrame:
    """A row for each action, or each of its operations, with a running number of the action (within its region).

    Numbers ascend with (geometry type, id, action); ids are counted in buckets of ID_BUCKET."""
    keyed = with_running_number(actions, [geometry_rank(), F.floor(F.col("oid") / ID_BUCKET)], [F.col("oid"), F.col("action_no")], "action_id")
    head = [*by_region(actions), "action_id", "oid", "geometry_type", "feature_type", "action_type"]
    fields = ("uid", "version", "ts", "changeset")
    if not include_operations:
        first = F.col("operations")[0]
        return keyed.select(*head, F.lit("OP_UNDEFINED").alias("operation_type"), *(first[f].alias(f) for f in fields), *(F.lit(None).cast(t).alias(n) for n, t in (("lon", "double"), ("lat", "double"), ("key", "string"), ("value", "string"), ("ref_id", "long"), ("position", "int"))))
    rows = keyed.select(*head, F.explode("operations").alias("o"))
    return rows.select(*head, *(F.col(f"o.{f}").alias(f) for f in ("operation_type", *fields, "lon", "lat", "key", "value", "ref_id", "position")))


def with_running_number(rows: DataFrame, bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """rows (of each region) numbered 1, 2, ... by ``bucket`` and, within equal ones, ``order``.

    Numbers within a bucket are moved by the sizes of the buckets before it; only these sizes, a row for each bucket, are
    put in order in one place. Nothing depends on how rows happen to be dealt, so a lost task gives the same numbers."""
    keys = [f"_b{i}" for i in range(len(bucket))]
    rows = rows.select("*", *(c.alias(k) for c, k in zip(bucket, keys)))
    both = by_region(rows, *keys)
    before = Window.partitionBy(*by_region(rows)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*both).agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = F.row_number().over(Window.partitionBy(*both).orderBy(*order))
    return rows.withColumn("_n", within).join(sizes, both).withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_before", *keys)


def feature_stability(actions: DataFrame) -> DataFrame:
    """Features by the whole hours between their first and second action."""
    times = actions.groupBy(*by_region(actions, *FEATURE)).agg(F.min_by("ts", "action_no").alias("first"), F.slice(F.sort_array(F.collect_list(F.when(F.col("action_no") <= 1, F.struct("action_no", "ts")))), 2, 1).alias("second"))
    wait = F.when(F.size("second") == 0, F.lit(NEVER_HOURS)).otherwise(F.expr("timestampdiff(HOUR, first, second[0].ts)"))
    return times.groupBy(*by_region(times), wait.alias("hours_until_edit")).agg(F.count("*").alias("feature_count"))


def update(actions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Of each period: features created less deleted, features updated, and counts of each update's name."""
    of = F.col("action_type")
    changed = F.count_distinct(F.when(of == "UPDATE", F.struct(*FEATURE)))
    if names is None:
        names = sorted(r[0] for r in actions.where("action_type = 'UPDATE'").select("action_name").distinct().collect())
    delta = F.count_if(of == "CREATE") - F.count_if(of == "DELETE")
    return actions.groupBy(*by_region(actions, "period")).agg(delta.alias("feature_count_delta"), changed.alias("feature_count_updated"), *(F.nullif(F.count_if((of == "UPDATE") & (F.col("action_name") == n)), F.lit(0)).alias(n) for n in names))


def update_geometry(operations: DataFrame, key: str = "version") -> DataFrame:
    """For each ``key``: nodes of ways, their changes of position, and the metres moved (in EPSG:31258)."""
    rows = operations.where("operation_type IN ('OP_ADD_NODE', 'OP_MODIFY_WAY_COORDINATE') AND lon IS NOT NULL")
    w = Window.partitionBy(*by_region(operations, key, "ref_id")).orderBy(geometry_rank(), "oid", "version", "ts", "seq")
    moved = rows.withColumn("_at", geo.austria_gk_central("lon", "lat")).withColumn("_x", F.col("_at.x")).withColumn("_y", F.col("_at.y")).withColumn("_dx", F.col("_x") - F.lag("_x").over(w)).withColumn("_dy", F.col("_y") - F.lag("_y").over(w))
    step = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    nodes = moved.groupBy(*by_region(moved, key, "ref_id")).agg(F.count_if(step > 0).alias("changes"), F.coalesce(F.sum(step), F.lit(0.0)).alias("metres"))
    return nodes.groupBy(*by_region(nodes), F.col(key).alias("id")).agg(F.count("*").alias("node_count"), F.sum("changes").alias("update_count"), F.sum("metres").alias("coordinate_delta"))


def batch_general(actions: DataFrame, keys: tuple[str, ...] = ("feature_type", "period", "action_name")) -> DataFrame:
    """Actions, features and contributors of each region (where there is that column), feature type, period and action."""
    names = [*(c for c in ("region",) if c in actions.columns), *keys]
    return actions.groupBy(*names).agg(F.count("*").alias("action_count"), F.count_distinct(*FEATURE).alias("affected_count"), F.count_distinct("uid").alias("user_count"))


def batch_contributor(actions: DataFrame) -> DataFrame:
    """Of each region: contributors, actions, whole actions for each, and who has most (of equals the smallest uid)."""
    keys = ["region"] if "region" in actions.columns else []
    each = actions.groupBy(*keys, "uid").agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(
        F.count("*").alias("num_user"), F.sum("n").alias("num_actions"), F.floor(F.sum("n") / F.count("*")).alias("avg_actions_per_user"), F.max_by("uid", F.struct(F.col("n"), -F.col("uid"))).alias("top_user_id"), F.max("n").alias("top_user_action_count")
    )


def batch_user_action_type(actions: DataFrame, names: list[str]) -> DataFrame:
    """Of each region and period: contributors, and counts of each action name."""
    keys = [*(["region"] if "region" in actions.columns else []), "period"]
    return actions.groupBy(*keys).agg(F.count_distinct("uid").alias("num_user"), *(F.count_if(F.col("action_name") == n).alias(n) for n in names))


def progress(rows: DataFrame, name: str | Observation = "progress") -> DataFrame:
    """rows, observed: number of operations and of features while they pass (an ``Observation``, or one by that name)."""
    return rows.observe(name, F.count("*").alias("operations"), F.approx_count_distinct(F.struct(*FEATURE)).alias("features"))


@dataclass(frozen=True)
class Run:
    """What analyzers are given: operations and actions with their period (and region), and the configuration.

    ``features``: actions for the analyzers of whole features, where they aren't the same."""

    operations: DataFrame
    actions: DataFrame
    features: DataFrame
    config: AnalysisConfig

    @property
    def action_names(self) -> list[str]:
        return [a.name for a in self.config.actions]

    @property
    def update_names(self) -> list[str]:
        return [a.name for a in self.config.actions if a.action_type == "UPDATE"]

    @property
    def type_names(self) -> list[str]:
        return [t.name for t in self.config.feature_types]


def _change_detection(run: Run, settings: dict) -> DataFrame:
    from .change_detection import change_detection

    return change_detection(run.actions, round_ends=settings.get("roundEnds") == "true")


Analysis = Callable[[Run, dict[str, str]], DataFrame]

#: Analyzers by the names that profiles end their analyzers' names with: of a run and the analyzer's settings.
ANALYZERS: dict[str, Analysis] = {
    "OperationPerType": lambda r, s: operation_per_type(r.operations),
    "ActionPerType": lambda r, s: action_per_type(r.actions),
    "ActionPerFeatureType": lambda r, s: action_per_feature_type(r.actions, r.type_names),
    "UserPerAction": lambda r, s: user_per_action(r.actions, r.action_names, s.get("mergeActionTypes") == "true"),
    "UserPerOperation": lambda r, s: user_per_operation(r.operations, s.get("mergeOperationTypes") == "true"),
    "UserPerTags": lambda r, s: user_per_tags(r.operations, s.get("tagKey", "")),
    "Tags": lambda r, s: tags(r.operations, s.get("tagKey", "")),
    "HourOfDay": lambda r, s: hour_of_day(r.actions),
    "GeometryType": lambda r, s: geometry_type(r.actions, r.type_names),
    "ActionDetails": lambda r, s: action_details(r.actions, s.get("includeOperationDetails") == "true"),
    "FeatureStability": lambda r, s: feature_stability(r.features),
    "Update": lambda r, s: update(r.actions, r.update_names),
    "UpdateGeometry": lambda r, s: update_geometry(r.operations),
    "ChangeDetection": _change_detection,
    "BatchGeneral": lambda r, s: batch_general(r.actions),
    "BatchContributor": lambda r, s: batch_contributor(r.actions),
    "BatchUserActionType": lambda r, s: batch_user_action_type(r.actions, r.action_names),
}


def analyzer(name: str) -> Callable[[Analysis], Analysis]:
    """Registers an analyzer of one's own, which profiles then run by its name. Its results should be grouped by ``by_region``, so that
    runs with regions have them for each."""

    def add(f: Analysis) -> Analysis:
        if name in ANALYZERS:
            raise ValueError(f"there is an analyzer {name!r} already")
        ANALYZERS[name] = f
        return f

    return add


def run_all(operations: DataFrame, actions: DataFrame, config: AnalysisConfig, features: DataFrame | None = None) -> dict[str, DataFrame]:
    """The results of the analyzers named in the configuration, by name (with or without the prefix of older profiles)."""
    acts = with_period(actions, config)
    run, out = Run(with_period(operations, config), acts, acts if features is None else features, config), {}
    for a in config.analyzers:
        short = next((k for k in sorted(ANALYZERS, key=len, reverse=True) if a.name.endswith(k)), None)
        if short is None:
            raise ValueError(f"analyzer {a.name!r} is unknown")
        out[short] = ANALYZERS[short](run, a.settings)
    return out
