"""Whole runs: history to operations, operations to results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import analyzers, enrich, filters
from ..operators.actions import generate_actions
from ..operators.diff import version_diff
from ..operators.fold import assembled_features
from ..operators.regions import features_in_regions, near_regions
from .config import AnalysisConfig


def import_history(versions: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Element versions to enriched operations, held to the cut-off, tags (of relations) and regions."""
    operations = filters.until(version_diff(versions), config.filter_timestamp)
    operations = filters.relations_with_tags(enrich.enriched(operations), config.filter_tags)
    return near_regions(operations, list(config.regions)) if config.regions else operations


def prepared_operations(operations: DataFrame, config: AnalysisConfig) -> tuple[DataFrame, DataFrame | None]:
    """What an analysis works on: filtered operations, with split and merged ways if asked for; and which regions their
    features are in, if there are any (features in none are left out)."""
    rows = filters.scan(operations, config)
    if config.find_related:
        rows = rows.unionByName(enrich.split_and_merged_ways(rows))
    if config.regions:
        hits = features_in_regions(rows, config).persist()
        return rows.join(hits.select(*filters.FEATURE).distinct(), filters.FEATURE, "left_semi"), hits
    if config.write_geometry:
        rows = rows.join(assembled_features(rows, config).select(*filters.FEATURE), filters.FEATURE, "left_semi")
    return rows, None


class Results(dict):
    """Results by the analyzer's name. ``release`` gives back what they were computed from, once they are written."""

    def __init__(self, results: dict[str, DataFrame], kept: list[DataFrame]):
        super().__init__(results)
        self._kept = kept

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()


def analyze(operations: DataFrame, config: AnalysisConfig) -> Results:
    """The results of all analyzers of the configuration; with regions, each has a column
    for them and gives each region what it gives that region alone.

    Actions are made once for each feature, however many regions it is in, and persisted until ``release``, as most
    analyzers read them. Analyzers of actions see the actions within the configured time, analyzers of features all
    actions of those features whose first action is within it."""
    rows, hits = prepared_operations(operations, config)
    every = generate_actions(rows, config).persist()
    actions, features = filters.in_window(every, config.start, config.end), filters.features_in_window(every, config.start, config.end)
    kept = [every]
    if hits is not None:
        rows, actions, features = (x.join(hits, filters.FEATURE) for x in (rows, actions, features))
        kept.append(hits)
    return Results(analyzers.run_all(rows, actions, config, features), kept)
