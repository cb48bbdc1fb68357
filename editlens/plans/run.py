"""A profile from end to end: history to operations and quadrants, operations to results, and the grid of hexagons.

    python -m editlens.plans.run profile.xml --history history.osh.pbf --quadtree --analyze --raster W S E N

Each step reads what the step before it wrote into the profile's data folder, so steps can run alone."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import regions
from ..sources import tables
from .analysis import analyze, import_history
from .config import AnalysisConfig, load_settings


def import_operations(versions: DataFrame, config: AnalysisConfig) -> None:
    """element versions -> DATA/operations"""
    tables.write_operations(import_history(versions, config), f"{config.data_folder}/operations", "overwrite")


def build_quadtree(spark: SparkSession, config: AnalysisConfig, capacity: int = regions.LEAF_FEATURES) -> None:
    """DATA/operations -> DATA/quadtree"""
    operations = tables.read_operations(spark, f"{config.data_folder}/operations")
    tables.write_quadtree(operations, regions.adaptive_quadtree(regions.quadtree(operations), capacity), f"{config.data_folder}/quadtree")


def run_analysis(spark: SparkSession, config: AnalysisConfig) -> dict[str, float]:
    """DATA/operations or DATA/quadtree -> RESULTS; milliseconds for each analyzer."""
    results = analyze(tables.operations_of(spark, config), config)
    try:
        took = tables.write_results(results, config.result_folder, config)
    finally:
        results.release()
    tables.write_metadata(spark, config, took, f"{config.result_folder}/metadata")
    return took


def write_raster(spark: SparkSession, config: AnalysisConfig, west: float, south: float, east: float, north: float) -> None:
    """A rectangle in metres -> DATA/raster, a region for each hexagon."""
    tables.write_regions(regions.hexagon_grid(spark, west, south, east, north), f"{config.data_folder}/raster")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="editlens", description=__doc__)
    p.add_argument("profile")
    p.add_argument("--history", help="a full-history PBF file, imported first")
    p.add_argument("--quadtree", action="store_true")
    p.add_argument("--analyze", action="store_true")
    p.add_argument("--raster", nargs=4, type=float, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
    p.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="properties that the profile names as %%NAME%%")
    args = p.parse_args(arguments)
    config = load_settings(args.profile, dict(x.split("=", 1) for x in args.set))
    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    if args.history:
        from ..sources.pbf import read_history

        import_operations(read_history(spark, args.history), config)
    if args.quadtree:
        build_quadtree(spark, config)
    if args.raster:
        write_raster(spark, config, *args.raster)
    if args.analyze:
        run_analysis(spark, config)
    print(f"{config.name}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()
