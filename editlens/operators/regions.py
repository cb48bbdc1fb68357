"""Features within regions, the quadtree of features, and the grid of hexagons."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.config import AnalysisConfig, Region
from .filters import FEATURE, bounding_boxes
from .fold import assembled_features

#: A region's envelope spans at most about this many cells of its level in each direction.
SPAN = 8
#: Cells of level n are 360 / 2**n degrees wide and high.
FINEST = 24
#: Characters of regions' geometries that are broadcast at once.
BLOCK = 32 << 20
LEAF_FEATURES, MAX_LEVEL = 100_000, 10


def _level(size: float, cells: int) -> int:
    """The finest level of whose cells a box of this width or height spans at most ``cells``."""
    return FINEST if size <= 0 else max(0, min(FINEST, math.floor(math.log2(360.0 * cells / size))))


def _cells(level: Column, lo: Column, hi: Column) -> Column:
    """Numbers of the cells of a level from one coordinate to another."""
    at = lambda c: F.floor((c + 180.0) * F.pow(F.lit(2.0), level) / 360.0)
    return F.sequence(at(lo), at(hi))


def _with_cells(boxes: DataFrame, levels: Column) -> DataFrame:
    """A row for each cell of each of ``levels`` that a box (xmin, ymin, xmax, ymax) touches: level, cx, cy."""
    rows = boxes.withColumn("level", F.explode(levels))
    rows = rows.withColumn("cx", F.explode(_cells(F.col("level"), F.col("xmin"), F.col("xmax"))))
    return rows.withColumn("cy", F.explode(_cells(F.col("level"), F.col("ymin"), F.col("ymax"))))


def _envelopes(spark: SparkSession, regions: list[Region]) -> tuple[DataFrame, list[int]]:
    """(no, rxmin, rymin, rxmax, rymax, own) and the levels in use; broken geometries are left out."""
    rows = []
    for no, r in enumerate(regions):
        try:
            p = geo.parse_wkt(r.wkt)[1][0]
        except ValueError:
            continue
        (x0, y0), (x1, y1) = p.min(0), p.max(0)
        rows.append((no, float(x0), float(y0), float(x1), float(y1), _level(max(x1 - x0, y1 - y0), SPAN)))
    return spark.createDataFrame(rows, "no int, rxmin double, rymin double, rxmax double, rymax double, own int"), sorted({r[-1] for r in rows})


def near_pairs(boxes: DataFrame, regions: DataFrame, levels: list[int]) -> DataFrame:
    """boxes x regions whose envelopes touch, by an equi-join on cells of a grid of several levels.

    A region has cells of its own level and, for larger boxes, of the coarser ones; a box those of its own level, which it
    spans at most two of in each direction, and of the coarser levels that regions have. A pair meets at the coarser of
    both levels."""
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    own = F.when(size <= 0, FINEST).otherwise(F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(360.0 / size))))).cast("int")
    # boxes finer than every region need no level of their own
    boxes = boxes.withColumn("_own", F.least(own, F.lit(max(levels, default=0))))
    mine = _with_cells(boxes, F.array_distinct(F.concat(F.array("_own"), F.filter(F.array(*(F.lit(n) for n in levels)), lambda n: n < F.col("_own")))))
    placed = regions.select("no", "own", *(F.col(f"r{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    there = _with_cells(placed, F.sequence(F.lit(0), F.col("own"))).select("no", "own", "level", "cx", "cy")
    met = mine.join(there, ["level", "cx", "cy"]).where(F.col("level") == F.least("own", "_own"))
    pairs = met.drop("level", "cx", "cy", "own", "_own").distinct().join(regions.drop("own"), "no")
    return pairs.where("xmax >= rxmin AND xmin <= rxmax AND ymax >= rymin AND ymin <= rymax")


def near_regions(operations: DataFrame, regions: list[Region]) -> DataFrame:
    """As on import: features with a coordinate within the envelope of a region; relations are always kept."""
    table, levels = _envelopes(operations.sparkSession, regions)
    points = operations.where("lon IS NOT NULL AND lat IS NOT NULL AND geometry_type != 'RELATION'")
    points = points.select(*FEATURE, F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    kept = near_pairs(points, table, levels).select(*FEATURE).distinct()
    return operations.where("geometry_type = 'RELATION'").unionByName(operations.where("geometry_type != 'RELATION'").join(kept, FEATURE, "left_semi"))


def features_near(operations: DataFrame, regions: list[Region]) -> DataFrame:
    """(geometry_type, oid, xmin, ymin, xmax, ymax) of features whose box touches the envelope of a region."""
    table, levels = _envelopes(operations.sparkSession, regions)
    return near_pairs(bounding_boxes(operations), table, levels).select(*FEATURE, "xmin", "ymin", "xmax", "ymax").distinct()


def _shares_point(shared):
    """(geometry_type, oid, geom_wkt, no) -> (region, geometry_type, oid) of those that share a point; ``shared`` has the regions."""

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            rows = []
            for kind, oid, wkt, no in zip(*(c.to_pylist() for c in batch.columns)):
                if no not in known:
                    rk, rings = geo.parse_wkt(shared.value[no].wkt)
                    known[no] = rk, rings, rings[0].min(0), rings[0].max(0)
                rk, rings, rlo, rhi = known[no]
                k, g = geo.parse_wkt(wkt)
                if (g[0].min(0) <= rhi).all() and (g[0].max(0) >= rlo).all() and geo.intersects(k, g, rk, rings):
                    rows.append((shared.value[no].label, kind, oid))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.string(), pa.int64()))], names=["region", *FEATURE])

    return run


def region_blocks(regions: list[Region], limit: int):
    """Regions by their numbers, in blocks of at most ``limit`` characters of geometry, or one larger region."""
    block, size = {}, 0
    for no, r in enumerate(regions):
        if block and size + len(r.wkt) > limit:
            yield block
            block, size = {}, 0
        block[no] = r
        size += len(r.wkt)
    yield block


def features_in_regions(operations: DataFrame, config: AnalysisConfig, regions: list[Region] | None = None) -> DataFrame:
    """(region, geometry_type, oid) for each feature whose latest geometry shares a point with the region.

    Boxes of all coordinates ever meet the envelopes first, by cells of a grid; the geometries of the pairs that are left are then
    compared exactly. Pairs carry the region's number; its geometry goes to the tasks in blocks of a bounded size."""
    spark, regions = operations.sparkSession, list(config.regions if regions is None else regions)
    table, levels = _envelopes(spark, regions)
    # geometries are rounded to 1e-7 degrees, so boxes are as much wider
    grown = {c: F.col(c) + by for c, by in (("xmin", -1e-7), ("ymin", -1e-7), ("xmax", 1e-7), ("ymax", 1e-7))}
    near = near_pairs(bounding_boxes(operations).withColumns(grown), table, levels).select(*FEATURE, "no")
    latest = assembled_features(operations.join(near.select(*FEATURE).distinct(), FEATURE, "left_semi"), config).select(*FEATURE, "geom_wkt")
    pairs, out = latest.join(near, FEATURE).select(*FEATURE, "geom_wkt", "no"), None
    for block in region_blocks(regions, BLOCK):
        shared = spark.sparkContext.broadcast(block)
        own = pairs if len(block) == len(regions) else pairs.where(F.col("no").between(min(block), max(block)))
        found = own.mapInArrow(_shares_point(shared), "region string, geometry_type string, oid long")
        out = found if out is None else out.union(found)
    return out


def quadtree(operations: DataFrame, levels: int = MAX_LEVEL) -> DataFrame:
    """(geometry_type, oid, qt_path): the deepest quadrant that strictly holds all of a feature's coordinates.

    Features without a coordinate (relations too) have no path and don't come out."""
    boxes = bounding_boxes(operations)
    return boxes.select(*FEATURE, geo.quad_path(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), levels).alias("qt_path"))


def adaptive_quadtree(paths: DataFrame, capacity: int = LEAF_FEATURES) -> DataFrame:
    """Paths cut to the first level where a quadrant and all below it have at most ``capacity`` features.

    The counts of quadrants, at most one for each quadrant in use, come from one aggregation over prefixes."""
    depth = (F.length("qt_path") / 3).cast("int")
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda i: F.substring(F.col("qt_path"), F.lit(1), i * 3))
    counts = paths.groupBy("qt_path").agg(F.count("*").alias("n")).select(F.explode(prefixes).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("n"))
    full = counts.where(F.col("n") > capacity).select("prefix")
    # the deepest quadrant above a path that is still too full is where it must be split
    split = paths.select("qt_path").distinct().withColumn("prefix", F.explode(prefixes)).join(full, "prefix").groupBy("qt_path").agg(F.max(F.length("prefix")).alias("_full"))
    joined = paths.join(split, "qt_path", "left")
    cut = F.coalesce(F.col("_full") + 3, F.lit(0))
    return joined.withColumn("quadrant", F.substring(F.col("qt_path"), F.lit(1), cut)).drop("_full")


def quadrants_of(regions: list[Region], paths: list[str]) -> list[str]:
    """Those quadrants (for ``isin`` on the partition column) whose box touches the envelope of a region."""
    boxes = [(*geo.parse_wkt(r.wkt)[1][0].min(0), *geo.parse_wkt(r.wkt)[1][0].max(0)) for r in regions]
    out = []
    for p in paths:
        a, b, c, d = geo.quad_box(p)
        if any(x0 <= c and x1 >= a and y0 <= d and y1 >= b for x0, y0, x1, y1 in boxes):
            out.append(p)
    return out


def localized(regions: list[Region], path: str) -> str | None:
    """How a quadrant lies to the regions: WITHIN if one is within it, else OVERLAPS if a border crosses it, else None."""
    a, b, c, d = geo.quad_box(path)
    ring = np.array([(a, b), (c, b), (c, d), (a, d), (a, b)])
    found = None
    for r in regions:
        _, rings = geo.parse_wkt(r.wkt)
        p = rings[0]
        if (p[:, 0] >= a).all() and (p[:, 0] <= c).all() and (p[:, 1] >= b).all() and (p[:, 1] <= d).all():
            return "WITHIN"
        if any(geo.segments_cross(x, ring) for x in rings):
            found = "OVERLAPS"
    return found


def hexagon_grid(spark: SparkSession, west: float, south: float, east: float, north: float, width: float = 10_000.0) -> DataFrame:
    """(id, row, col, points, wkt): hexagons over a rectangle in metres, row by row; odd rows stand 3/4 of a width to the east.

    The id is 1, the row and the column, each of three digits at least (where both go beyond 999, only row and column tell cells
    apart for sure). A row ends with the first cell past the east border,
    the grid with the first row that reaches the north border."""
    height = width * math.sqrt(3) / 2
    rows = max(0, math.ceil((north - south - height) / (height / 2))) + 1
    last = [max(0, math.floor((east - west - shift - width) / (1.5 * width)) + 1) for shift in (0.0, 0.75 * width)]
    cols = max(last) + 1
    odd = F.col("row") % 2 == 1
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    grid = grid.where(F.col("col") <= F.when(odd, last[1]).otherwise(last[0]))
    x = F.lit(float(west)) + F.col("col") * (1.5 * width) + F.when(odd, 0.75 * width).otherwise(0.0)
    y = F.lit(float(south)) + F.col("row") * (height / 2)
    corner = lambda dx, dy: F.struct((x + dx * width).alias("x"), (y + dy * height).alias("y"))
    ring = F.array(*(corner(*c) for c in ((0.0, 0.5), (0.25, 0.0), (0.75, 0.0), (1.0, 0.5), (0.75, 1.0), (0.25, 1.0), (0.0, 0.5))))
    digits = lambda c: F.format_string("%03d", F.col(c))
    number = F.concat(F.lit("1"), digits("row"), digits("col"))
    points = F.transform(F.col("points"), lambda p: F.format_string("%.7f %.7f", p["x"], p["y"]))
    return grid.select(number.alias("id"), "row", "col", ring.alias("points")).withColumn("wkt", F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))")))
