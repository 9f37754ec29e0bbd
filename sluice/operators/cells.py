"""Elevation as rows ``(y, x, z)``, a cell each: slopes, ground, receivers, roll-ups as windows and joins.

A raster of any size is a table here; a window holds one line of cells, a
join meets neighbours only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The eight neighbours, (dy, dx), in the order that breaks ties.
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def slopes(cells: DataFrame, size: float) -> DataFrame:
    """Adds ``slope`` in degrees, from central differences, one-sided beside a missing cell; ``size`` is a cell's edge."""

    def step(across: str, along: str):
        w = Window.partitionBy(across).orderBy(along)
        is_next = lambda n: F.lag(along, n).over(w) == F.col(along) - n if n > 0 else F.lead(along, -n).over(w) == F.col(along) - n
        low, high = F.when(is_next(1), F.lag("z").over(w)), F.when(is_next(-1), F.lead("z").over(w))
        span = F.when(low.isNotNull(), 1).otherwise(0) + F.when(high.isNotNull(), 1).otherwise(0)
        return F.coalesce(F.try_divide(F.coalesce(high, F.col("z")) - F.coalesce(low, F.col("z")), span * size), F.lit(0.0))

    both = cells.withColumns({"__gx": step("y", "x"), "__gy": step("x", "y")})
    slope = F.degrees(F.atan(F.sqrt(F.col("__gx") * F.col("__gx") + F.col("__gy") * F.col("__gy"))))
    return both.select(*cells.columns, F.round(slope, 6).alias("slope"))


def ground(cells: DataFrame, reach: int, height: float) -> DataFrame:
    """Adds ``low``, the least elevation within ``reach`` cells to each side, and whether the cell is at most ``height`` above it."""
    line = lambda across, along: Window.partitionBy(across).orderBy(along).rangeBetween(-reach, reach)
    rows = cells.withColumn("__row", F.min("z").over(line("y", "x")))
    out = rows.withColumn("low", F.min("__row").over(line("x", "y"))).drop("__row")
    return out.withColumn("is_ground", F.col("z") - F.col("low") <= height)


def receivers(cells: DataFrame, size: float) -> DataFrame:
    """``(y, x, to_y, to_x)``: the neighbour down the steepest way, none for a pit; ties go to the first of ``AROUND``."""
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(AROUND)))
    asked = cells.select("y", "x", "z", F.explode(steps).alias("s")).withColumns({"to_y": F.col("y") + F.col("s.dy"), "to_x": F.col("x") + F.col("s.dx")})
    there = cells.select(F.col("y").alias("to_y"), F.col("x").alias("to_x"), F.col("z").alias("to_z"))
    drop = (F.col("z") - F.col("to_z")) / (size * F.sqrt(F.abs("s.dy") + F.abs("s.dx")))
    met = asked.join(there, ["to_y", "to_x"]).withColumn("drop", F.round(drop, 9))
    best = F.max_by(F.struct("to_y", "to_x"), F.struct("drop", -F.col("s.k"))).alias("to")
    down = met.where("drop > 0").groupBy("y", "x").agg(best)
    return cells.select("y", "x").join(down, ["y", "x"], "left").select("y", "x", "to.to_y", "to.to_x")


def accumulation(links: DataFrame, written) -> DataFrame:
    """``(y, x, cells)``: how many cells drain through each, itself included.

    ``links`` are ``receivers``.  After k rounds a cell has counted those
    less than 2^k steps above it and knows who lies 2^k steps below; in the
    next round it gets the counts of those that lie as far above.  Rounds
    number as the logarithm of the longest way down; ``written`` puts each
    one's rows on shared storage.
    """
    at = links.withColumn("cells", F.lit(1).cast("long"))
    while True:
        at = written(at)
        moving = at.where("to_y IS NOT NULL")
        if moving.isEmpty():
            return at.select("y", "x", "cells")
        more = moving.groupBy(F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(F.sum("cells").alias("more"))
        on = at.select(F.col("y").alias("to_y"), F.col("x").alias("to_x"), F.col("to_y").alias("next_y"), F.col("to_x").alias("next_x"))
        at = at.join(more, ["y", "x"], "left").join(on, ["to_y", "to_x"], "left").select(
            "y", "x", F.col("next_y").alias("to_y"), F.col("next_x").alias("to_x"), (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")
        )


def district_terrain(cells: DataFrame, low: float) -> DataFrame:
    """Per district: cells, mean and range of the elevation, mean slope, share below ``low``."""
    return cells.groupBy("district").agg(
        F.count("*").alias("n_cells"), F.round(F.avg("z"), 6).alias("elevation"), F.round(F.max("z") - F.min("z"), 6).alias("relief"),
        F.round(F.avg("slope"), 6).alias("slope"), F.round(F.avg((F.col("z") < low).cast("double")), 6).alias("low_share"),
    )


def sample_points(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """The elevation of the cell that each point ``(east, north)`` lies in, null outside."""
    at = points.withColumns({"y": F.floor(F.col("north") / size).cast("long"), "x": F.floor(F.col("east") / size).cast("long")})
    return at.join(cells.select("y", "x", "z"), ["y", "x"], "left").drop("y", "x")


def road_mask(cells: DataFrame, roads: DataFrame, size: float, reach: float) -> DataFrame:
    """``cells`` with ``is_road``: whether the cell's centre lies within ``reach`` of a road.

    ``roads`` are straight pieces ``(east, north, to_east, to_north)``.  A
    piece names the lines of cells it comes near, and on each the cells
    along that part of it, so candidates follow the roads' length and not
    the boxes around them; a distance decides.
    """
    line = lambda low, high: F.sequence(F.ceil(low / size - 0.5), F.floor(high / size - 0.5))  # cells by their centres
    c = F.col
    known = roads.select(*(c(k).cast("double").alias(k) for k in ("east", "north", "to_east", "to_north"))).dropna()
    known = known.withColumns({"dx": c("to_east") - c("east"), "dy": c("to_north") - c("north")})
    low, high = F.least("north", "to_north") - reach, F.greatest("north", "to_north") + reach
    near = known.where(F.ceil(low / size - 0.5) <= F.floor(high / size - 0.5)).withColumn("y", F.explode(line(low, high)))
    # the part of the piece whose north is within reach of the line's middle, as shares of its length
    middle = (c("y") + 0.5) * size
    ends = [F.try_divide(middle + k * reach - c("north"), c("dy")) for k in (-1, 1)]
    clip = lambda x, other: F.least(F.greatest(F.coalesce(x, F.lit(other)), F.lit(0.0)), F.lit(1.0))
    along = near.withColumns({"t0": clip(F.least(*ends), 0.0), "t1": clip(F.greatest(*ends), 1.0)})
    along = along.withColumns({"a": c("east") + c("t0") * c("dx"), "b": c("east") + c("t1") * c("dx")})
    left, right = F.least("a", "b") - reach, F.greatest("a", "b") + reach
    met = along.where(F.ceil(left / size - 0.5) <= F.floor(right / size - 0.5)).withColumn("x", F.explode(line(left, right)))
    px, py = (c("x") + 0.5) * size - c("east"), middle - c("north")
    share = clip(F.try_divide(px * c("dx") + py * c("dy"), c("dx") * c("dx") + c("dy") * c("dy")), 0.0)
    away = F.pow(px - share * c("dx"), 2) + F.pow(py - share * c("dy"), 2)
    hit = met.where(F.round(away, 9) <= reach * reach).select("y", "x").distinct().withColumn("is_road", F.lit(True))
    return cells.join(hit, ["y", "x"], "left").withColumn("is_road", F.coalesce("is_road", F.lit(False)))
