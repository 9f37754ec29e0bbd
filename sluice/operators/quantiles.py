"""Exact quantiles of groups of any size, without a group's values in one buffer or one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import written

#: Distinct values of a range that one task may sort, and ranges that a larger one is cut into.
FITS, RANGES = 1_000_000, 256


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: tuple[str, ...] = (), weight: str | None = None, fits: int = FITS, ranges: int = RANGES) -> DataFrame:
    """``by`` and a column per name in ``wanted``: the quantile of ``value``, interpolated between neighbours.

    Values are counted once.  A group with more distinct values than fit is
    cut into ranges by approximate edges; sums of the counts tell which
    range holds a wanted rank, and the search goes on in those ranges only,
    until they fit.  Nulls don't count; a group without values has no row.
    ``weight`` names a column that says how often a row counts.
    """
    # one column for the group, in which a null is a value like any other
    group = F.struct(*(F.col(c) for c in by)) if by else F.lit(0)
    rows = df.where(F.col(value).isNotNull()).groupBy(group.alias("__g"), F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    rows = written(rows.withColumn("__cell", F.lit("")), "quantiles")
    at = ["__g", "__cell"]
    # ranks are (name, side, rank within the cell), a few per group
    top = F.col("__all") - 1
    places = F.explode(F.flatten(F.array(*(
        F.array(*(F.struct(F.lit(name).alias("name"), F.lit(k).alias("side"), f(top * F.lit(float(q))).cast("long").alias("rank")) for k, f in enumerate((F.floor, F.ceil)))) for name, q in wanted.items()
    ))))
    sizes = rows.groupBy(*at).agg(F.sum("__n").alias("__all"))
    asked = sizes.withColumn("__p", places).select(*at, "__all", "__p.*")
    while (rows.groupBy(*at).count().agg(F.max("count")).first()[0] or 0) > fits:
        edges = rows.groupBy(*at).agg(F.percentile_approx("__v", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(10_000)).alias("__edges"))
        ranged = rows.join(edges, at).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")
        w = Window.partitionBy(*at).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``ranges`` rows
        sums = ranged.groupBy(*at, "__range").agg(F.sum("__n").alias("__sum")).withColumn("__to", F.sum("__sum").over(w))
        found = asked.join(sums, at).where((F.col("rank") < F.col("__to")) & (F.col("rank") >= F.col("__to") - F.col("__sum")))
        cell = F.concat_ws(".", "__cell", "__range").alias("__cell")
        asked = written(found.select(cell, "__g", "__all", "name", "side", (F.col("rank") - F.col("__to") + F.col("__sum")).alias("rank")), "quantiles")
        inside = ranged.select(cell, "__g", "__v", "__n").join(asked.select(*at).distinct(), at, "left_semi")
        rows = written(inside, "quantiles")
    w = Window.partitionBy(*at).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("__to", F.sum("__n").over(w))
    per = asked.groupBy(*at).agg(F.collect_list(F.struct("name", "side", "rank", "__all")).alias("__asked"))  # two for each wanted
    mine = F.filter("__asked", lambda a: (a["rank"] < F.col("__to")) & (a["rank"] >= F.col("__to") - F.col("__n")))
    hit = run.join(per, at).select("__g", "__v", F.explode(mine).alias("a"))
    ends = hit.groupBy("__g", F.col("a.name").alias("name")).agg(
        F.max(F.when(F.col("a.side") == 0, F.col("__v"))).alias("low"), F.max(F.when(F.col("a.side") == 1, F.col("__v"))).alias("high"), F.max("a.__all").alias("n")
    )
    share = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    between = lambda name: F.col("low") + (F.col("high") - F.col("low")) * (share[name] - F.floor(share[name]))
    out = ends.groupBy("__g").agg(*(F.max(F.when(F.col("name") == name, between(name))).alias(name) for name in wanted))
    return out.select(*(F.col("__g")[c].alias(c) for c in by), *wanted)



def with_quantiles(counts: DataFrame, df: DataFrame, value: str, wanted: dict[str, float], by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """``counts``, a row per group, with the rounded quantiles of ``df`` beside; null for a group without values."""
    found = quantiles(df, value, wanted, by)
    rounded = found.select(*(F.col(c).alias(f"__{c}") for c in by), *(F.round(c, digits).alias(c) for c in wanted))
    if not by:
        return counts.join(F.broadcast(rounded), how="left")  # one row
    same = [counts[c].eqNullSafe(rounded[f"__{c}"]) for c in by]
    return counts.join(rounded, same, "left").drop(*(f"__{c}" for c in by))
