"""Range checks and station scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import constants as C


def range_checked(raw: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their inclusive range become null; nothing is clipped."""
    return raw.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items()})


def range_flags(raw: DataFrame, ranges: dict[str, tuple[float, float]], keys: tuple[str, ...] = ()) -> DataFrame:
    """How many values of each column the check would null, in one pass over all columns."""
    return raw.groupBy(*keys).agg(*flag_counts(ranges))


def flag_counts(ranges: dict[str, tuple[float, float]]) -> list[Column]:
    return [F.count_if(F.col(c).isNotNull() & ~F.col(c).between(*r)).alias(f"flagged_{c}") for c, r in ranges.items()]


def expected_rows(days: int, cadence: int = C.CADENCE_MINUTES) -> int:
    return days * 24 * 60 // cadence


def station_profile(readings: DataFrame, value: str, expected: int, tiers=C.TIERS_CM) -> DataFrame:
    """Per station: counts, range, mean, duplicates, completeness, null share, offline flag, wet counts."""
    n = F.count("*")
    return readings.groupBy("station_code").agg(
        n.alias("n_rows"),
        F.countDistinct("ts").alias("n_distinct_ts"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(value).alias("n_values"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.round(F.avg(value), 6).alias("mean_value"),
        *(F.count_if(F.col(value) >= t).alias(f"n_ge{t}") for t in tiers),
    ).withColumns({
        "n_duplicates": F.col("n_rows") - F.col("n_distinct_ts"),
        "completeness": F.round(F.col("n_distinct_ts") / expected, 6),
        "null_pct": F.round(100 * (F.col("n_rows") - F.col("n_values")) / F.col("n_rows"), 6),
        "offline": (F.col("n_rows") - F.col("n_values")) / F.col("n_rows") > C.OFFLINE_NULL_SHARE,
    })


def scorecard(*profiles: DataFrame) -> DataFrame:
    """The profiles below one another on the columns they share."""
    common = [c for c in profiles[0].columns if all(c in p.columns for p in profiles)]
    out = profiles[0].select(common)
    for p in profiles[1:]:
        out = out.unionByName(p.select(common))
    return out


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, nulls and null share, from one aggregate."""
    wide = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    parts = ", ".join(f"'{c}', n, {c}" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {parts}) AS (feature, n_rows, n_values)").withColumn(
        "null_share", F.round(1 - F.col("n_values") / F.col("n_rows"), 6)
    )


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum and null percentage of each column."""
    wide = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("k", F.count))))
    parts = ", ".join(f"'{c}', lo_{c}, hi_{c}, n, k_{c}" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {parts}) AS (column_name, min_value, max_value, n, k)").select(
        "column_name", "min_value", "max_value", F.round(100 * (F.col("n") - F.col("k")) / F.col("n"), 6).alias("null_pct")
    )
