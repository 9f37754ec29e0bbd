"""Threshold excursions and the events they merge into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.functions.timeutil import minutes_between


def excursions(readings: DataFrame, tiers=C.TIERS_CM, value: str = "flood", cadence: int = C.CADENCE_MINUTES) -> DataFrame:
    """Runs of readings at or above each tier, one pass for all tiers.

    A run breaks at a reading below the tier, and at a hole longer than the
    cadence; readings without a value are holes, not dry readings.
    """
    tier = F.explode(F.array(*(F.lit(float(t)) for t in tiers))).alias("tier_cm")
    w = Window.partitionBy("station_code", "tier_cm").orderBy("ts")
    marked = (
        readings.where(F.col(value).isNotNull())
        .select("station_code", "ts", F.col(value).alias("depth"), tier)
        .withColumn("above", F.col("depth") >= F.col("tier_cm"))
        .withColumns({"was_above": F.lag("above").over(w), "was_ts": F.lag("ts").over(w)})
    )
    starts = F.col("above") & (
        F.col("was_above").isNull() | ~F.col("was_above") | (minutes_between("was_ts", "ts") > cadence)
    )
    run = F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.withColumn("run", run)
        .where("above")
        .groupBy("station_code", "tier_cm", "run")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.count("*").alias("n_readings"),
            F.max("depth").alias("peak_depth_cm"),
        )
        .drop("run")
    )


def assemble(
    runs: DataFrame,
    persistence: int = C.PERSISTENCE_READINGS,
    merge_gap: int = C.MERGE_GAP_MINUTES,
    min_minutes: int = C.MIN_EVENT_MINUTES,
    cadence: int = C.CADENCE_MINUTES,
    keys: tuple[str, ...] = ("station_code", "tier_cm"),
) -> DataFrame:
    """Persistent runs, merged over gaps of at most ``merge_gap`` minutes, of at least ``min_minutes``.

    ``persistence``, ``merge_gap`` and ``min_minutes`` may be columns of
    ``runs`` by name.
    """
    p, g, m = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (persistence, merge_gap, min_minutes))
    w = Window.partitionBy(*keys).orderBy("started_at")
    gap = minutes_between(F.lag("ended_at").over(w), "started_at")
    kept = runs.where(F.col("n_readings") >= p).withColumn("fresh", F.coalesce(gap > g, F.lit(True)).cast("int"))
    number = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = kept.withColumn("event", number).groupBy(*keys, "event").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.sum("n_readings").alias("n_readings"),
        F.max("peak_depth_cm").alias("peak_depth_cm"),
        F.count("*").alias("n_excursions_merged"),
        F.first(m).alias("least_minutes"),
    )
    minutes = F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")) / 60 + cadence
    return (
        merged.withColumn("duration_minutes", F.floor(minutes).cast("long"))
        .where(F.col("duration_minutes") >= F.col("least_minutes"))
        .withColumn("year", F.year("started_at"))
        .drop("event", "least_minutes")
    )


def detect(readings: DataFrame, tiers=C.TIERS_CM, value: str = "flood", cadence: int = C.CADENCE_MINUTES, **rules) -> DataFrame:
    """Events of every tier in one plan: one shuffle, since both steps group by station and tier."""
    return assemble(excursions(readings, tiers, value, cadence), cadence=cadence, **rules)


def sensitivity(runs: DataFrame, persistence, merge_gaps, cadence: int = C.CADENCE_MINUTES) -> DataFrame:
    """Event counts per tier for a grid of rules, from runs detected once."""
    spark = runs.sparkSession
    grid = spark.createDataFrame([(p, g) for p in persistence for g in merge_gaps], "persistence int, merge_gap int")
    found = assemble(
        runs.crossJoin(F.broadcast(grid)), "persistence", "merge_gap", cadence=cadence, keys=("station_code", "tier_cm", "persistence", "merge_gap")
    )
    return found.groupBy("tier_cm", "persistence", "merge_gap").agg(F.count("*").alias("n_events"))


def class_balance(readings: DataFrame, tiers=C.TIERS_CM, value: str = "flood") -> DataFrame:
    """Readings at or above each tier by year, in percent and as one in how many."""
    wet = {t: F.count_if(F.col(value) >= t) for t in tiers}
    n = F.count(value)
    return readings.groupBy(F.year("ts").alias("year")).agg(
        n.alias("n"),
        *(c.alias(f"n_ge{t}") for t, c in wet.items()),
        *(F.round(F.try_divide(100 * c, n), 5).alias(f"pct_ge{t}") for t, c in wet.items()),
        *(F.round(F.try_divide(n, c), 0).alias(f"one_in_ge{t}") for t, c in wet.items()),
    )


def hotspots(events: DataFrame, k: int) -> DataFrame:
    """The ``k`` stations with most events; ties by code."""
    return (
        events.groupBy("station_code")
        .agg(
            F.count("*").alias("n_events"),
            F.sum("duration_minutes").alias("total_minutes"),
            F.max("peak_depth_cm").alias("max_depth_cm"),
            F.min("started_at").alias("first_event"),
            F.max("ended_at").alias("last_event"),
        )
        .orderBy(F.desc("n_events"), "station_code")
        .limit(k)
    )
