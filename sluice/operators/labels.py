"""Forward-window labels that never see the present reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.functions.timeutil import YEARLY, ahead, over


def labels(
    readings: DataFrame, tiers=C.TIERS_CM, horizons=C.HORIZONS_HOURS, value: str = "flood", step: int = C.STEP_MINUTES,
    cadence: int = C.CADENCE_MINUTES, min_share: float = C.MIN_VALID_SHARE, by_year: bool = False,
) -> DataFrame:
    """Per reading and horizon: the deepest later value, whether enough is observed, and per tier the label.

    The window runs from one cadence after the reading to the horizon, on
    the full grid; rows are thinned to ``step`` minutes afterwards.  A label
    is null where less than ``min_share`` of the window was observed, and an
    onset flag is null where the present value is.  ``by_year`` ends every
    window with its year.
    """
    key = YEARLY if by_year else "station_code"
    made: dict[str, Column] = {}
    for h in horizons:
        frame = ahead(h, first_minutes=cadence)
        made[f"y_maxdepth_{h}h"] = over(f"max({value})", frame, key)
        made[f"y_obs_{h}h"] = over(f"count({value})", frame, key)
    out = readings.withColumns(made).where(F.minute("ts") % step == 0)
    for h in horizons:
        share = F.round(F.col(f"y_obs_{h}h") / F.lit(h * 60 / cadence), 6)
        valid = F.col(f"y_obs_share_{h}h") >= min_share
        out = out.withColumn(f"y_obs_share_{h}h", share).withColumn(f"y_valid_{h}h", valid).drop(f"y_obs_{h}h")
        out = out.withColumns({f"y_ge{t}_{h}h": F.when(valid, F.col(f"y_maxdepth_{h}h") >= t) for t in tiers})
    return out.withColumns({f"is_onset_{t}": F.col(value) < t for t in tiers})


def scorable(labelled: DataFrame, horizon: int) -> DataFrame:
    """Rows whose label counts; unknown validity does not."""
    return labelled.where(F.coalesce(F.col(f"y_valid_{horizon}h"), F.lit(False)))


def embargoed(rows: DataFrame, boundary: str, hours: int = C.EMBARGO_HOURS, ts: str = "ts") -> DataFrame:
    """Rows that end ``hours`` before a split's boundary."""
    return rows.where(F.col(ts) < F.lit(boundary).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def summary(labelled: DataFrame, tiers=C.TIERS_CM, horizons=C.HORIZONS_HOURS) -> DataFrame:
    """One row per tier and horizon: rows, valid rows, positives, onsets among them; one scan."""
    wide, parts = [], []
    for t in tiers:
        for h in horizons:
            name = f"{t}_{h}"
            valid, y = F.col(f"y_valid_{h}h"), F.col(f"y_ge{t}_{h}h")
            wide += [
                F.count_if(valid).alias(f"v_{name}"), F.count_if(y).alias(f"p_{name}"), F.count_if(y & F.col(f"is_onset_{t}")).alias(f"o_{name}"),
            ]
            parts.append(f"{t}, {h}, n, v_{name}, p_{name}, o_{name}")
    one = labelled.agg(F.count("*").alias("n"), *wide)
    return one.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (tier_cm, horizon_h, n_rows, n_valid, n_positive, n_onset)")


def check_by_join(readings: DataFrame, labelled: DataFrame, horizon: int, value: str = "flood", cadence: int = C.CADENCE_MINUTES) -> DataFrame:
    """Recompute the deepest later value by an interval join and keep the rows that disagree.

    Both sides are cut into horizon-long buckets, so the range condition is
    tested against two buckets of a station and not all its readings.
    """
    size = horizon * 3600
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (size * 1_000_000)).cast("long")
    now = labelled.select("station_code", "ts", f"y_maxdepth_{horizon}h", F.explode(F.array(bucket("ts"), bucket("ts") + 1)).alias("bucket"))
    later = readings.select("station_code", F.col("ts").alias("later_ts"), F.col(value).alias("later"), bucket("ts").alias("bucket"))
    inside = (F.col("later_ts") >= F.col("ts") + F.expr(f"INTERVAL {cadence} MINUTES")) & (F.col("later_ts") <= F.col("ts") + F.expr(f"INTERVAL {horizon} HOURS"))
    joined = now.join(later, ["station_code", "bucket"], "left").groupBy("station_code", "ts").agg(
        F.max(f"y_maxdepth_{horizon}h").alias("label"), F.max(F.when(inside, F.col("later"))).alias("again")
    )
    return joined.where(~F.col("label").eqNullSafe(F.col("again")))
