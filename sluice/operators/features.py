"""Backward-window features, district and citywide aggregates, calendar terms, and their join."""

from __future__ import annotations

from functools import partial
from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.functions.timeutil import YEARLY, ahead, at, back, interval, minutes_between
from sluice.functions.timeutil import over as _over

KEYS = ("station_code", "ts")


def depth_features(readings: DataFrame, value: str = "flood", step: int = C.STEP_MINUTES, cadence: int = C.CADENCE_MINUTES, thresholds=(5, 15), by_year: bool = False) -> DataFrame:
    """Twelve autoregressive features; all windows share one partitioning and order.

    ``by_year`` keeps the years apart: no history crosses 1 January, and a
    station's windows end with its year.
    """
    key = YEARLY if by_year else "station_code"
    over = partial(_over, key=key)
    expected = 180 // cadence + 1
    base = readings.select(
        *KEYS,
        F.col(value).alias("fl_depth_now"),
        over(f"max({value})", at(minutes=step)).alias("prev_step"),
        over(f"max({value})", at(1)).alias("fl_depth_lag_1h"),
        over(f"max({value})", at(3)).alias("fl_depth_lag_3h"),
        over(f"max({value})", back(3)).alias("fl_max_3h"),
        over(f"max({value})", back(24)).alias("fl_max_24h"),
        F.round(over(f"avg({value})", back(1)), 6).alias("fl_mean_1h"),
        F.round(over(f"stddev_samp({value})", back(3)), 4).alias("fl_std_3h"),
        over(f"count({value})", back(3)).alias("seen"),
        *(
            over(f"last_value(CASE WHEN {value} >= {t} THEN ts END) IGNORE NULLS", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW").alias(f"last_{t}")
            for t in thresholds
        ),
    )
    return base.where(F.minute("ts") % step == 0).select(
        *KEYS, "fl_depth_now", "fl_depth_lag_1h", "fl_depth_lag_3h",
        F.round(F.col("fl_depth_now") - F.col("prev_step"), 6).alias(f"fl_rise_{step}min"),
        F.round(F.col("fl_depth_now") - F.col("fl_depth_lag_1h"), 6).alias("fl_rise_1h"),
        "fl_max_3h", "fl_max_24h", "fl_mean_1h", "fl_std_3h",
        F.round(F.least(F.lit(1.0), 1 - F.col("seen") / expected), 6).alias("fl_missing_share_3h"),
        *(F.round(minutes_between(f"last_{t}", "ts") / 60, 6).alias(f"fl_hours_since_{t}cm") for t in thresholds),
    )


def district_rain(readings: DataFrame, value: str, step: int = C.STEP_MINUTES, lags=(4, 12, 192), by_year: bool = False) -> DataFrame:
    """Mean, maximum, count and spread per district and grid time, with row lags of the mean.

    Thinned before the aggregation; the lags count grid rows on purpose, and
    with ``by_year`` those of the same year.
    """
    grid = readings.where(F.minute("ts") % step == 0).groupBy(F.split_part("station_code", F.lit("."), F.lit(2)).alias("district_code"), "ts")
    agg = grid.agg(F.round(F.avg(value), 6).alias("rain_now"), F.max(value).alias("rain_max"), F.count(value).alias("rain_stations"))
    w = Window.partitionBy("district_code", *([F.year("ts")] if by_year else [])).orderBy("ts")
    out = agg.withColumn("rain_spread", F.round(F.col("rain_max") - F.col("rain_now"), 6))
    out = out.withColumns({f"rain_lag_{n}": F.lag("rain_now", n).over(w) for n in lags})
    return out.withColumn("rain_antecedent_ratio", F.round(F.try_divide(F.col("rain_now"), F.nullif(F.col(f"rain_lag_{lags[-1]}"), F.lit(0.0))), 6))


def citywide_water(readings: DataFrame, value: str, lag: int = 12, excluded=(), step: int = C.STEP_MINUTES, by_year: bool = False) -> DataFrame:
    """Per time: mean and largest rise over ``lag`` rows, share rising, share offline.

    Row lags are taken before thinning.  Excluded stations stay out of the
    rises but not out of the offline share.
    """
    w = Window.partitionBy("station_code", *([F.year("ts")] if by_year else [])).orderBy("ts")
    rise = F.col(value) - F.lag(value, lag).over(w)
    used = ~F.col("station_code").isin(*excluded) if excluded else F.lit(True)
    marked = readings.withColumn("rise", rise).where(F.minute("ts") % step == 0)
    inside = F.when(used, F.col("rise"))
    return marked.groupBy("ts").agg(
        F.round(F.avg(inside), 6).alias("wl_rise_mean"),
        F.round(F.max(inside), 6).alias("wl_rise_max"),
        F.round(F.avg(F.when(inside > 0, 1.0).when(inside.isNotNull(), 0.0)), 6).alias("wl_rising_share"),
        F.round(F.avg(F.when(F.col(value).isNull(), 1.0).otherwise(0.0)), 6).alias("wl_offline_share"),
    )


def calendar(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Eight terms of the clock: day and year cycles, tide and moon, monsoon."""
    hour = F.hour(ts) + F.minute(ts) / 60
    year = F.dayofyear(ts) / 365.25
    hours = F.timestamp_diff("SECOND", F.lit(C.TIDE_EPOCH).cast("timestamp_ntz"), F.date_trunc("minute", ts).cast("timestamp_ntz")) / 3600
    wave = lambda f, x: F.round(f(2 * pi * x), 6)
    return rows.withColumns({
        "cal_hour_sin": wave(F.sin, hour / 24), "cal_hour_cos": wave(F.cos, hour / 24),
        "cal_year_sin": wave(F.sin, year), "cal_year_cos": wave(F.cos, year),
        "cal_tide_sin": wave(F.sin, hours / C.M2_HOURS), "cal_tide_cos": wave(F.cos, hours / C.M2_HOURS),
        "cal_moon_cos": wave(F.cos, hours / 24 / C.SYNODIC_DAYS),
        "cal_monsoon": F.month(ts).between(*C.MONSOON),
    })


def forward_rain(hourly: DataFrame, value: str, horizons=C.HORIZONS_HOURS, key: str = "district") -> DataFrame:
    """Forecast sum over (t, t+h], only where the stamp t+h exists; trailing sum over (t-3h, t]."""
    made = {}
    for h in horizons:
        end = f"RANGE BETWEEN {interval(h)} FOLLOWING AND {interval(h)} FOLLOWING"
        total = _over(f"sum({value})", ahead(h, first_micros=1), key)
        made[f"{value}_{h}h"] = F.when(_over("count(*)", end, key) > 0, F.round(total, 6))
    trailing = f"RANGE BETWEEN {interval(3, micros=-1)} PRECEDING AND CURRENT ROW"
    return hourly.withColumns(made | {f"{value}_past_3h": F.round(_over(f"sum({value})", trailing, key), 6)})


def feature_table(depth: DataFrame, labelled: DataFrame, rain: DataFrame, city: DataFrame, districts: DataFrame, hourly: DataFrame) -> DataFrame:
    """The wide table: labels, district rain, citywide water, district dimension, hourly external rain, calendar.

    All joins are left from the depth grid.  The district dimension is a
    registry with a row per prefix; Spark broadcasts it by its size.
    """
    base = depth.join(labelled.drop("flood"), list(KEYS), "left")
    base = base.withColumn("district_code", F.split_part("station_code", F.lit("."), F.lit(2)))
    wide = base.join(rain, ["district_code", "ts"], "left").join(city, "ts", "left").join(districts, "district_code", "left")
    wide = wide.withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    wide = wide.join(hourly.withColumnRenamed("ts", "hour_ts"), ["district", "hour_ts"], "left").drop("hour_ts")
    return calendar(wide).withColumn("rain_x_recent_flood", F.round(F.col("rain_now") * F.col("fl_max_24h"), 6))


def write_feature_table(wide: DataFrame, path: str) -> None:
    """The table in folders by year, numbers in single precision; years that ``wide`` has are replaced, others stay.

    Keys, labels and flags keep their types.  Rows are dealt by year and
    station, so a year's files don't mix and a year isn't one task.
    """
    kept = {"station_code", "ts", "district", "district_code"}
    narrow = [F.col(f.name).cast("float").alias(f.name) if f.dataType.simpleString() == "double" and f.name not in kept else F.col(f.name) for f in wide.schema]
    yearly = wide.select(*narrow).withColumn("year", F.year("ts"))
    dealt = yearly.repartition("year", F.pmod(F.xxhash64("station_code"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """The table with its ``year``; a filter by year leaves the other folders alone."""
    return spark.read.parquet(path)


def with_terrain(rows: DataFrame, terrain: DataFrame) -> DataFrame:
    """The terrain of each row's district; a district counts once, the rest of the rows stay with nulls."""
    least = F.min(F.struct(*(c for c in terrain.columns if c != "district"))).alias("least")  # of rows of one district the least
    once = terrain.groupBy("district").agg(least).select("district", "least.*")
    return rows.join(once, "district", "left").select(*rows.columns, *(c for c in terrain.columns if c != "district"))


def feature_columns(df: DataFrame) -> list[str]:
    """Inputs of a model: everything but keys, labels and onset flags."""
    keys = {"station_code", "ts", "district", "district_code", "year"}
    return [c for c in df.columns if c not in keys and not c.startswith(("y_", "is_onset_"))]
