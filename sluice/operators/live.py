"""Live mode: what the newest polls say about now, cold start, and a forecast per station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.plans.serving import alert_level


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _hours(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n * 3600).cast("decimal(18,6)"))


def coverage(polls: DataFrame, sources: tuple[str, ...], hours: float = C.COLD_START_HOURS) -> DataFrame:
    """One row per source: polls, rows, first and last, hours between, and whether that is too little history.

    ``polls`` is ``(source, polled_at)``, a row a reading.  A source without
    any poll is cold.
    """
    spark = polls.sparkSession
    names = spark.createDataFrame([(s,) for s in sources], "source string")  # a handful
    seen = polls.groupBy("source").agg(
        F.countDistinct("polled_at").alias("polls"), F.count("*").alias("n_rows"), F.min("polled_at").alias("first_poll"), F.max("polled_at").alias("last_poll")
    )
    length = F.round(F.timestamp_diff("SECOND", F.col("first_poll"), F.col("last_poll")) / 3600, 3)
    out = F.broadcast(names).join(seen, "source", "left").withColumn("hours", F.coalesce(length, F.lit(0.0)))
    return out.select(
        "source", F.coalesce("polls", F.lit(0).cast("long")).alias("polls"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        "first_poll", "last_poll", "hours", (F.col("hours") < hours).alias("cold_start"),
    )


def cold_start(polls: DataFrame, sources: tuple[str, ...], hours: float = C.COLD_START_HOURS) -> DataFrame:
    """One row: whether any source has too little history."""
    return coverage(polls, sources, hours).agg(F.bool_or("cold_start").alias("cold_start"), F.min("hours").alias("least_hours"))


def water_snapshot(polls: DataFrame, now: str, lookback: float = 6) -> DataFrame:
    """One row of citywide water terms from the newest poll of the last ``lookback`` hours; null where it says nothing.

    ``polls`` is ``(polled_at, level, rise, flow)``.  The three-hour rise
    compares the newest known mean level with that of the newest poll at
    least three hours before the newest poll.
    """
    recent = polls.where((F.col("polled_at") >= _at(now) - _hours(lookback)) & (F.col("polled_at") <= _at(now)))
    n = F.count("*")
    per = recent.groupBy("polled_at").agg(
        F.round(F.avg("rise"), 6).alias("water_rise_1h_mean"), F.max("rise").alias("water_rise_1h_max"),
        F.round(F.try_divide(F.count_if(F.col("rise") > 0), F.count("rise")), 6).alias("water_rising_share"),
        F.round(1 - F.count("level") / n, 6).alias("water_offline_share"),
        F.round(F.avg("flow"), 6).alias("flow_mean"),
        F.round(F.try_divide(F.count_if(F.col("flow") < 0), F.count("flow")), 6).alias("flow_negative_share"),
        F.round(1 - F.count("flow") / n, 6).alias("flow_offline_share"),
        F.avg("level").alias("mean_level"),
    )
    newest = per.agg(F.max("polled_at").alias("newest"))
    terms = [c for c in per.columns if c not in ("polled_at", "mean_level")]
    marked = per.crossJoin(F.broadcast(newest))  # one row
    known = F.when(F.col("mean_level").isNotNull(), F.col("polled_at"))
    old = F.when(F.col("polled_at") <= F.col("newest") - _hours(3), known)
    return marked.agg(
        F.max("newest").alias("polled_at"), *(F.max_by(c, "polled_at").alias(c) for c in terms),
        F.round(F.max_by("mean_level", known) - F.max_by("mean_level", old), 6).alias("water_rise_3h_mean"),
    )


def rain_outlook(rows: DataFrame, horizons=C.HORIZONS_HOURS) -> DataFrame:
    """One row: forecast rain of the newest poll, summed over leads (0, h] per district, then averaged.

    ``rows`` is ``(polled_at, district, is_forecast, lead_hours, precipitation)``.
    """
    newest = rows.agg(F.max("polled_at").alias("newest"))
    ahead = rows.join(F.broadcast(newest), F.col("polled_at") == F.col("newest")).where("is_forecast")
    inside = lambda h: F.when((F.col("lead_hours") > 0) & (F.col("lead_hours") <= h), F.col("precipitation"))
    per = ahead.groupBy("district").agg(*(F.sum(inside(h)).alias(f"h{h}") for h in horizons))
    return per.agg(*(F.round(F.avg(f"h{h}"), 6).alias(f"rain_fcst_{h}h") for h in horizons))


def rain_features_at(readings: DataFrame, now: str, hours=(1, 3, 6, 24), value: str = "rain") -> DataFrame:
    """Per station the sums over (now - h, now]; unseen rain counts as none, and how much was seen is told beside it."""
    recent = readings.where((F.col("ts") > _at(now) - _hours(max(hours))) & (F.col("ts") <= _at(now)))
    inside = lambda h: F.col("ts") > _at(now) - _hours(h)
    sums = (F.round(F.sum(F.when(inside(h), F.coalesce(F.col(value), F.lit(0.0))).otherwise(0.0)), 6).alias(f"rain_{h}h") for h in hours)
    return recent.groupBy("station_code").agg(*sums, F.count(value).alias("n_seen"))


def live_features(stations: DataFrame, depth: DataFrame, rain: DataFrame, water: DataFrame, outlook: DataFrame) -> DataFrame:
    """A row for every station of the registry; citywide terms are the same for all, absent sources stay null."""
    out = stations.select("station_code").join(depth, "station_code", "left").join(rain, "station_code", "left")
    return out.crossJoin(F.broadcast(water)).crossJoin(F.broadcast(outlook))  # one row each


def live_forecast(scored: DataFrame, cold: DataFrame, tier: float, threshold: float) -> DataFrame:
    """Status, alert and level of every station; a flooded station has no probability.

    ``scored`` is ``(station_code, depth_now, prob)``, ``cold`` the one row
    of ``cold_start``, which is told beside every answer and decides none.
    """
    flooded = F.coalesce(F.col("depth_now") >= tier, F.lit(False))
    likely = F.coalesce(F.col("prob") >= threshold, F.lit(False))
    out = scored.crossJoin(F.broadcast(cold.select("cold_start")))
    return out.select(
        "station_code", "depth_now", F.when(~flooded, F.round("prob", 6)).alias("probability"), (flooded | likely).alias("alert"),
        F.when(flooded, "flooded_now").when(likely, "at_risk").when(F.col("depth_now").isNull() & F.col("prob").isNull(), "unknown").otherwise("clear").alias("status"),
        "cold_start",
    )


def live_status(forecast: DataFrame) -> DataFrame:
    """One row: stations, those that are known, flooded and alerted, and the alert level of the deepest."""
    one = forecast.agg(
        F.count("*").alias("n_stations"), F.count("depth_now").alias("n_known"), F.count_if(F.col("status") == "flooded_now").alias("n_flooded"),
        F.count_if("alert").alias("n_alerts"), F.max("depth_now").alias("deepest"), F.bool_or("cold_start").alias("cold_start"),
    )
    return one.withColumn("level", alert_level({1: "deepest"}, "deepest"))


def with_coordinates(stations: DataFrame, registry: DataFrame, city: tuple[float, float]) -> DataFrame:
    """``lat``, ``lon`` and where they come from: the registry, else the mean of the prefix, else the city's centre."""
    prefix = F.split_part("station_code", F.lit("."), F.lit(2))
    known = registry.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    own = known.groupBy("station_code").agg(F.min_by("lat", F.struct("lat", "lon")).alias("own_lat"), F.min_by("lon", F.struct("lat", "lon")).alias("own_lon"))
    mean = known.groupBy(prefix.alias("prefix")).agg(F.round(F.avg("lat"), 5).alias("mean_lat"), F.round(F.avg("lon"), 5).alias("mean_lon"))
    out = stations.join(own, "station_code", "left").withColumn("prefix", prefix).join(mean, "prefix", "left")
    source = F.when(F.col("own_lat").isNotNull(), "registry").when(F.col("mean_lat").isNotNull(), "prefix").otherwise("city")
    return out.select(
        *stations.columns, F.coalesce("own_lat", "mean_lat", F.lit(city[0])).alias("lat"), F.coalesce("own_lon", "mean_lon", F.lit(city[1])).alias("lon"), source.alias("coord_source")
    )
