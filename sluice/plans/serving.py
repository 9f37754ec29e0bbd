"""Read-only views a service would answer from: a function per endpoint, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.functions.timeutil import floor_minutes
from sluice.operators.quantiles import quantiles


def district():
    return F.split_part("station_code", F.lit("."), F.lit(2))



def _at(ts: str):
    return F.lit(ts).cast("timestamp_ntz")


def resolve_timestamp(df: DataFrame, step: int = C.STEP_MINUTES) -> DataFrame:
    return df.withColumn("ts", floor_minutes("ts", step))


def served_at(requests: DataFrame, available: DataFrame, step: int = C.STEP_MINUTES) -> DataFrame:
    """The step each requested ``ts`` falls on, the last one for a request without a time, and whether it is ``served``."""
    snapped = resolve_timestamp(requests, step).crossJoin(F.broadcast(available.select("first_ts", "last_ts")))  # one row
    ts = F.coalesce("ts", "last_ts")
    return snapped.withColumns({"served": ts.between(F.col("first_ts"), F.col("last_ts")), "ts": ts}).drop("first_ts", "last_ts")


def window_before(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows of (t - hours, t]."""
    return df.where((F.col("ts") > _at(ts) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= _at(ts)))


def observations(df: DataFrame, ts: str, hours: int, value: str = "flood", tiers=C.TIERS_CM) -> DataFrame:
    return window_before(df, ts, hours).groupBy("ts").agg(
        F.round(F.avg(value), 6).alias("mean_depth"), F.max(value).alias("max_depth"), *(F.count_if(F.col(value) >= t).alias(f"n_ge{t}") for t in tiers)
    )


def rain_by_district(df: DataFrame, ts: str, hours: int, value: str = "flood") -> DataFrame:
    return window_before(df, ts, hours).groupBy(district().alias("district")).agg(F.round(F.avg(value), 6).alias("mean_rain"), F.max(value).alias("max_rain"))


def station_history(df: DataFrame, station: str, ts: str, hours: int) -> DataFrame:
    return window_before(df.where(F.col("station_code") == station), ts, hours).orderBy("ts")


def hours_above(df: DataFrame, k: int, value: str = "flood", tiers=C.TIERS_CM, per_hour: float = 4.0) -> DataFrame:
    """Stations by hours at or above the middle tier; ties by code."""
    agg = df.groupBy("station_code").agg(*(F.round(F.count_if(F.col(value) >= t) / per_hour, 6).alias(f"hours_ge{t}") for t in tiers), F.max(value).alias("max_depth"))
    return agg.orderBy(F.desc(f"hours_ge{tiers[1]}"), "station_code").limit(k)


def available_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("ts").alias("n_steps"))


def forecast_at(scored: DataFrame, ts: str, tier: float, threshold: float, value: str = "flood", prob: str = "prob") -> DataFrame:
    """Per station: offline, flooded now, at risk or clear; a probability is only served for a dry station."""
    now = scored.where(F.col("ts") == _at(ts))
    dry = F.col(value) < tier
    status = F.when(F.col(value).isNull(), "offline").when(~dry, "flooded_now").when(F.col(prob) >= threshold, "at_risk").otherwise("clear")
    return now.select(
        "station_code", district().alias("district"), status.alias("status"), F.when(dry, F.round(prob, 6)).alias("probability"),
        F.coalesce(~dry | (F.col(prob) >= threshold), F.lit(False)).alias("alert"), F.col(value).alias("depth_now"),
    )


def district_risk(forecast: DataFrame) -> DataFrame:
    """Stations, alerts, flooded stations and the largest probability per district, with a level by the alerting share."""
    g = forecast.groupBy("district").agg(
        F.count("*").alias("n_stations"), F.sum(F.col("alert").cast("long")).alias("n_alerts"),
        F.count_if(F.col("status") == "flooded_now").alias("n_flooded"), F.max("probability").alias("max_probability"),
    )
    share = F.col("n_alerts") / F.col("n_stations")
    return g.withColumn("level", F.when(share <= 0, "none").when(share <= 0.34, "low").when(share <= 0.67, "moderate").otherwise("high"))


def area_forecast(scored: DataFrame, ts: str, value: str = "flood") -> DataFrame:
    now = scored.where(F.col("ts") == _at(ts))
    rest = now.agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))
    return quantiles(now, value, {"p95": 0.95}).select(F.round("p95", 6).alias("p95")).join(rest, how="right").select("p95", "mean", "max", "n")  # one row each


def alert_level(p95: dict[int, str], now: str):
    """Ordered levels from the 95th percentile at each horizon and the present depth."""
    over = [F.col(c) >= C.WARNING_P95_CM[h] for h, c in p95.items()]
    any_over = over[0]
    for o in over[1:]:
        any_over = any_over | o
    return F.when(F.col(now) >= 2 * C.TIERS_CM[2], "critical").when(any_over | (F.col(now) >= C.TIERS_CM[2]), "warning").when(F.col(now) >= C.TIERS_CM[1], "advisory").otherwise("watch")


def cap_alerts(forecast: DataFrame, ts: str, tier: int, horizon: int, status: str = "Test") -> DataFrame:
    """One alert message per alerting station as JSON; the status comes from the configuration, never the data."""
    severity = {5: "Minor", 15: "Moderate", 30: "Severe"}[tier]
    body = F.struct(
        F.concat(F.lit("alert-"), "station_code", F.lit("-" + ts.replace(" ", "T"))).alias("identifier"), F.lit(ts).alias("sent"), F.lit(status).alias("status"),
        F.lit("Restricted").alias("scope"), F.lit("Expected" if horizon > 1 else "Immediate").alias("urgency"), F.lit(severity).alias("severity"),
        F.when(F.col("status") == "flooded_now", "Observed").otherwise("Likely").alias("certainty"), F.col("district").alias("areaDesc"),
    )
    return forecast.where("alert").select("station_code", F.to_json(body).alias("alert"))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities of double columns to null."""
    return df.withColumns({
        c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")
    })
