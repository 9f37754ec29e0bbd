"""Semi-structured payloads to rows: declared schemas, aliases, keyword flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.stores import vertex_mean

FORECAST = "struct<hourly:struct<time:array<string>,precipitation:array<double>>>"
REPORTS = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<ticket_id:string,comment:string,type:string,province:string,timestamp:string>>>>"
LEVELS = "array<struct<code:string,name:string,status:string,level:string,phone:string,pumps:array<struct<name:string,running:boolean>>>>"


def any_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, literally and in any case; null is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words))


def forecast_rows(payloads: DataFrame, body: str = "body", now: str = "fetched_at") -> DataFrame:
    """Parallel arrays of times and rain to rows, with lead time in hours."""
    parsed = payloads.withColumn("x", F.from_json(body, FORECAST))
    rows = parsed.select("*", F.explode(F.arrays_zip("x.hourly.time", "x.hourly.precipitation")).alias("r"))
    ts = F.try_to_timestamp(F.col("r.time"), F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")
    lead = F.timestamp_diff("SECOND", F.col(now), ts) / 3600
    return rows.select(*[c for c in payloads.columns if c != body], ts.alias("ts"), F.col("r.precipitation").alias("precipitation"),
                       (ts >= F.col(now)).alias("is_forecast"), F.round(lead, 2).alias("lead_hours"))


def report_rows(payloads: DataFrame, words: tuple[str, ...], bbox: dict | None = None, province: str | None = None, body: str = "body") -> DataFrame:
    """Citizen reports of a feature collection; coordinates come as [lon, lat].

    The province decides where any report names one, else the box does.
    The first report of a ticket stays.
    """
    f = payloads.select(F.posexplode(F.from_json(body, REPORTS)["features"]).alias("k", "f"))
    p = F.col("f.properties")
    rows = f.select("k", p["ticket_id"].alias("ticket_id"), p["comment"].alias("comment"), p["province"].alias("province"),
                    F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("lon"), F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("lat"),
                    any_keyword(F.concat_ws(" ", p["comment"], p["type"]), words).alias("is_flood"))
    if bbox:
        named = rows.agg(F.coalesce(F.bool_or(F.col("province").isNotNull()), F.lit(False)).alias("named"))
        boxed = F.col("lat").between(*bbox["lat"]) & F.col("lon").between(*bbox["lon"])
        rows = rows.crossJoin(F.broadcast(named)).where(F.when(F.col("named"), F.col("province").contains(province or "")).otherwise(boxed)).drop("named")
    w = Window.partitionBy("ticket_id").orderBy("k")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "k")


OUTLINES = "struct<features:array<struct<properties:struct<dname:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"


def district_points(payloads: DataFrame, body: str = "body") -> DataFrame:
    """``(district, lat, lon)``: the mean of a district's vertices over all its rings; polygons of a feature collection."""
    f = payloads.select(F.explode(F.from_json(body, OUTLINES)["features"]).alias("f"))
    return vertex_mean(f.select(F.col("f.properties.dname").alias("district"), F.flatten("f.geometry.coordinates").alias("coordinates")))


WATER = (
    "struct<data:struct<waterlevel_data:struct<data:array<struct<station:struct<id:long,name:string,lat:string,long:string,left_bank:string,right_bank:string,min_bank:string>,"
    "geocode:struct<subdistrict:string,district:string>,agency:string,river_name:string,waterlevel_datetime:string,waterlevel_msl:string,waterlevel_msl_previous:string,"
    "flow_rate:string,discharge:string,diff_wl_bank:string>>>>>"
)
#: Hours that the source's clock is ahead of UTC.
SOURCE_OFFSET_HOURS = 7


def water_rows(payloads: DataFrame, body: str = "body", now: str = "fetched_at") -> DataFrame:
    """Water levels out of their nested envelope: UTC times, a label that always exists, a signed rise.

    Numbers come as text; what isn't one is null.  A bank that is unknown or
    not above zero can't be a reference; the difference to it is then told
    in the raw column only.  Rows without a time stay.
    """
    records = F.explode(F.from_json(body, WATER)["data"]["waterlevel_data"]["data"]).alias("r")
    rows = payloads.select(F.col(now), records)
    n = lambda c: F.expr(f"try_cast({c} AS double)")
    local = F.try_to_timestamp(F.col("r.waterlevel_datetime"), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    ts = local - F.expr(f"INTERVAL {SOURCE_OFFSET_HOURS} HOURS")
    out = rows.select(
        F.col("r.station.id").alias("station_id"), ts.alias("ts"), local.alias("ts_local"),
        F.round(F.timestamp_diff("SECOND", ts, F.col(now)) / 60, 1).alias("age_minutes"),
        F.coalesce("r.station.name", "r.river_name", "r.geocode.subdistrict", F.concat(F.lit("station_"), F.col("r.station.id").cast("string"))).alias("station_label"),
        n("r.station.lat").alias("lat"), n("r.station.long").alias("lon"), n("r.waterlevel_msl").alias("level"), n("r.waterlevel_msl_previous").alias("level_before"),
        n("r.flow_rate").alias("flow_rate"), n("r.discharge").alias("discharge"), n("r.diff_wl_bank").alias("diff_wl_bank"), n("r.station.min_bank").alias("min_bank"),
        F.col(now).alias("polled_at"),
    )
    valid = F.coalesce(F.col("min_bank") > 0, F.lit(False))
    return out.withColumns({
        "bank_ref_valid": valid, "diff_wl_bank_clean": F.when(valid, F.col("diff_wl_bank")), "rise": F.round(F.col("level") - F.col("level_before"), 6),
        "flow": F.coalesce("flow_rate", "discharge"),
    })


def pump_rows(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Pump stations by an explicit projection, so personal fields never pass; an offline level stays null."""
    s = F.col("s")
    told = payloads.select(F.explode(F.from_json(body, LEVELS)).alias("s"))
    rows = told.select(
        s["code"].alias("code"), F.nullif(F.regexp_extract(s["code"], r"^[A-Z]+\.([A-Z]+)\.", 1), F.lit("")).alias("prefix"),
        F.when(~s["status"].eqNullSafe("offline"), F.expr("try_cast(s.level AS double)")).alias("level_m"),
        F.size(F.filter(s["pumps"], lambda p: p["running"])).alias("n_running"),
        F.array_join(F.transform(F.filter(s["pumps"], lambda p: p["running"]), lambda p: p["name"]), ",").alias("running"),
    )
    names = [c for c in rows.columns if c != "code"]
    # a station that is told of twice: the greater row, whatever the order of arrival
    return rows.groupBy("code").agg(F.max(F.struct(*names)).alias("r")).select("code", "r.*")


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]], version: str) -> DataFrame:
    """Columns by the first alias that matches exactly, else as a dotted suffix, else null; the rest as ``raw_*``."""
    used, out = set(), []
    for name, options in aliases.items():
        hit = next((c for o in options for c in df.columns if c == o), None) or next((c for o in options for c in df.columns if c.endswith("." + o)), None)
        used.add(hit)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    rest = [F.col(f"`{c}`").alias("raw_" + c.replace(".", "_")) for c in df.columns if c not in used]
    return df.select(*out, *rest, F.lit(version).alias("_collector_version"))
