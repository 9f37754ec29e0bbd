"""Live mode, raw polls and the feature table's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators import evaluation, features, live, metrics, quality
from sluice.plans import boosting
from sluice.registry import add
from sluice.session import shared_dir, written
from sluice.sources import pages, payloads, raw, stores

from .base import GRID, READINGS, grid, readings, table
from .core import DEPTH, EXTERNAL, H, SCORED, TIERS, WIDE, _metrics_sql, depth, districts, hourly, labelled, scored, wide
from .serving import AT, CARRIED, SQL_AT, carried

SOURCES = ("CLI", "ERR", "PUR", "SIG", "XXX")


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly polls of a level per station; every other station tells a flow."""
    per = grid(spark, sf).groupBy("station_code", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("polled_at")).agg(F.round(F.avg("flood") / 100, 6).alias("level"))
    rise = F.round(F.col("level") - F.lag("level").over(Window.partitionBy("station_code").orderBy("polled_at")), 6)
    return per.withColumns({"rise": rise, "flow": F.when(F.substring("station_code", -1, 1).isin("1", "3"), F.col("level") - 1)})


POLLS = GRID + """, poll0 AS (SELECT station_code, date_trunc('hour', ts) AS polled_at, round(avg(flood) / 100, 6) AS level FROM grid GROUP BY 1, 2),
polls AS (SELECT *, round(level - lag(level) OVER (PARTITION BY station_code ORDER BY polled_at), 6) AS rise,
    CASE WHEN station_code[-1] IN ('1', '3') THEN level - 1 END AS flow FROM poll0)"""
SNAPSHOT = f"""recent AS (SELECT * FROM polls WHERE polled_at >= {SQL_AT} - INTERVAL 6 HOURS AND polled_at <= {SQL_AT}),
per AS (SELECT polled_at, round(avg(rise), 6) AS water_rise_1h_mean, max(rise) AS water_rise_1h_max, round(count(*) FILTER (WHERE rise > 0) / nullif(count(rise), 0), 6) AS water_rising_share,
    round(1 - count(level) / count(*), 6) AS water_offline_share, round(avg(flow), 6) AS flow_mean, round(count(*) FILTER (WHERE flow < 0) / nullif(count(flow), 0), 6) AS flow_negative_share,
    round(1 - count(flow) / count(*), 6) AS flow_offline_share, avg(level) AS mean_level FROM recent GROUP BY 1),
newest AS (SELECT max(polled_at) AS n FROM per),
water AS (SELECT per.* EXCLUDE (mean_level), round((SELECT mean_level FROM per WHERE mean_level IS NOT NULL ORDER BY polled_at DESC LIMIT 1)
    - (SELECT mean_level FROM per, newest WHERE mean_level IS NOT NULL AND polled_at <= n - INTERVAL 3 HOURS ORDER BY polled_at DESC LIMIT 1), 6) AS water_rise_3h_mean FROM per, newest WHERE polled_at = n)"""


def water(spark: SparkSession, sf: str) -> DataFrame:
    return live.water_snapshot(polls(spark, sf), AT)


add("a34_live_water", water, f"WITH {POLLS}, {SNAPSHOT} SELECT * FROM water")


def sourced(spark: SparkSession, sf: str) -> DataFrame:
    """Polls by source; one source has begun late and one never."""
    all_ = readings(spark, sf).select(F.split_part("station_code", F.lit("."), F.lit(2)).alias("source"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("polled_at"))
    return all_.where((F.col("source") != "SIG") | (F.col("polled_at") >= F.lit("2024-01-30").cast("timestamp_ntz")))


COVERAGE = READINGS + f""", sourced AS (SELECT split_part(station_code, '.', 2) AS source, date_trunc('hour', ts) AS polled_at FROM readings),
coverage AS (SELECT source, count(DISTINCT polled_at) AS polls, count(polled_at) AS n_rows, min(polled_at) AS first_poll, max(polled_at) AS last_poll,
    coalesce(round(epoch(max(polled_at) - min(polled_at)) / 3600, 3), 0)::DOUBLE AS hours, coalesce(round(epoch(max(polled_at) - min(polled_at)) / 3600, 3), 0) < 24 AS cold_start
    FROM (VALUES {', '.join(f"('{s}')" for s in SOURCES)}) v(source) LEFT JOIN (SELECT * FROM sourced WHERE source <> 'SIG' OR polled_at >= TIMESTAMP '2024-01-30') USING (source) GROUP BY 1)"""
add("d26_cold_start", lambda s, d: live.coverage(sourced(s, d), SOURCES), f"WITH {COVERAGE} SELECT * FROM coverage")
add("t07_cold_start", lambda s, d: live.cold_start(sourced(s, d), SOURCES[:3]), f"WITH {COVERAGE} SELECT bool_or(cold_start) AS cold_start, min(hours) AS least_hours FROM coverage WHERE source IN ('CLI', 'ERR', 'PUR')")
TRAILING = f"""recent_rain AS (SELECT station_code, {', '.join(f"round(sum(CASE WHEN ts > {SQL_AT} - INTERVAL {h} HOURS THEN coalesce(flood, 0) ELSE 0 END), 6)::DOUBLE AS rain_{h}h" for h in (1, 3, 6, 24))},
    count(flood) AS n_seen FROM grid WHERE ts > {SQL_AT} - INTERVAL 24 HOURS AND ts <= {SQL_AT} GROUP BY 1)"""
trailing = lambda s, d: live.rain_features_at(grid(s, d), AT, value="flood")
add("d28_rain_features_at", trailing, f"WITH {GRID}, {TRAILING} SELECT * FROM recent_rain")


def outlook(spark: SparkSession, sf: str) -> DataFrame:
    """Two polls of a forecast per district, told by the hours of the day."""
    rows = table(spark, sf, "events").select(
        (F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("event_id") % 2).cast("int"))).alias("polled_at"),
        "event_type", (F.col("user_id") % 3 != 0).alias("is_forecast"), (F.hour("ts") / 2 - 1).alias("lead_hours"), (F.col("value") / 100).alias("precipitation"),
    )
    return live.rain_outlook(rows.withColumnRenamed("event_type", "district"))


OUTLOOK = "outlook AS (SELECT " + ", ".join(f"round(avg(h{h}), 6) AS rain_fcst_{h}h" for h in (1, 3, 6)) + " FROM (SELECT event_type, " + ", ".join(
    f"sum(value / 100) FILTER (WHERE hour(ts) / 2 - 1 > 0 AND hour(ts) / 2 - 1 <= {h}) AS h{h}" for h in (1, 3, 6)
) + " FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1))"
add("d26_rain_outlook", outlook, f"WITH {OUTLOOK} SELECT * FROM outlook")


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select("station_code").distinct()


def live_table(spark: SparkSession, sf: str) -> DataFrame:
    now = carried(spark, sf).select("station_code", F.col("flood").alias("depth_now"))
    return live.live_features(stations(spark, sf), now, trailing(spark, sf), water(spark, sf), outlook(spark, sf))


LIVE = f"""{CARRIED}, {POLLS[len(GRID) + 2:]}, {SNAPSHOT}, {TRAILING}, {OUTLOOK}, live_table AS (
    SELECT s.station_code, c.flood AS depth_now, t.* EXCLUDE (station_code), water.*, outlook.* FROM (SELECT DISTINCT station_code FROM readings) s
    LEFT JOIN carried c USING (station_code) LEFT JOIN recent_rain t USING (station_code), water, outlook)"""
add("d26_live_features", live_table, f"WITH {LIVE} SELECT * FROM live_table")


def live_forecast(spark: SparkSession, sf: str) -> DataFrame:
    scored_ = carried(spark, sf).select("station_code", F.col("flood").alias("depth_now"), "prob")
    return live.live_forecast(scored_, live.cold_start(sourced(spark, sf), SOURCES), 100, 0.1)


FORECAST = f"""{CARRIED}, live_forecast AS (SELECT station_code, flood AS depth_now, CASE WHEN NOT coalesce(flood >= 100, false) THEN round(prob, 6) END AS probability,
    coalesce(flood >= 100, false) OR coalesce(prob >= 0.1, false) AS alert,
    CASE WHEN flood >= 100 THEN 'flooded_now' WHEN prob >= 0.1 THEN 'at_risk' WHEN flood IS NULL AND prob IS NULL THEN 'unknown' ELSE 'clear' END AS status, true AS cold_start FROM carried)"""
add("d23_live_forecast", live_forecast, f"WITH {FORECAST} SELECT * FROM live_forecast")
add("d26_live_status", lambda s, d: live.live_status(live_forecast(s, d)),
    f"""WITH {FORECAST}, one AS (SELECT count(*) AS n_stations, count(depth_now) AS n_known, count(*) FILTER (WHERE status = 'flooded_now') AS n_flooded, count(*) FILTER (WHERE alert) AS n_alerts,
    max(depth_now) AS deepest, bool_or(cold_start) AS cold_start FROM live_forecast) SELECT *, CASE WHEN deepest >= 60 THEN 'critical' WHEN deepest >= 30 THEN 'warning' WHEN deepest >= 15 THEN 'advisory' ELSE 'watch' END AS level FROM one""")  # fmt: skip


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of some stations: none of one prefix, some of the others."""
    digit = F.substring("station_code", -1, 1).cast("int")
    known = stations(spark, sf).where((digit < 3) & ~F.col("station_code").contains("ERR"))
    return known.select("station_code", (13.5 + digit / 10).alias("lat"), F.when(digit != 2, 100.5 + digit / 100).alias("lon"))


add("s29_coordinates", lambda s, d: live.with_coordinates(stations(s, d), registry(s, d), (13.75, 100.5)),
    f"""WITH {READINGS}, s AS (SELECT DISTINCT station_code, split_part(station_code, '.', 2) AS prefix, station_code[-1]::INT AS digit FROM readings),
    known AS (SELECT station_code, prefix, 13.5 + digit / 10 AS lat, 100.5 + digit / 100 AS lon FROM s WHERE digit < 2 AND prefix <> 'ERR'),
    m AS (SELECT prefix, round(avg(lat), 5) AS mean_lat, round(avg(lon), 5) AS mean_lon FROM known GROUP BY 1)
    SELECT s.station_code, coalesce(k.lat, mean_lat, 13.75)::DOUBLE AS lat, coalesce(k.lon, mean_lon, 100.5)::DOUBLE AS lon,
    CASE WHEN k.lat IS NOT NULL THEN 'registry' WHEN mean_lat IS NOT NULL THEN 'prefix' ELSE 'city' END AS coord_source
    FROM s LEFT JOIN known k USING (station_code) LEFT JOIN m ON m.prefix = s.prefix""")  # fmt: skip

# -- raw polls ------------------------------------------------------------


def raw_days(spark: SparkSession, sf: str) -> DataFrame:
    """A payload a day: the ids of its events."""
    per = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.to_json(F.sort_array(F.collect_list("event_id"))).alias("body"))  # a day's events
    return per.select((F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("fetched_at"), "body")


def day_rows(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode(F.from_json("body", "array<long>")).alias("event_id"), "fetched_at")


def repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The history of a store that holds some rows of an older parser: all of it is parsed again."""
    raw = stores.read_raw(spark, stores.write_raw(raw_days(spark, sf)))
    stored = day_rows(raw).where("event_id % 2 = 0").withColumn("_collector_version", F.when(F.col("event_id") % 10 == 0, "1").otherwise("2"))
    return stores.history(stored, raw, day_rows, "2")


add("s20_read_raw", lambda s, d: day_rows(stores.read_raw(s, stores.write_raw(raw_days(s, d)))), "SELECT event_id, date_trunc('day', ts) + INTERVAL 12 HOURS AS fetched_at FROM events")
add("s21_history", repaired, "SELECT event_id, date_trunc('day', ts) + INTERVAL 12 HOURS AS fetched_at, '2' AS _collector_version FROM events")


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Nested payloads of water levels, a day each: numbers as text, names and banks partly absent."""
    e = table(spark, sf, "events")
    text = lambda c: c.cast("string")
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("station "), text(F.col("user_id"))))
    station = F.struct(F.col("user_id").alias("id"), name.alias("name"), F.when(F.col("user_id") % 4 != 0, text(F.col("user_id") % 2)).alias("min_bank"))
    record = F.struct(
        station.alias("station"), F.struct(F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("subdistrict")).alias("geocode"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("waterlevel_datetime"), F.when(F.col("event_type") == "error", "n/a").otherwise(text(F.col("value"))).alias("waterlevel_msl"),
        text(F.col("event_id") % 7).alias("waterlevel_msl_previous"), text(F.col("value") - 5).alias("diff_wl_bank"), F.when(F.col("event_id") % 2 == 0, "1.5").alias("discharge"),
    )
    per = e.groupBy(F.to_date("ts").alias("day")).agg(F.collect_list(record).alias("data"))  # a day's events
    body = F.to_json(F.struct(F.struct(F.struct("data").alias("waterlevel_data")).alias("data")))
    return per.select((F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 24 HOURS")).alias("fetched_at"), body.alias("body"))


add("s22_water_levels", lambda s, d: payloads.water_rows(envelopes(s, d)).groupBy("station_id", "station_label", "bank_ref_valid").agg(
        F.count("*").alias("n"), F.count("level").alias("n_levels"), F.round(F.sum("rise"), 4).alias("rise"), F.round(F.sum("age_minutes"), 1).alias("age"), F.min("ts").alias("first_ts"),
        F.round(F.sum("diff_wl_bank_clean"), 4).alias("clean"), F.round(F.sum("diff_wl_bank"), 4).alias("raw"), F.count("flow").alias("n_flow")),
    """WITH r AS (SELECT user_id AS station_id, coalesce(CASE WHEN user_id % 3 = 0 THEN 'station ' || user_id END, CASE WHEN user_id % 5 <> 0 THEN event_type END, 'station_' || user_id) AS station_label,
    user_id % 4 <> 0 AND user_id % 2 > 0 AS bank_ref_valid, CASE WHEN event_type <> 'error' THEN value END AS level, event_id % 7 AS before, value - 5 AS bank, event_id % 2 = 0 AS flows,
    date_trunc('minute', ts) - INTERVAL 7 HOURS AS ts, date_trunc('day', ts) + INTERVAL 24 HOURS AS polled FROM events)
    SELECT station_id, station_label, bank_ref_valid, count(*) AS n, count(level) AS n_levels, round(sum(round(level - before, 6)), 4) AS rise, round(sum(round(epoch(polled - ts) / 60, 1)), 1)::DOUBLE AS age,
    min(ts) AS first_ts, round(sum(bank) FILTER (WHERE bank_ref_valid), 4) AS clean, round(sum(bank), 4) AS raw, count(*) FILTER (WHERE flows) AS n_flow FROM r GROUP BY 1, 2, 3""")  # fmt: skip
add("n07_rolling_window", lambda s, d: stores.kept_days(readings(s, d), AT, 5).groupBy("station_code").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")),
    f"WITH {READINGS} SELECT station_code, count(*) AS n, min(ts) AS first_ts FROM readings WHERE ts > {SQL_AT} - INTERVAL 5 DAYS AND ts <= {SQL_AT} GROUP BY 1")

# -- the feature table's readers ------------------------------------------
def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as it is written, by year."""
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    features.write_feature_table(wide(spark, sf), path)
    return features.read_feature_table(spark, path)


add("s08_load_features", lambda s, d: evaluation.load_features(stored_features(s, d), (2024,), ("fl_max_3h", "rain_now"), 100, 3).withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("rain_now", "fl_max_3h", "y_maxdepth_3h")}),
    f"""WITH {WIDE} SELECT station_code, ts, y_ge100_3h, y_valid_3h, is_onset_100, round(y_maxdepth_3h::FLOAT::DOUBLE, 3) AS y_maxdepth_3h, round(fl_max_3h::FLOAT::DOUBLE, 3) AS fl_max_3h, round(rain_now::FLOAT::DOUBLE, 3) AS rain_now
    FROM wide_table WHERE y_valid_3h AND year(ts) = 2024""")  # fmt: skip


def known_features(spark: SparkSession, sf: str) -> DataFrame:
    """How many values each input of a kind of model has in the feature table."""
    rows = wide(spark, sf)
    inputs = features.feature_columns(rows)
    kinds = {kind: evaluation.feature_set(inputs, kind, (2019, 2022)) for kind in ("onset", "general")}
    counted = quality.null_shares(rows, inputs).select("feature", "n_values")
    return counted.withColumn("kind", F.explode(F.array(*(F.when(F.col("feature").isin(chosen), F.lit(kind)) for kind, chosen in kinds.items())))).where("kind IS NOT NULL")


add("p05_feature_set", known_features,
    f"""WITH {WIDE}, n AS (SELECT count(COLUMNS('^((fl|rain|wl|fcst|cal)(_.*)?)$')) AS "\\1" FROM wide_table), u AS (UNPIVOT n ON COLUMNS(*) INTO NAME feature VALUE n_values)
    SELECT kind, feature, n_values FROM u, (VALUES ('onset'), ('general')) k(kind)""")  # fmt: skip
add("d12_feature_check", lambda s, d: evaluation.check_features(grid(s, d), depth(s, d), 3, "fl_max_3h"),
    f"""WITH {DEPTH}, x AS (SELECT d.fl_max_3h AS stored, (SELECT max(flood) FROM grid g WHERE g.station_code = d.station_code AND g.ts BETWEEN d.ts - INTERVAL 3 HOURS AND d.ts) AS again,
    (SELECT max(flood) FROM grid g WHERE g.station_code = d.station_code AND g.ts > d.ts AND g.ts <= d.ts + INTERVAL 3 HOURS) AS ahead FROM depth d)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE stored IS DISTINCT FROM again) AS n_disagree, count(*) FILTER (WHERE stored = ahead AND again IS DISTINCT FROM ahead) AS n_future FROM x""")  # fmt: skip
add("d13_forecast_value", lambda s, d: evaluation.forecast_value(scored(s, d), "score", F.hour("ts")).select("ap", "ap_season", "gain", "verdict"),
    f"""WITH {SCORED}, s2 AS (SELECT y, score, avg(y) OVER (PARTITION BY hour(ts)) AS control FROM scored),
    p1 AS (SELECT score AS t, sum(y) AS pos, count(*) AS n FROM s2 GROUP BY 1), p2 AS (SELECT control AS t, sum(y) AS pos, count(*) AS n FROM s2 GROUP BY 1),
    a1 AS (SELECT round(sum(part), 6) AS ap FROM (SELECT pos / sum(pos) OVER () * (sum(pos) OVER w / sum(n) OVER w) AS part FROM p1 WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))),
    a2 AS (SELECT round(sum(part), 6) AS ap_season FROM (SELECT pos / sum(pos) OVER () * (sum(pos) OVER w / sum(n) OVER w) AS part FROM p2 WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)))
    SELECT ap, ap_season, round(ap - ap_season, 6) AS gain, CASE WHEN ap - ap_season > 0.005 THEN 'useful' WHEN ap - ap_season < -0.005 THEN 'worse' ELSE 'no difference' END AS verdict FROM a1, a2""")  # fmt: skip


def baseline_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("station_code", "ts", "y", "flood", F.when(F.minute("ts") != 15, F.col("prob")).alias("rain"))
    day = F.dayofmonth("ts")
    return evaluation.run_baselines(rows.where(day <= 15), rows.where((day > 15) & (day <= 22)), rows.where(day > 22), "flood", "rain")


add("d16_run_baselines", baseline_runs)
add("n04_strata", lambda s, d: evaluation.by_stratum(scored(s, d), quality.station_profile(readings(s, d), "flood", 8640, TIERS), 0.5, 20),
    f"""WITH {SCORED}, profile AS (SELECT station_code, round(100.0 * (count(*) - count(flood)) / count(*), 6)::DOUBLE AS null_pct FROM readings GROUP BY 1),
    strata AS (SELECT CASE WHEN null_pct < 0.5 THEN 'little missing' WHEN null_pct > 20 THEN 'much missing' ELSE 'some missing' END AS stratum, y, pred FROM scored JOIN profile USING (station_code)),
    {_metrics_sql('stratum,', 'strata')}""")  # fmt: skip
add("n04_held_out_stations", lambda s, d: evaluation.held_out_stations(scored(s, d))[1].groupBy("station_code").agg(F.count("*").alias("n")),
    f"WITH {SCORED} SELECT station_code, count(*) AS n FROM scored WHERE ('0x' || substr(md5(station_code), 1, 8))::BIGINT % 5 = 0 GROUP BY 1")
TERRAIN = (("BRAZIL", 1.5, 0.02), ("CANADA", 2.5, 0.1))


def terrain_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The terrain of a district beside the district's rows, null where it wasn't surveyed."""
    terrain = spark.createDataFrame(list(TERRAIN), "district string, elevation double, slope double")
    base = depth(spark, sf).withColumn("district_code", F.split_part("station_code", F.lit("."), F.lit(2))).join(districts(spark, sf), "district_code", "left")
    return features.with_terrain(base.select("station_code", "ts", "district"), terrain)


add("j06_terrain", terrain_joined,
    f"""WITH {DEPTH}, t(district, elevation, slope) AS (VALUES {', '.join(f"('{n}', {e}::DOUBLE, {s}::DOUBLE)" for n, e, s in TERRAIN)})
    SELECT station_code, ts, n_name AS district, elevation, slope FROM depth JOIN nation ON n_nationkey = ascii(substr(split_part(station_code, '.', 2), 1, 1)) % 25 LEFT JOIN t ON t.district = n_name""")  # fmt: skip


# -- reports in pages: every fifth page serves the one before it once more, the last but one nothing new -----------
PAGE = 250


def served(spark: SparkSession, sf: str) -> str:
    """The events as pages of reports on shared storage."""
    root = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").withColumn("page", F.floor(F.col("event_id") / PAGE).cast("int"))
    last = e.agg(F.max("page").alias("last"))
    again = F.when((F.col("page") == F.col("last") - 1) & (F.col("page") > 0), F.col("event_id") - PAGE).when((F.col("page") % 5 == 4) & (F.col("event_id") % 2 == 0), F.col("event_id") - PAGE).otherwise(F.col("event_id"))
    properties = F.struct(again.cast("string").alias("ticket_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("district"))
    place = F.struct(F.array(F.lit(100.0) + F.col("user_id") / 1000, F.lit(13.0)).alias("coordinates"))
    feature = F.struct(F.col("event_id").alias("id"), place.alias("geometry"), properties.alias("properties"))
    page = e.crossJoin(F.broadcast(last)).groupBy("page").agg(F.array_sort(F.collect_list(feature)).alias("features"))  # PAGE of them
    block = F.floor(F.col("page") / pages.BLOCK).cast("int")
    line = F.concat_ws("\t", F.col("page").cast("string"), F.to_json(F.struct("features")))
    page.select(block.alias("block"), line.alias("value")).repartition("block").write.partitionBy("block").text(root)
    return root


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return pages.until_nothing_new(pages.read(spark, served(spark, sf), fetch="sluice.sources.pages:blocks", maxPages=1_000_000, pagesPerPartition=pages.BLOCK)).select("page", "ticket_id", "ts", "lon", "district")


add("s16_paged_reports", reports,
    f"""WITH e AS (SELECT *, (event_id // {PAGE})::INT AS page FROM events), l AS (SELECT max(page) AS last FROM e),
    t AS (SELECT page, event_id, ts, event_type, 100.0::DOUBLE + user_id / 1000 AS lon, CASE WHEN page = last - 1 AND page > 0 THEN event_id - {PAGE} WHEN page % 5 = 4 AND event_id % 2 = 0 THEN event_id - {PAGE} ELSE event_id END AS ticket FROM e, l),
    f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ticket ORDER BY page, event_id) = 1),
    stop AS (SELECT min(page) AS stop FROM (SELECT DISTINCT page FROM t) ANTI JOIN f USING (page))
    SELECT page, ticket::VARCHAR AS ticket_id, date_trunc('second', ts) AS ts, lon, event_type AS district FROM f, stop WHERE stop IS NULL OR page < stop""")  # fmt: skip


def table_order(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select("station_code", "ts", "flood", "event_id")


def _two_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A forecast, and a measurement that equals it on even hours and is missing on every third."""
    h = hourly(spark, sf)
    seen = h.where(F.hour("ts") % 3 != 0).select("district", "ts", F.when(F.hour("ts") % 2 == 0, F.col("fcst")).otherwise(F.col("fcst") + 1).alias("seen"))
    return h.select("district", "ts", "fcst"), seen


add("w10_file_order", lambda s, d: raw.order_check(raw.read_raw(s, raw.write_csv_fixture(table_order(s, d), "flood", ordered="event_id")[1], "flood"), "site_timestamp"),
    f"""WITH {READINGS}, x AS (SELECT date_trunc('second', ts) AS ts, lag(date_trunc('second', ts)) OVER (ORDER BY event_id) AS was FROM readings)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts < was) AS n_inversions, count(*) FILTER (WHERE ts = was) AS n_repeats FROM x""")  # fmt: skip
add("a40_forecast_report", lambda s, d: evaluation.forecast_report(*_two_sources(s, d)),
    f"""WITH {GRID}, {EXTERNAL}, x AS (SELECT year(ts)::INT AS year, fcst, CASE WHEN hour(ts) % 3 <> 0 THEN CASE WHEN hour(ts) % 2 = 0 THEN fcst ELSE fcst + 1 END END AS seen FROM hourly)
    SELECT year, count(*) AS n, round(count(fcst) / count(*), 4) AS coverage, round(count(*) FILTER (WHERE fcst = seen) / count(seen), 4) AS identical_all,
    round(count(*) FILTER (WHERE fcst = seen AND (fcst > 0 OR seen > 0)) / count(*) FILTER (WHERE seen IS NOT NULL AND (fcst > 0 OR seen > 0)), 4) AS identical_wet,
    count(*) FILTER (WHERE seen IS NOT NULL AND (fcst > 0 OR seen > 0)) AS wet_hours, 'usable' AS status FROM x GROUP BY 1""")  # fmt: skip


# -- models as tables of nodes: few rounds, since every driver's run trains them ----------------------------------
INPUTS = ("fl_depth_now", "fl_depth_lag_1h", "fl_rise_1h", "fl_max_3h", "fl_max_24h", "fl_mean_1h", "fl_std_3h", "fl_missing_share_3h")
QUANTILES = (0.05, 0.5, 0.95)


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Depth features and labels; the third week of the month stops the training, what is later is held out."""
    rows = depth(spark, sf).join(labelled(spark, sf).drop("flood"), ["station_code", "ts"])
    day = F.dayofmonth("ts")
    return written(rows.withColumns({"validation": (day > 15) & (day <= 21), "held_out": day > 21}), "split")


def quantile_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Depth quantiles for three horizons, trained together, and how many held-out depths their outer pair holds."""
    rows = split_rows(spark, sf)
    targets = {f"y_maxdepth_{h}h": list(QUANTILES) for h in H}
    nodes = written(boosting.train(rows.where("NOT held_out"), list(INPUTS), targets, rules=boosting.Rules(rounds=5, depth=3, rate=0.3, bins=16)), "nodes")
    scored_rows = written(boosting.score(nodes, rows.where("held_out"), list(INPUTS)), "scored")
    per = [metrics.coverage(scored_rows.where(f"y_maxdepth_{h}h IS NOT NULL"), f"y_maxdepth_{h}h", f"y_maxdepth_{h}h_p05", f"y_maxdepth_{h}h_p95", 100).withColumn("horizon", F.lit(h)) for h in H]
    return per[0].unionByName(per[1]).unionByName(per[2])


def importance(spark: SparkSession, sf: str) -> DataFrame:
    """What a saved onset model's splits gained, feature by feature."""
    rows = split_rows(spark, sf).withColumn("onset", F.col("y_ge100_3h").cast("double"))
    nodes = boosting.train(rows.where("NOT held_out AND is_onset_100"), list(INPUTS), {}, ["onset"], rules=boosting.Rules(rounds=5, depth=3, rate=0.3, bins=16))
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    boosting.save(nodes, {"features": INPUTS, "target": "onset"}, path)
    return boosting.gain_importance(boosting.load(spark, path)[0])


add("d19_quantile_coverage", quantile_coverage)
add("d21_gain_importance", importance)
