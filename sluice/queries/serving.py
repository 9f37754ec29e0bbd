"""Serving views, matrices, streams and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import sampling
from sluice.plans import serving
from sluice.registry import add
from sluice.sources import raw
from sluice.streaming import live, online

from .base import GRID, READINGS, grid, readings, table
from .core import EVENTS, LABELLED, SCORED, TIERS, labelled, scored

AT = "2024-01-15 12:00:00"
SQL_AT = f"TIMESTAMP '{AT}'"
quarter = lambda s, d: grid(s, d).where(F.minute("ts") % 15 == 0)
QUARTER = GRID + ", quarter AS (SELECT * FROM grid WHERE minute(ts) % 15 = 0)"
_ge = ", ".join(f"count(*) FILTER (WHERE flood >= {t}) AS n_ge{t}" for t in TIERS)
add("a12_observations", lambda s, d: serving.observations(quarter(s, d), AT, 24, tiers=TIERS),
    f"WITH {QUARTER} SELECT ts, round(avg(flood), 6) AS mean_depth, max(flood) AS max_depth, {_ge} FROM quarter WHERE ts > {SQL_AT} - INTERVAL 24 HOURS AND ts <= {SQL_AT} GROUP BY 1")
add("a13_rain_by_district", lambda s, d: serving.rain_by_district(grid(s, d), AT, 24),
    f"WITH {GRID} SELECT split_part(station_code, '.', 2) AS district, round(avg(flood), 6) AS mean_rain, max(flood) AS max_rain FROM grid WHERE ts > {SQL_AT} - INTERVAL 24 HOURS AND ts <= {SQL_AT} GROUP BY 1")
add("a14_hours_above", lambda s, d: serving.hours_above(quarter(s, d), 10, tiers=TIERS),
    f"WITH {QUARTER} SELECT station_code, " + ", ".join(f"round(count(*) FILTER (WHERE flood >= {t}) / 4.0::DOUBLE, 6) AS hours_ge{t}" for t in TIERS) + ", max(flood) AS max_depth FROM quarter GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
add("d24_station_history", lambda s, d: serving.station_history(grid(s, d), "FL.CLI.00", AT, 48),
    f"WITH {GRID} SELECT * FROM grid WHERE station_code = 'FL.CLI.00' AND ts > {SQL_AT} - INTERVAL 48 HOURS AND ts <= {SQL_AT} ORDER BY ts")
add("d24_available_range", lambda s, d: serving.available_range(quarter(s, d)), f"WITH {QUARTER} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS n_steps FROM quarter")
carried = lambda s, d: sampling.latest(serving.window_before(grid(s, d), AT, 12), ["station_code"], [F.desc("ts")]).select(
    "station_code", F.lit(AT).cast("timestamp_ntz").alias("ts"), "flood", F.least(F.col("flood") / 300, F.lit(1.0)).alias("prob"))
CARRIED = GRID + f""", carried AS (SELECT station_code, flood, least(flood / 300, 1.0) AS prob FROM grid WHERE ts > {SQL_AT} - INTERVAL 12 HOURS AND ts <= {SQL_AT}
    QUALIFY row_number() OVER (PARTITION BY station_code ORDER BY ts DESC) = 1),
    forecast AS (SELECT station_code, split_part(station_code, '.', 2) AS district, CASE WHEN flood IS NULL THEN 'offline' WHEN flood >= 100 THEN 'flooded_now' WHEN prob >= 0.1 THEN 'at_risk' ELSE 'clear' END AS status,
    CASE WHEN flood < 100 THEN round(prob, 6) END AS probability, coalesce(flood >= 100 OR prob >= 0.1, false) AS alert, flood AS depth_now FROM carried)"""
forecast = lambda s, d: serving.forecast_at(carried(s, d), AT, 100, 0.1)
add("d22_forecast_at", forecast, f"WITH {CARRIED} SELECT * FROM forecast")
add("a32_district_risk", lambda s, d: serving.district_risk(forecast(s, d)),
    f"""WITH {CARRIED}, g AS (SELECT district, count(*) AS n_stations, sum(alert::INT)::BIGINT AS n_alerts, count(*) FILTER (WHERE status = 'flooded_now') AS n_flooded, max(probability) AS max_probability FROM forecast GROUP BY 1)
    SELECT *, CASE WHEN n_alerts <= 0 THEN 'none' WHEN n_alerts / n_stations <= 0.34 THEN 'low' WHEN n_alerts / n_stations <= 0.67 THEN 'moderate' ELSE 'high' END AS level FROM g""")  # fmt: skip
add("a33_area_forecast", lambda s, d: serving.area_forecast(carried(s, d), AT),
    f"WITH {CARRIED} SELECT round(quantile_cont(flood, 0.95), 6) AS p95, round(avg(flood), 6) AS mean, max(flood) AS max, count(flood) AS n FROM carried")
add("a42_kpis", lambda s, d: forecast(s, d).agg(F.round(F.avg("depth_now"), 6).alias("mean_depth"), F.count_if(F.col("depth_now") >= 5).alias("n_active"), F.count_if("alert").alias("n_alerts"), F.max("depth_now").alias("peak")),
    f"WITH {CARRIED} SELECT round(avg(depth_now), 6) AS mean_depth, count(*) FILTER (WHERE depth_now >= 5) AS n_active, count(*) FILTER (WHERE alert) AS n_alerts, max(depth_now) AS peak FROM forecast")
add("d25_cap_alerts", lambda s, d: serving.cap_alerts(forecast(s, d), AT, 15, 3),
    f"""WITH {CARRIED} SELECT station_code, '{{"identifier":"alert-' || station_code || '-2024-01-15T12:00:00","sent":"{AT}","status":"Test","scope":"Restricted","urgency":"Expected","severity":"Moderate","certainty":"' ||
    CASE WHEN status = 'flooded_now' THEN 'Observed' ELSE 'Likely' END || '","areaDesc":"' || district || '"}}' AS alert FROM forecast WHERE alert""")  # fmt: skip
add("n01_alert_levels", lambda s, d: grid(s, d).where("flood IS NOT NULL").groupBy("ts").agg(F.percentile("flood", 0.95).alias("p"), F.max("flood").alias("now")).withColumns({"p": F.round(F.col("p") / 4, 6), "now": F.round(F.col("now") / 4, 6)}).groupBy(serving.alert_level({1: "p"}, "now").alias("level")).agg(F.count("*").alias("n")),
    f"""WITH {GRID}, x AS (SELECT round(quantile_cont(flood, 0.95) / 4, 6) AS p, round(max(flood) / 4, 6) AS now FROM grid WHERE flood IS NOT NULL GROUP BY ts)
    SELECT CASE WHEN now >= 60 THEN 'critical' WHEN p >= 30 OR now >= 30 THEN 'warning' WHEN now >= 15 THEN 'advisory' ELSE 'watch' END AS level, count(*) AS n FROM x GROUP BY 1""")  # fmt: skip
add("d27_hybrid_alert", lambda s, d: scored(s, d).select("station_code", "ts", ((F.col("prob") >= 0.3) | (F.col("flood") >= 60)).alias("alert"), F.greatest("prob", F.col("flood") / 600).alias("hybrid")).groupBy("station_code").agg(F.count_if("alert").alias("n_alerts"), F.round(F.max("hybrid"), 6).alias("max_hybrid"), F.min(F.when(F.col("alert"), F.col("ts"))).alias("first_alert")),
    f"WITH {SCORED} SELECT station_code, count(*) FILTER (WHERE prob >= 0.3 OR flood >= 60) AS n_alerts, round(max(greatest(prob, flood / 600)), 6) AS max_hybrid, min(ts) FILTER (WHERE prob >= 0.3 OR flood >= 60) AS first_alert FROM scored GROUP BY 1")
add("d17_build_matrix", lambda s, d: sampling.thinned_negatives(labelled(s, d).where("y_valid_3h AND y_ge100_3h IS NOT NULL AND is_onset_100"), F.col("y_ge100_3h"), ("station_code", "ts"), 0.25, 1).select("station_code", "ts", F.col("y_ge100_3h").cast("byte").alias("y")),
    f"""WITH {LABELLED} SELECT station_code, ts, y_ge100_3h::TINYINT AS y FROM labelled WHERE y_valid_3h AND y_ge100_3h IS NOT NULL AND is_onset_100
    AND (y_ge100_3h OR ('0x' || substr(md5(station_code || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|1'), 1, 8))::BIGINT % 1000000 < 250000)""")  # fmt: skip
add("s04_ingest", lambda s, d: raw.ingest(raw.write_csv_fixture(readings(s, d), "flood"), "flood", 2024),
    f"WITH {READINGS} SELECT station_code, station_code AS station_name, date_trunc('second', ts) AS ts, CASE WHEN flood BETWEEN 0 AND 200 THEN flood END AS flood FROM readings")


def streamed(spark, sf, make):
    """The events as they would have come in: in three slices, every twentieth half a day late."""
    rows = table(spark, sf, "events")
    arrival = F.col("ts") + F.when(F.col("event_id") % 20 == 0, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    return live.replayed(rows, live.EVENTS, make, arrival, ("2024-01-11", "2024-01-21"), "2030-01-01")


def streamed_events(stream):
    code = F.concat(F.lit("FL."), F.upper(F.substring("event_type", 1, 3)), F.lit("."), F.lpad((F.col("user_id") % 4).cast("string"), 2, "0"))
    read = stream.select(F.coalesce(code, F.lit("")).alias("station_code"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("flood"))
    return online.events(read, TIERS, cadence=30, persistence=2, merge_gap=180)


add("t04_online_events", lambda s, d: streamed(s, d, streamed_events), f"WITH {EVENTS} SELECT * FROM found")
add("t05_tumbling", lambda s, d: streamed(s, d, live.tumbling),
    "SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1, 2")
add("t05_sliding", lambda s, d: streamed(s, d, lambda e: live.sliding(e, 6, 120)),
    """SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts) + k * INTERVAL 2 HOUR AS ts, count(*) AS n, max(value) AS max_value FROM events, (VALUES (1), (2), (3)) t(k) GROUP BY 1, 2""")  # fmt: skip
add("t03_dedupe", lambda s, d: live.deduplicated(s, f"{d}/events.parquet"), "SELECT event_id, ts, user_id, event_type, value FROM events")
add("t04_sessions", lambda s, d: live.sessions(s, f"{d}/events.parquet", 100, 180),
    """WITH wet AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events WHERE value >= 100),
    n AS (SELECT *, sum((was IS NULL OR ts > was + INTERVAL 180 MINUTES)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM wet)
    SELECT user_id, min(ts) AS started_at, count(*) AS n_readings, max(value) AS peak FROM n GROUP BY user_id, k""")  # fmt: skip
