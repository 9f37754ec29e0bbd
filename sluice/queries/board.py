"""The board of forecasts, alert messages, the model card, sampling for checks, and parsers of payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import baselines, metrics, sampling
from sluice.plans import board, serving
from sluice.registry import add
from sluice.session import shared_dir
from sluice.sources import payloads, stores
from sluice.streaming import live as streams

from .base import table
from .core import H, HITS, SCORED, TIERS, WIDE, _metrics_sql, hits, scored, wide
from .live import registry
from .serving import QUARTER, quarter

MIDDLE, ALONE, CUT = 100, ((150, 1), (150, 3)), 0.6
_reach = {(t, h): round(t + 47 * h + 0.7, 1) for t in TIERS for h in H}
_wider = {h: round(1 + 0.13 * h, 2) for h in H}


def boarded(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that follow from the present depth, for every station and step."""
    rows = quarter(spark, sf)
    known = F.col("flood").isNotNull()
    raw = {f"raw{t}_{h}h": F.when(known, F.least(F.col("flood") / r, F.lit(1.0))) for (t, h), r in _reach.items()}
    rows = rows.withColumns(raw).withColumns({f"prob{t}_{h}h": F.col(f"raw{t}_{h}h") * 0.83 for t, h in _reach})
    rows = rows.withColumns({f"{q}_{h}h": v for h in H for q, v in (("p05", F.col("flood") * 0.5 - 10), ("p50", F.col("flood")), ("p95", F.col("flood") * _wider[h]))})
    return board.predictions(rows, dict.fromkeys(_reach, CUT), TIERS, H, ALONE, "flood", (6, 6))


def _at(h: int) -> str:
    raw = {t: f"CASE WHEN flood IS NOT NULL THEN least(flood / {_reach[t, h]}, 1.0) END" for t in TIERS}
    risk = ", ".join(f"round(100 * ({raw[t]} * 0.83), 6) AS risk_{t}" for t in TIERS)
    alert = ", ".join(f"coalesce(flood >= {t}, false)" + ("" if (t, h) in ALONE else f" OR coalesce({raw[t]} >= {CUT}, false)") + f" AS alert_{t}" for t in TIERS)
    return (
        f"SELECT station_code, ts, flood, {h} AS horizon_h, {risk}, {alert}, CASE WHEN flood IS NOT NULL THEN round(greatest(flood * 0.5 - 10, 0.0), 6) END AS p05, "
        f"round(flood, 6) AS p50, round(flood * {_wider[h]}, 6) AS p95 FROM quarter"
    )


BOARD = f"{QUARTER}, board AS ({' UNION ALL '.join(map(_at, H))})"


def by_horizon(rows: DataFrame) -> DataFrame:
    x = rows.select("station_code", "ts", "flood", F.explode("horizons").alias("x"))
    each = [F.col(f"x.{kind}.ge{t}").alias(f"{kind}_{t}") for kind in ("risk", "alert") for t in TIERS]
    return x.select("station_code", "ts", "flood", F.col("x.h").alias("horizon_h"), *each, "x.depth.*")


add("d27_predictions", lambda s, d: by_horizon(boarded(s, d)), f"WITH {BOARD} SELECT * FROM board")
KPIS = ("peak_risk_pct", "peak_risk_time_h", "time_to_warning_h", "peak_depth_p95", "peak_depth_time_h", "time_to_100_h", "time_to_150_h")
KPI = f"""kpi AS (SELECT station_code, ts, flood, max(risk_{MIDDLE}) AS peak_risk_pct, first(horizon_h ORDER BY risk_{MIDDLE} DESC, horizon_h) FILTER (WHERE risk_{MIDDLE} IS NOT NULL) AS peak_risk_time_h,
    min(horizon_h) FILTER (WHERE alert_{MIDDLE}) AS time_to_warning_h, max(p95) AS peak_depth_p95, first(horizon_h ORDER BY p95 DESC, horizon_h) FILTER (WHERE p95 IS NOT NULL) AS peak_depth_time_h,
    min(horizon_h) FILTER (WHERE p95 >= 100) AS time_to_100_h, min(horizon_h) FILTER (WHERE p95 >= 150) AS time_to_150_h FROM board GROUP BY 1, 2, 3)"""


def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return board.with_kpis(boarded(spark, sf), MIDDLE, (100, 150)).select("station_code", "ts", "flood", *KPIS)


add("d27_kpis", kpis, f"WITH {BOARD}, {KPI} SELECT * FROM kpi")
add("d27_area", lambda s, d: board.area(boarded(s, d).withColumn("district", serving.district()), ("district", "ts"), MIDDLE, (6, 6)),
    f"""WITH {BOARD} SELECT split_part(station_code, '.', 2) AS district, ts, horizon_h, count(*) AS n_stations, round(avg(risk_{MIDDLE}), 6) AS risk_pct_mean, round(max(p95), 6) AS depth_p95_max,
    count(*) FILTER (WHERE alert_{MIDDLE}) AS stations_alerting, round(quantile_cont(risk_{MIDDLE}, 0.95), 6) AS risk_pct_p95 FROM board GROUP BY 1, 2, 3""")  # fmt: skip


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    """The map's file of features, read back."""
    path = f"{shared_dir(spark)}/map-{uuid.uuid4().hex}"
    placed = kpis(spark, sf).join(F.broadcast(registry(spark, sf)), "station_code", "left")  # a row a station
    board.map_features(placed).write.text(path)
    kinds = "station_code:string,ts:timestamp_ntz,peak_risk_pct:double,time_to_warning_h:int"
    read = spark.read.schema(f"geometry struct<type:string,coordinates:array<double>>, properties struct<{kinds}>").json(path)
    return read.select(F.round(F.col("geometry.coordinates")[0], 6).alias("lon"), F.round(F.col("geometry.coordinates")[1], 6).alias("lat"), "properties.*")


add("d27_map", mapped,
    f"""WITH {BOARD}, {KPI} SELECT round(100.5 + station_code[-1]::INT / 100, 6)::DOUBLE AS lon, round(13.5 + station_code[-1]::INT / 10, 6)::DOUBLE AS lat, station_code, ts, peak_risk_pct, time_to_warning_h
    FROM kpi WHERE station_code[-1]::INT < 2 AND station_code NOT LIKE '%ERR%'""")  # fmt: skip

# -- messages and the card --------------------------------------------------
EXTREME = 180


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of all alerts as XML files, read back."""
    path = f"{shared_dir(spark)}/cap-{uuid.uuid4().hex}"
    level = F.when(F.col("flood") >= 150, "critical").when(F.col("p95") >= 130, "warning").when(F.col("flood") >= 50, "advisory").otherwise("watch")
    rows = by_horizon(boarded(spark, sf)).where(f"alert_{TIERS[0]}").withColumns({"level": level, "district": serving.district(), "depth_now": F.col("flood")})
    board.write_cap(board.cap_messages(rows, "alerts@example.org", extreme=EXTREME), path)
    read = board.read_cap(spark, path)
    spoken = lambda language: F.filter("info", lambda i: i["language"] == language)[0]
    th, en = map(spoken, board.NAMES)
    told = {c: en[c] for c in ("urgency", "severity", "certainty", "responseType", "onset", "expires")}
    return read.select("identifier", "sent", "status", F.array_join(en["category"], ",").alias("category"), *(v.alias(k) for k, v in told.items()),
                       th["headline"].alias("headline_th"), en["headline"].alias("headline_en"), en["area"]["areaDesc"].alias("area"))


def _case(values: dict[str, str]) -> str:
    return "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


add("s30_cap_messages", messages,
    f"""WITH {BOARD}, m AS (SELECT *, CASE WHEN flood >= 150 THEN 'critical' WHEN p95 >= 130 THEN 'warning' WHEN flood >= 50 THEN 'advisory' ELSE 'watch' END AS level,
        coalesce(flood >= {EXTREME}, false) AS far FROM board WHERE alert_{TIERS[0]}),
    o AS (SELECT *, CASE WHEN level = 'critical' THEN ts ELSE ts + horizon_h * INTERVAL 1 HOUR END AS onset FROM m)
    SELECT 'alert-' || station_code || '-' || strftime(ts, '%Y%m%dT%H%M') || '-' || horizon_h AS identifier, ts AS sent, 'Test' AS status, 'Met,Geo' AS category,
        CASE WHEN level = 'critical' OR horizon_h <= 1 THEN 'Immediate' WHEN level = 'watch' AND horizon_h >= 6 THEN 'Future' ELSE 'Expected' END AS urgency,
        CASE WHEN far THEN 'Extreme' ELSE {_case({k: v[0] for k, v in board.LEVELS.items()})} END AS severity, {_case({k: v[1] for k, v in board.LEVELS.items()})} AS certainty,
        CASE WHEN far THEN 'Execute' ELSE {_case({k: v[2] for k, v in board.LEVELS.items()})} END AS responseType, onset, onset + INTERVAL 3 HOURS AS expires,
        {_case(board.NAMES['th-TH'])} || ' ' || station_code AS headline_th, {_case(board.NAMES['en-US'])} || ' ' || station_code AS headline_en, split_part(station_code, '.', 2) AS area FROM o""")  # fmt: skip
add("d25_model_card", lambda s, d: board.model_card(scored(s, d), hits(s, d)).withColumn("caveats", F.array_join("caveats", " ")),
    f"""WITH {SCORED}, {HITS}, pod AS (SELECT count(*) AS n_events, count(*) FILTER (WHERE hit) AS n_detected, round(count(*) FILTER (WHERE hit) / nullif(count(*), 0), 6) AS pod,
        round(quantile_cont(lead_minutes, 0.5), 6) AS lead_median, round(quantile_cont(lead_minutes, 0.25), 6) AS lead_p25, round(avg((lead_minutes <= 15)::INT) FILTER (WHERE hit), 6) AS one_step_share FROM hits),
    m AS (SELECT round(coalesce(sum(y * pred) / nullif(sum(pred), 0), 0), 6) AS precision, round(coalesce(sum(y * pred) / nullif(sum(y), 0), 0), 6) AS recall, round(coalesce(sum((1 - y) * pred) / nullif(sum(pred), 0), 0), 6) AS far,
        round(coalesce(sum(y * pred) FILTER (WHERE is_onset) / nullif(sum(y) FILTER (WHERE is_onset), 0), 0), 6) AS recall_on_dry FROM scored),
    a AS (SELECT ts, lag(ts) OVER (PARTITION BY station_code ORDER BY ts) AS was FROM scored WHERE pred = 1),
    e AS (SELECT count(*) FILTER (WHERE was IS NULL OR date_diff('minute', was, ts) > 60) AS n_episodes FROM a)
    SELECT pod.*, m.*, n_episodes, round(n_episodes / nullif(n_detected, 0), 6) AS episodes_per_flood_warned,
        concat_ws(' ', round(100 * far)::INT || ' % of the alerts do not become floods.', round(100 * pod)::INT || ' % of the floods are warned of.',
        round(100 * one_step_share)::INT || ' % of the warnings come one step ahead or later.') AS caveats
    FROM pod, m, e""")  # fmt: skip


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for a time between steps, some for none and some for one that isn't served yet."""
    later = F.col("ts") + F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 40 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", later).alias("ts"))
    return serving.served_at(rows, serving.available_range(quarter(spark, sf)))


add("d24_served_at", asked,
    f"""WITH {QUARTER}, r AS (SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM quarter),
    q AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts + (CASE WHEN event_id % 10 = 0 THEN 40 ELSE 0 END) * INTERVAL 1 DAY END AS ts FROM events),
    f AS (SELECT event_id, coalesce(time_bucket(INTERVAL 15 MINUTE, q.ts), last_ts) AS ts, first_ts, last_ts FROM q, r) SELECT event_id, ts, ts BETWEEN first_ts AND last_ts AS served FROM f""")  # fmt: skip

# -- samples, matrices, the rain rule ---------------------------------------
_hash = "md5(station_code || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|3')"
add("l05_probe_rows", lambda s, d: sampling.probe_rows(quarter(s, d), F.col("flood") >= MIDDLE, ("station_code", "ts"), 200, 3),
    f"""WITH {QUARTER}, a AS (SELECT * FROM quarter ORDER BY {_hash}, station_code, ts LIMIT 200), b AS (SELECT * FROM quarter WHERE flood >= {MIDDLE} ORDER BY {_hash}, station_code, ts LIMIT 200)
    SELECT * FROM a UNION SELECT * FROM b""")  # fmt: skip
add("d17_depth_matrix", lambda s, d: sampling.build_matrix(wide(s, d), ("fl_max_3h", "rain_now"), 50, 6, negative_rate=0.3, seed=7, target="depth"),
    f"""WITH {WIDE} SELECT station_code, ts, fl_max_3h, rain_now, y_maxdepth_6h::DOUBLE AS y FROM wide_table WHERE y_valid_6h AND y_ge50_6h IS NOT NULL
    AND (y_ge50_6h OR ('0x' || substr(md5(station_code || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|7'), 1, 8))::BIGINT % 1000000 < 300000)""")  # fmt: skip
add("d17_full_population", lambda s, d: sampling.build_matrix(wide(s, d), ("fl_max_3h", "rain_now"), 100, 3, kind="onset", negative_rate=1.0),
    f"WITH {WIDE} SELECT station_code, ts, fl_max_3h, rain_now, y_ge100_3h::TINYINT AS y FROM wide_table WHERE y_valid_3h AND y_ge100_3h IS NOT NULL AND is_onset_100")


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    rows = baselines.rain_rule(wide(spark, sf).where("y_ge100_3h IS NOT NULL"), "rain_now").where("score IS NOT NULL")
    return metrics.binary_metrics(rows.select(F.col("y_ge100_3h").alias("y"), (F.col("score") >= 70).alias("pred")))


add("d14_rain_rule", ruled, f"WITH {WIDE}, ruled AS (SELECT y_ge100_3h::INT AS y, (rain_now >= 70)::INT AS pred FROM wide_table WHERE y_ge100_3h IS NOT NULL AND rain_now IS NOT NULL), {_metrics_sql('', 'ruled')}")

# -- payloads and the stream's store ----------------------------------------


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """A day's events of a type as the outline of a district."""
    vertex = F.array(100 + F.col("user_id") / 997, 13 + F.col("value") / 997)
    name = F.concat_ws(" ", "event_type", F.to_date("ts").cast("string"))
    rings = table(spark, sf, "events").groupBy(name.alias("dname")).agg(F.collect_list(vertex).alias("ring"))  # a day's events
    feature = F.struct(F.struct("dname").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"))
    return payloads.district_points(rings.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("body")))


add("s12_district_points", outlines,
    "SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS district, round(avg(13 + value / 997), 5) AS lat, round(avg(100 + user_id / 997), 5) AS lon FROM events GROUP BY 1")


def pumps(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as pump stations, 50 a payload; every third is told of again with a higher level."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    code = F.concat_ws(".", F.lit("PM"), F.element_at(F.array(*map(F.lit, ("AB", "CD", "EF"))), nation % 3 + 1), k.cast("string"))
    status = F.when(nation % 5 == 0, "offline").when(nation % 7 != 0, "online")
    engines = F.array(F.struct(F.lit("p1").alias("name"), (k % 2 == 0).alias("running")), F.struct(F.lit("p2").alias("name"), (k % 4 == 1).alias("running")))
    again = F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("more")
    rows = table(spark, sf, "supplier").select("*", again)
    station = F.struct(code.alias("code"), F.col("s_name").alias("name"), status.alias("status"), (F.col("s_acctbal") + F.col("more")).cast("string").alias("level"), F.lit("02-000").alias("phone"), engines.alias("pumps"))
    per = rows.groupBy(F.floor(k / 50)).agg(F.collect_list(station).alias("stations"))  # at most 100
    return payloads.pump_rows(per.select(F.to_json("stations").alias("body")))


add("s25_pumps", pumps,
    """SELECT 'PM.' || ['AB', 'CD', 'EF'][s_nationkey % 3 + 1] || '.' || s_suppkey AS code, ['AB', 'CD', 'EF'][s_nationkey % 3 + 1] AS prefix,
    CASE WHEN s_nationkey % 5 <> 0 THEN s_acctbal + (s_suppkey % 3 = 0)::INT END AS level_m, (s_suppkey % 2 = 0)::INT + (s_suppkey % 4 = 1)::INT AS n_running,
    CASE WHEN s_suppkey % 2 = 0 THEN 'p1' WHEN s_suppkey % 4 = 1 THEN 'p2' ELSE '' END AS running FROM supplier""")  # fmt: skip
ALIASES = {"station_code": ("station_code", "code"), "level": ("water", "level"), "ts": ("ts", "time"), "pump": ("pump",)}
add("s26_aliased", lambda s, d: payloads.aliased(table(s, d, "events").select("event_id", F.col("event_type").alias("data.station.code"), F.col("value").alias("reading.level"), F.col("ts"), F.col("props").alias("extra.note")), ALIASES, "2"),
    "SELECT event_type AS station_code, value AS level, ts, NULL::VARCHAR AS pump, event_id AS raw_event_id, props AS raw_extra_note, '2' AS _collector_version FROM events")
add("t02_append_store", lambda s, d: stores.read_history(s, streams.stored(streams.source(s, f"{d}/events.parquet"), "2")).groupBy(F.col("dt").cast("string").alias("dt"), "_collector_version").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")),
    "SELECT ts::DATE::VARCHAR AS dt, '2' AS _collector_version, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
