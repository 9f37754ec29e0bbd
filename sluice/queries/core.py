"""Events, labels, features, quality, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import events, features, labels, metrics, quality
from sluice.operators.quantiles import with_quantiles
from sluice.registry import add

from .base import GRID, READINGS, grid, readings, table

TIERS = (50, 100, 150)
TIER_ROWS = "(VALUES (50.0::DOUBLE), (100.0), (150.0)) t(tier_cm)"

# -- events ---------------------------------------------------------------
RUNS = GRID + f""", marked AS (
    SELECT station_code, tier_cm, ts, flood, flood >= tier_cm AS above,
           lag(flood >= tier_cm) OVER w AS was_above, lag(ts) OVER w AS was_ts
    FROM grid, {TIER_ROWS} WHERE flood IS NOT NULL WINDOW w AS (PARTITION BY station_code, tier_cm ORDER BY ts)),
numbered AS (
    SELECT *, sum(CASE WHEN above AND (was_above IS NULL OR NOT was_above OR date_diff('minute', was_ts, ts) > 30) THEN 1 ELSE 0 END)
              OVER (PARTITION BY station_code, tier_cm ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (
    SELECT station_code, tier_cm, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_readings, max(flood) AS peak_depth_cm
    FROM numbered WHERE above GROUP BY station_code, tier_cm, run)"""


def _events_sql(persistence: str, gap: str, least: str, keys: str = "station_code, tier_cm", source: str = "runs") -> str:
    return f"""gaps AS (
    SELECT *, CASE WHEN date_diff('minute', lag(ended_at) OVER w, started_at) <= {gap} THEN 0 ELSE 1 END AS fresh
    FROM {source} WHERE n_readings >= {persistence} WINDOW w AS (PARTITION BY {keys} ORDER BY started_at)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS event FROM gaps),
found AS (
    SELECT {keys}, min(started_at) AS started_at, max(ended_at) AS ended_at, sum(n_readings)::BIGINT AS n_readings,
           max(peak_depth_cm) AS peak_depth_cm, count(*) AS n_excursions_merged,
           floor(epoch(max(ended_at) - min(started_at)) / 60 + 30)::BIGINT AS duration_minutes, year(min(started_at))::INT AS year
    FROM grouped GROUP BY {keys}, event HAVING floor(epoch(max(ended_at) - min(started_at)) / 60 + 30) >= {least})"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return events.excursions(grid(spark, sf), TIERS, cadence=30)


def found(spark: SparkSession, sf: str) -> DataFrame:
    return events.detect(grid(spark, sf), TIERS, cadence=30, persistence=2, merge_gap=180)


EVENTS = f"{RUNS}, {_events_sql('2', '180', '10')}"
add("d01_excursions", runs, f"WITH {RUNS} SELECT * FROM runs")
add("d02_events", found, f"WITH {EVENTS} SELECT * FROM found")
add(
    "d04_sensitivity",
    lambda s, d: events.sensitivity(runs(s, d), (1, 2, 3), (30, 60, 180), cadence=30),
    f"""WITH {RUNS}, grid2 AS (SELECT * FROM runs, (VALUES (1), (2), (3)) p(persistence), (VALUES (30), (60), (180)) g(merge_gap)),
    {_events_sql('persistence', 'merge_gap', '10', 'station_code, tier_cm, persistence, merge_gap', 'grid2')}
    SELECT tier_cm, persistence, merge_gap, count(*) AS n_events FROM found GROUP BY ALL""",
)
add(
    "a04_class_balance",
    lambda s, d: events.class_balance(readings(s, d), TIERS),
    f"""WITH {READINGS} SELECT year(ts)::INT AS year, count(flood) AS n, """
    + ", ".join(
        f"count(*) FILTER (WHERE flood >= {t}) AS n_ge{t}, round(100.0 * count(*) FILTER (WHERE flood >= {t}) / nullif(count(flood), 0), 5) AS pct_ge{t}, "
        f"round(count(flood) / nullif(count(*) FILTER (WHERE flood >= {t}), 0), 0) AS one_in_ge{t}"
        for t in TIERS
    )
    + " FROM readings GROUP BY 1",
)
add(
    "a15_hotspots",
    lambda s, d: events.hotspots(found(s, d), 10),
    f"""WITH {EVENTS} SELECT station_code, count(*) AS n_events, sum(duration_minutes)::BIGINT AS total_minutes, max(peak_depth_cm) AS max_depth_cm,
        min(started_at) AS first_event, max(ended_at) AS last_event FROM found GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
add(
    "a19_event_summary",
    lambda s, d: with_quantiles(
        found(s, d).groupBy("tier_cm").agg(F.max("peak_depth_cm").alias("max_depth_cm"), F.countDistinct("station_code").alias("n_stations")),
        found(s, d), "duration_minutes", {"median_minutes": 0.5, "p90_minutes": 0.9}, ("tier_cm",),
    ),
    f"""WITH {EVENTS} SELECT tier_cm, round(median(duration_minutes), 6) AS median_minutes, round(quantile_cont(duration_minutes, 0.9), 6) AS p90_minutes,
        max(peak_depth_cm) AS max_depth_cm, count(DISTINCT station_code) AS n_stations FROM found GROUP BY 1""",
)
QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.99)
add(
    "a20_duration_quantiles",
    lambda s, d: with_quantiles(found(s, d).select("tier_cm").distinct(), found(s, d), "duration_minutes", {f"q{int(q * 100)}": q for q in QUANTILES}, ("tier_cm",)),
    f"WITH {EVENTS} SELECT tier_cm, " + ", ".join(f"round(quantile_cont(duration_minutes, {q}), 6) AS q{int(q * 100)}" for q in QUANTILES) + " FROM found GROUP BY 1",
)

# -- labels ---------------------------------------------------------------
H = (1, 3, 6)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return labels.labels(grid(spark, sf), TIERS, H, min_share=0.02)


LABELLED = GRID + ", wide AS (SELECT station_code, ts, flood, " + ", ".join(
    f"max(flood) OVER w{h} AS y_maxdepth_{h}h, round(count(flood) OVER w{h} / {h * 12}.0, 6) AS y_obs_share_{h}h" for h in H
) + " FROM grid WINDOW " + ", ".join(
    f"w{h} AS (PARTITION BY station_code ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES FOLLOWING AND INTERVAL {h} HOURS FOLLOWING)" for h in H
) + "), labelled AS (SELECT *, " + ", ".join(f"y_obs_share_{h}h >= 0.02 AS y_valid_{h}h" for h in H) + ", " + ", ".join(
    f"CASE WHEN y_obs_share_{h}h >= 0.02 THEN y_maxdepth_{h}h >= {t} END AS y_ge{t}_{h}h" for h in H for t in TIERS
) + ", " + ", ".join(f"flood < {t} AS is_onset_{t}" for t in TIERS) + " FROM wide WHERE minute(ts) % 15 = 0)"
add("w01_labels", labelled, f"WITH {LABELLED} SELECT * FROM labelled")
add(
    "a11_label_summary",
    lambda s, d: labels.summary(labelled(s, d), TIERS, H),
    f"WITH {LABELLED} " + " UNION ALL ".join(
        f"SELECT {t} AS tier_cm, {h} AS horizon_h, count(*) AS n_rows, count(*) FILTER (WHERE y_valid_{h}h) AS n_valid, "
        f"count(*) FILTER (WHERE y_ge{t}_{h}h) AS n_positive, count(*) FILTER (WHERE y_ge{t}_{h}h AND is_onset_{t}) AS n_onset FROM labelled"
        for t in TIERS for h in H
    ),
)
add(
    "j09_label_check",
    lambda s, d: labels.check_by_join(grid(s, d), labelled(s, d), 3).agg(F.count("*").alias("n_disagree")),
    f"""WITH {LABELLED} SELECT count(*) AS n_disagree FROM labelled p WHERE y_maxdepth_3h IS DISTINCT FROM (
        SELECT max(f.flood) FROM grid f WHERE f.station_code = p.station_code AND f.ts >= p.ts + INTERVAL 5 MINUTES AND f.ts <= p.ts + INTERVAL 3 HOURS)""",
)
add("p06_scorable", lambda s, d: labels.scorable(labelled(s, d), 3).select("station_code", "ts", "y_ge50_3h"),
    f"WITH {LABELLED} SELECT station_code, ts, y_ge50_3h FROM labelled WHERE coalesce(y_valid_3h, false)")
add("p07_embargo", lambda s, d: labels.embargoed(readings(s, d), "2024-01-20").groupBy("station_code").agg(F.count("*").alias("n")),
    f"WITH {READINGS} SELECT station_code, count(*) AS n FROM readings WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS GROUP BY 1")

# -- features -------------------------------------------------------------
DEPTH = GRID + """, base AS (
    SELECT station_code, ts, flood, max(flood) OVER (w RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND INTERVAL 15 MINUTES PRECEDING) AS prev,
        max(flood) OVER (w RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS lag1,
        max(flood) OVER (w RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND INTERVAL 3 HOURS PRECEDING) AS lag3,
        max(flood) OVER (w RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW) AS max3,
        max(flood) OVER (w RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS max24,
        avg(flood) OVER (w RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS mean1,
        stddev_samp(flood) OVER (w RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW) AS std3,
        count(flood) OVER (w RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW) AS seen,
        last_value(CASE WHEN flood >= 50 THEN ts END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_50,
        last_value(CASE WHEN flood >= 100 THEN ts END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_100
    FROM grid WINDOW w AS (PARTITION BY station_code ORDER BY ts)),
depth AS (SELECT station_code, ts, flood AS fl_depth_now, lag1 AS fl_depth_lag_1h, lag3 AS fl_depth_lag_3h, round(flood - prev, 6) AS fl_rise_15min,
        round(flood - lag1, 6) AS fl_rise_1h, max3 AS fl_max_3h, max24 AS fl_max_24h, round(mean1, 6) AS fl_mean_1h, round(std3, 4) AS fl_std_3h,
        round(least(1.0, 1 - seen / 37.0), 6)::DOUBLE AS fl_missing_share_3h, round(date_diff('minute', last_50, ts) / 60.0, 6)::DOUBLE AS fl_hours_since_50cm,
        round(date_diff('minute', last_100, ts) / 60.0, 6)::DOUBLE AS fl_hours_since_100cm FROM base WHERE minute(ts) % 15 = 0)""".replace("(w RANGE", "(PARTITION BY station_code ORDER BY ts RANGE").replace("(w ROWS", "(PARTITION BY station_code ORDER BY ts ROWS")


def depth(spark: SparkSession, sf: str) -> DataFrame:
    return features.depth_features(grid(spark, sf), thresholds=(50, 100))


add("d06_depth_features", depth, f"WITH {DEPTH} SELECT * FROM depth")
RAIN = """rain0 AS (SELECT split_part(station_code, '.', 2) AS district_code, ts, round(avg(flood), 6) AS rain_now, max(flood) AS rain_max, count(flood) AS rain_stations
        FROM grid WHERE minute(ts) % 15 = 0 GROUP BY 1, 2),
rain1 AS (SELECT *, round(rain_max - rain_now, 6) AS rain_spread, lag(rain_now, 4) OVER w AS rain_lag_4, lag(rain_now, 12) OVER w AS rain_lag_12,
        lag(rain_now, 192) OVER w AS rain_lag_192 FROM rain0 WINDOW w AS (PARTITION BY district_code ORDER BY ts)),
rain AS (SELECT *, round(rain_now / nullif(rain_lag_192, 0), 6) AS rain_antecedent_ratio FROM rain1)"""


def rain(spark: SparkSession, sf: str) -> DataFrame:
    return features.district_rain(grid(spark, sf), "flood")


add("d07_district_rain", rain, f"WITH {GRID}, {RAIN} SELECT * FROM rain")
DEAD = "FL.CLI.01"
CITY = f"""risen AS (SELECT *, flood - lag(flood, 12) OVER (PARTITION BY station_code ORDER BY ts) AS rise FROM grid),
city AS (SELECT ts, round(avg(rise) FILTER (WHERE station_code <> '{DEAD}'), 6) AS wl_rise_mean, round(max(rise) FILTER (WHERE station_code <> '{DEAD}'), 6) AS wl_rise_max,
        round(avg(CASE WHEN station_code = '{DEAD}' THEN NULL WHEN rise > 0 THEN 1.0::DOUBLE WHEN rise IS NOT NULL THEN 0.0 END), 6) AS wl_rising_share,
        round(avg(CASE WHEN flood IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS wl_offline_share FROM risen WHERE minute(ts) % 15 = 0 GROUP BY 1)"""


def city(spark: SparkSession, sf: str) -> DataFrame:
    return features.citywide_water(grid(spark, sf), "flood", excluded=(DEAD,))


add("d08_citywide_water", city, f"WITH {GRID}, {CITY} SELECT * FROM city")
CALENDAR = """round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS cal_hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS cal_hour_cos,
    round(sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) AS cal_year_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) AS cal_year_cos,
    round(sin(2 * pi() * (epoch(date_trunc('minute', ts) - TIMESTAMP '2019-01-01') / 3600 / 12.4206012::DOUBLE)), 6) AS cal_tide_sin,
    round(cos(2 * pi() * (epoch(date_trunc('minute', ts) - TIMESTAMP '2019-01-01') / 3600 / 12.4206012::DOUBLE)), 6) AS cal_tide_cos,
    round(cos(2 * pi() * (epoch(date_trunc('minute', ts) - TIMESTAMP '2019-01-01') / 3600 / 24 / 29.530588::DOUBLE)), 6) AS cal_moon_cos,
    month(ts) BETWEEN 5 AND 10 AS cal_monsoon"""
add("d09_calendar", lambda s, d: features.calendar(grid(s, d).select("ts").distinct()), f"WITH {GRID} SELECT DISTINCT ts, {CALENDAR} FROM grid")


def districts(spark: SparkSession, sf: str) -> DataFrame:
    """A registry row per prefix; names from the nations."""
    codes = grid(spark, sf).select(F.split_part("station_code", F.lit("."), F.lit(2)).alias("district_code")).distinct()
    key = (F.ascii(F.substring("district_code", 1, 1)) % 25).alias("n_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("district"))
    return codes.select("district_code", key).join(nation, "n_nationkey").drop("n_nationkey")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rain per district, with the forward and trailing sums."""
    per = readings(spark, sf).join(districts(spark, sf), F.split_part("station_code", F.lit("."), F.lit(2)) == F.col("district_code"))
    per = per.groupBy("district", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("flood"), 6).alias("fcst"))
    return features.forward_rain(per, "fcst")


EXTERNAL = """districts AS (SELECT DISTINCT split_part(station_code, '.', 2) AS district_code, n_name AS district FROM grid
        JOIN nation ON n_nationkey = ascii(substr(split_part(station_code, '.', 2), 1, 1)) % 25),
hour0 AS (SELECT district, date_trunc('hour', ts) AS ts, round(avg(flood), 6) AS fcst FROM readings JOIN districts ON split_part(station_code, '.', 2) = district_code GROUP BY 1, 2),
hourly AS (SELECT district, ts, fcst, """ + ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY district ORDER BY ts RANGE BETWEEN INTERVAL {h} HOURS FOLLOWING AND INTERVAL {h} HOURS FOLLOWING) > 0 THEN "
    f"round(sum(fcst) OVER (PARTITION BY district ORDER BY ts RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL {h} HOURS FOLLOWING), 6) END AS fcst_{h}h"
    for h in H
) + """, round(sum(fcst) OVER (PARTITION BY district ORDER BY ts RANGE BETWEEN INTERVAL 10799999999 MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS fcst_past_3h FROM hour0)"""
add("w12_forward_rain", hourly, f"WITH {GRID}, {EXTERNAL} SELECT * FROM hourly")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table, no year's windows reaching into another; forecasts, which are not measured, may."""
    slots = grid(spark, sf)
    parts = (
        features.depth_features(slots, thresholds=(50, 100), by_year=True), labels.labels(slots, TIERS, H, min_share=0.02, by_year=True),
        features.district_rain(slots, "flood", by_year=True), features.citywide_water(slots, "flood", excluded=(DEAD,), by_year=True),
    )
    return features.feature_table(*parts, districts(spark, sf), hourly(spark, sf))


def _yearly(sql: str) -> str:
    return sql.replace("PARTITION BY station_code ORDER", "PARTITION BY station_code, year(ts) ORDER").replace("PARTITION BY district_code ORDER", "PARTITION BY district_code, year(ts) ORDER")


WIDE = f"""{_yearly(LABELLED)}, {_yearly(DEPTH[len(GRID) + 2:])}, {_yearly(RAIN)}, {_yearly(CITY)}, {EXTERNAL}, wide_table AS (
    SELECT d.*, l.* EXCLUDE (station_code, ts, flood), r.* EXCLUDE (ts), c.* EXCLUDE (ts), m.district, h.* EXCLUDE (district, ts), {CALENDAR.replace('(ts)', '(d.ts)').replace(', ts)', ', d.ts)')},
        round(r.rain_now * d.fl_max_24h, 6) AS rain_x_recent_flood
    FROM depth d LEFT JOIN labelled l USING (station_code, ts)
    LEFT JOIN rain r ON r.district_code = split_part(d.station_code, '.', 2) AND r.ts = d.ts
    LEFT JOIN city c ON c.ts = d.ts LEFT JOIN districts m ON m.district_code = split_part(d.station_code, '.', 2)
    LEFT JOIN hourly h ON h.district = m.district AND h.ts = date_trunc('hour', d.ts))"""
add("d11_feature_table", wide, f"WITH {WIDE} SELECT * FROM wide_table")

# -- quality --------------------------------------------------------------
PROFILE = """SELECT station_code, count(*) AS n_rows, count(DISTINCT ts) AS n_distinct_ts, min(ts) AS first_ts, max(ts) AS last_ts, count(flood) AS n_values,
    min(flood) AS min_value, max(flood) AS max_value, round(avg(flood), 6) AS mean_value, {tiers}, count(*) - count(DISTINCT ts) AS n_duplicates,
    round(count(DISTINCT ts) / 8640.0, 6)::DOUBLE AS completeness, round(100.0 * (count(*) - count(flood)) / count(*), 6)::DOUBLE AS null_pct,
    (count(*) - count(flood)) / count(*) > 0.5 AS offline FROM {source} GROUP BY 1"""
_tiers = ", ".join(f"count(*) FILTER (WHERE flood >= {t}) AS n_ge{t}" for t in TIERS)
add("a01_station_profile", lambda s, d: quality.station_profile(readings(s, d), "flood", quality.expected_rows(30), TIERS),
    f"WITH {READINGS} " + PROFILE.format(tiers=_tiers, source="readings"))
add("a02_scorecard", lambda s, d: quality.scorecard(*(quality.station_profile(x, "flood", 8640, TIERS).drop("mean_value") if k else quality.station_profile(x, "flood", 8640, TIERS) for k, x in enumerate((readings(s, d), grid(s, d))))),
    f"WITH {GRID} SELECT * EXCLUDE (mean_value) FROM ({PROFILE.format(tiers=_tiers, source='readings')}) UNION ALL SELECT * EXCLUDE (mean_value) FROM ({PROFILE.format(tiers=_tiers, source='grid')})")
add("p01_range_check", lambda s, d: quality.range_checked(readings(s, d), {"flood": (0, 200)}).select("event_id", "flood"),
    f"WITH {READINGS} SELECT event_id, CASE WHEN flood BETWEEN 0 AND 200 THEN flood END AS flood FROM readings")
LINE = {"l_quantity": (5, 40), "l_discount": (0.01, 0.09), "l_tax": (0, 0.07)}
add("p02_range_flags", lambda s, d: quality.range_flags(table(s, d, "lineitem"), LINE, ("l_returnflag",)),
    "SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT {c} BETWEEN {a} AND {b}) AS flagged_{c}" for c, (a, b) in LINE.items()) + " FROM lineitem GROUP BY 1")
add("p03_downsample", lambda s, d: grid(s, d).where(F.minute("ts") % 15 == 0), f"WITH {GRID} SELECT * FROM grid WHERE minute(ts) % 15 = 0")
SHARE = ("fl_depth_lag_1h", "fl_rise_1h", "fl_mean_1h", "fl_std_3h", "fl_hours_since_100cm")
add("a24_null_shares", lambda s, d: quality.null_shares(depth(s, d), list(SHARE)),
    f"WITH {DEPTH} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n_rows, count({c}) AS n_values, round(1 - count({c}) / count(*), 6) AS null_share FROM depth" for c in SHARE))
add("a17_value_ranges", lambda s, d: quality.value_ranges(table(s, d, "lineitem"), list(LINE)),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value, round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS null_pct FROM lineitem" for c in LINE))

# -- metrics: an alert is a deep reading, the truth a deeper one within 3 h -----------------------------------


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).where("y_ge100_3h IS NOT NULL AND flood IS NOT NULL")
    return rows.select("station_code", "ts", F.col("flood"), F.col("y_ge100_3h").cast("int").alias("y"), F.col("flood").alias("score"),
                       (F.col("flood") >= 60).cast("int").alias("pred"), F.col("is_onset_100").alias("is_onset"), F.least(F.col("flood") / 300, F.lit(1.0)).alias("prob"))


SCORED = LABELLED + """, scored AS (SELECT station_code, ts, flood, y_ge100_3h::INT AS y, flood AS score, (flood >= 60)::INT AS pred, is_onset_100 AS is_onset,
    least(flood / 300, 1.0) AS prob FROM labelled WHERE y_ge100_3h IS NOT NULL AND flood IS NOT NULL)"""
_M = """count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn"""


def _metrics_sql(key: str, source: str) -> str:
    return f"""counts AS (SELECT {key} {_M} FROM {source} {'GROUP BY ALL' if key else ''}),
    ratios AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM counts)
    SELECT {key} tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
        round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) AS f2, round(1 - r, 6) AS fnr, round(coalesce(fp / nullif(tp + fp, 0), 0), 6) AS far FROM ratios"""


add("m01_binary_metrics", lambda s, d: metrics.binary_metrics(scored(s, d)), f"WITH {SCORED}, {_metrics_sql('', 'scored')}")
add("m05_by_onset", lambda s, d: metrics.by_onset(scored(s, d)),
    f"""WITH {SCORED}, split AS (SELECT 'overall' AS subset, y, pred FROM scored UNION ALL
    SELECT CASE WHEN is_onset IS NULL THEN 'depth_unknown' WHEN is_onset THEN 'onset' ELSE 'ongoing' END, y, pred FROM scored), {_metrics_sql('subset,', 'split')}""")  # fmt: skip
CURVE = """per AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1),
    curve AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(n) OVER w - sum(pos) OVER w AS fp, round(sum(pos) OVER w / sum(n) OVER w, 9) AS precision,
        round(coalesce(sum(pos) OVER w / nullif(sum(pos) OVER (), 0), 0), 9) AS recall FROM per WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
add("w19_pr_curve", lambda s, d: metrics.pr_curve(scored(s, d)), f"WITH {SCORED}, {CURVE} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, precision, recall FROM curve")
add("m02_average_precision", lambda s, d: metrics.average_precision(scored(s, d)),
    f"WITH {SCORED}, {CURVE} SELECT round(sum((recall - coalesce(before, 0)) * precision), 6) AS average_precision FROM (SELECT *, lag(recall) OVER (ORDER BY threshold DESC) AS before FROM curve)")
add("m03_brier", lambda s, d: metrics.brier(scored(s, d)), f"WITH {SCORED} SELECT round(avg(pow(prob - y, 2)), 6) AS brier FROM scored")
add("m04_best_threshold", lambda s, d: metrics.best_threshold(scored(s, d), n_grid=20),
    f"""WITH {SCORED}, q AS (SELECT unnest(quantile_cont(score, {[k / 19 for k in range(20)]})) AS t FROM scored
    UNION SELECT unnest(quantile_cont(score, {[k / 19 for k in range(20)]})) FROM scored WHERE score > (SELECT min(score) FROM scored)
    UNION SELECT unnest(quantile_cont(score, {[k / 19 for k in range(20)]})) FROM scored WHERE y = 1),
    tried AS (SELECT t, coalesce(5.0::DOUBLE * sum((score >= t AND y = 1)::INT) / nullif(4 * sum(y) + sum((score >= t)::INT), 0), 0) AS f FROM q, scored GROUP BY 1)
    SELECT round(t, 6) AS threshold, round(f, 6) AS f2 FROM tried ORDER BY 2 DESC, t LIMIT 1""")  # fmt: skip
HITS = """wet AS (SELECT station_code, ts, lag(ts) OVER (PARTITION BY station_code ORDER BY ts) AS was FROM scored WHERE flood >= 100),
    starts AS (SELECT station_code, ts AS started_at, greatest(ts - INTERVAL 6 HOURS, was + INTERVAL 60 MINUTES) AS since FROM wet WHERE was IS NULL OR date_diff('minute', was, ts) > 60),
    hits AS (SELECT s.station_code, started_at, count(a.ts) > 0 AS hit, round(epoch(started_at - min(a.ts)) / 60, 6) AS lead_minutes
        FROM starts s LEFT JOIN scored a ON a.station_code = s.station_code AND a.pred = 1 AND a.ts >= since AND a.ts < started_at GROUP BY 1, 2)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.event_hits(scored(spark, sf), "flood", "pred", 100, 6)


add("m07_lead_times", hits, f"WITH {SCORED}, {HITS} SELECT * FROM hits")
add("m06_event_pod", lambda s, d: metrics.event_pod(hits(s, d)),
    f"""WITH {SCORED}, {HITS} SELECT count(*) AS n_events, count(*) FILTER (WHERE hit) AS n_detected, round(count(*) FILTER (WHERE hit) / nullif(count(*), 0), 6) AS pod,
    round(quantile_cont(lead_minutes, 0.5), 6) AS lead_median, round(quantile_cont(lead_minutes, 0.25), 6) AS lead_p25 FROM hits""")  # fmt: skip
BINS = f"""edges AS (SELECT DISTINCT unnest(quantile_cont(prob, {[k / 12 for k in range(1, 12)]})) AS e FROM scored),
    binned AS (SELECT prob, y, (SELECT count(*) FROM edges WHERE e < prob) AS bin FROM scored),
    bins AS (SELECT bin::INT AS bin, count(*) AS n, round(avg(prob), 6) AS predicted, round(avg(y), 6) AS observed FROM binned GROUP BY 1)"""
add("m09_reliability", lambda s, d: metrics.reliability(scored(s, d)), f"WITH {SCORED}, {BINS} SELECT *, round(predicted / nullif(observed, 0), 6) AS ratio FROM bins")
add("m10_calibration_error", lambda s, d: metrics.calibration_error(metrics.reliability(scored(s, d))),
    f"WITH {SCORED}, {BINS} SELECT round(sum(n * abs(predicted - observed)) / sum(n), 6) AS ece FROM bins")
add("m12_coverage", lambda s, d: metrics.coverage(labelled(s, d).where("flood IS NOT NULL").withColumns({"lo": F.col("flood") * 0.5, "hi": F.col("flood") * 1.6}), "y_maxdepth_3h", "lo", "hi", 100),
    f"""WITH {LABELLED}, x AS (SELECT y_maxdepth_3h AS t, flood * 0.5 AS lo, flood * 1.6 AS hi, y_maxdepth_3h BETWEEN flood * 0.5 - 1e-9 AND flood * 1.6 + 1e-9 AS inside FROM labelled WHERE flood IS NOT NULL)
    SELECT count(t) AS n, count(*) FILTER (WHERE t >= 100) AS n_wet, round(avg(inside::INT), 6) AS coverage_all,
    round(count(*) FILTER (WHERE inside AND t >= 100) / nullif(count(*) FILTER (WHERE t >= 100), 0), 6) AS coverage_wet, round(quantile_cont(hi - lo, 0.5), 6) AS median_width,
    coalesce(count(*) FILTER (WHERE inside AND t >= 100) / nullif(count(*) FILTER (WHERE t >= 100), 0) BETWEEN 0.85 AND 0.93, false) AS passes FROM x""")  # fmt: skip
add("d18_downsampling_correction", lambda s, d: scored(s, d).select("station_code", "ts", F.round(metrics.corrected(F.col("prob"), 0.05), 9).alias("p")),
    f"WITH {SCORED}, c AS (SELECT station_code, ts, least(greatest(prob, 1e-12), 1 - 1e-12) AS q FROM scored) SELECT station_code, ts, round((q / (1 - q) * 0.05) / (1 + q / (1 - q) * 0.05), 9) AS p FROM c")
