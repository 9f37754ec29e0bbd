"""The remaining aggregates, joins, predicates and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.operators import baselines, features, metrics
from sluice.operators.quantiles import with_quantiles
from sluice.registry import add
from sluice.sources import payloads, stores

from .base import GRID, READINGS, grid, readings, table
from .core import EVENTS, EXTERNAL, LABELLED, SCORED, found, hourly, labelled, scored


def prefix():
    return F.split_part("station_code", F.lit("."), F.lit(2))


# -- aggregates ------------------------------------------------------------
DEAD = "FL.CLI.01"
add("a09_citywide_flow", lambda s, d: grid(s, d).where(F.minute("ts") % 15 == 0).groupBy("ts").agg(
        F.round(F.avg(F.when(F.col("station_code") != DEAD, F.col("flood"))), 6).alias("flow_mean"), F.round(F.avg(F.col("flood").isNull().cast("double")), 6).alias("flow_offline_share")),
    f"WITH {GRID} SELECT ts, round(avg(flood) FILTER (WHERE station_code <> '{DEAD}'), 6) AS flow_mean, round(avg((flood IS NULL)::INT), 6) AS flow_offline_share FROM grid WHERE minute(ts) % 15 = 0 GROUP BY 1")
add("a10_label_rates", lambda s, d: labelled(s, d).where("y_ge50_3h IS NOT NULL").select("station_code", F.hour("ts").alias("hour"), F.col("y_ge50_3h").cast("double").alias("y")).cube("station_code", "hour").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate")),
    f"WITH {LABELLED} SELECT station_code, hour(ts)::INT AS hour, count(*) AS n, round(avg(y_ge50_3h::INT), 6) AS rate FROM labelled WHERE y_ge50_3h IS NOT NULL GROUP BY CUBE (station_code, hour(ts)::INT)")
add("a25_block_coverage", lambda s, d: labelled(s, d).groupBy(F.weekofyear("ts").alias("week")).agg(F.round(F.avg(F.col("flood").isNotNull().cast("double")), 6).alias("depth_share"), F.round(F.avg(F.col("y_ge50_3h").isNotNull().cast("double")), 6).alias("label_share")),
    f"WITH {LABELLED} SELECT weekofyear(ts)::INT AS week, round(avg((flood IS NOT NULL)::INT), 6) AS depth_share, round(avg((y_ge50_3h IS NOT NULL)::INT), 6) AS label_share FROM labelled GROUP BY 1")
add("a35_live_forecast", lambda s, d: _ahead(hourly(s, d)),
    f"""WITH {GRID}, {EXTERNAL}, h AS (SELECT unnest([1, 3, 6])::INT AS horizon), x AS (SELECT horizon, district, sum(fcst) AS total FROM hourly, h
    WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-15' + horizon * INTERVAL 1 HOUR GROUP BY 1, 2) SELECT horizon, round(avg(total), 6) AS mean_total FROM x GROUP BY 1""")  # fmt: skip


def _ahead(h):
    """Rain to come: summed per district over 0 < lead <= horizon, then averaged over districts."""
    start = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    lead = F.timestamp_diff("SECOND", start, F.col("ts")) / 3600
    rows = h.select("district", "fcst", lead.alias("lead"), F.explode(F.array(*(F.lit(x) for x in C.HORIZONS_HOURS))).alias("horizon"))
    total = rows.where("lead > 0 AND lead <= horizon").groupBy("horizon", "district").agg(F.sum("fcst").alias("total"))
    return total.groupBy("horizon").agg(F.round(F.avg("total"), 6).alias("mean_total"))


add("a41_over_and_under", lambda s, d: scored(s, d).groupBy((F.col("flood") >= 100).alias("deep")).agg(F.count("*").alias("n"), F.round(F.avg(((F.col("pred") == 1) & (F.col("y") == 0)).cast("double")), 6).alias("over"), F.round(F.avg(((F.col("pred") == 0) & (F.col("y") == 1)).cast("double")), 6).alias("under")),
    f"WITH {SCORED} SELECT flood >= 100 AS deep, count(*) AS n, round(avg((pred = 1 AND y = 0)::INT), 6) AS over, round(avg((pred = 0 AND y = 1)::INT), 6) AS under FROM scored GROUP BY 1")
add("a43_wet_profile", lambda s, d: readings(s, d).groupBy("station_code").agg(F.count_if(F.col("flood") >= 100).alias("n_pos"), F.count_if(F.col("flood") < 100).alias("n_neg")).transform(lambda n: with_quantiles(n, readings(s, d).where("flood >= 100"), "flood", {"median_wet": 0.5}, ("station_code",))),
    f"WITH {READINGS} SELECT station_code, count(*) FILTER (WHERE flood >= 100) AS n_pos, count(*) FILTER (WHERE flood < 100) AS n_neg, round(median(flood) FILTER (WHERE flood >= 100), 6) AS median_wet FROM readings GROUP BY 1")
_family = lambda: F.when(F.col("p_type").startswith("STANDARD"), "standard").when(F.col("p_type").startswith("SMALL"), "small").otherwise("other")
add("a45_share_by_family", lambda s, d: table(s, d, "part").groupBy(_family().alias("family")).agg(F.sum("p_retailprice").alias("gain")).select("family", F.round(F.col("gain") / F.sum("gain").over(Window.partitionBy()), 6).alias("share")),
    "WITH g AS (SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'SMALL%' THEN 'small' ELSE 'other' END AS family, sum(p_retailprice) AS gain FROM part GROUP BY 1) SELECT family, round(gain / sum(gain) OVER (), 6) AS share FROM g")
add("a46_events_per_sensor", lambda s, d: readings(s, d).select("station_code", prefix().alias("district")).distinct().groupBy("district").agg(F.count("*").alias("n_sensors")).join(
        found(s, d).where("tier_cm = 100").groupBy(prefix().alias("district")).agg(F.count("*").alias("n")), "district", "left").select("district", "n_sensors", F.coalesce("n", F.lit(0).cast("long")).alias("n_events"), F.round(F.try_divide(F.coalesce("n", F.lit(0)), F.col("n_sensors")), 6).alias("per_sensor")),
    f"""WITH {EVENTS}, s AS (SELECT split_part(station_code, '.', 2) AS district, count(DISTINCT station_code) AS n_sensors FROM readings GROUP BY 1), e AS (SELECT split_part(station_code, '.', 2) AS district, count(*) AS n FROM found WHERE tier_cm = 100 GROUP BY 1)
    SELECT district, n_sensors, coalesce(n, 0) AS n_events, round(coalesce(n, 0) / n_sensors, 6) AS per_sensor FROM s LEFT JOIN e USING (district)""")  # fmt: skip
add("a48_verdict", lambda s, d: metrics.binary_metrics(scored(s, d), by=("pred",)).select("pred", F.when(F.col("precision") > 0.205, "better").when(F.col("precision") < 0.195, "worse").otherwise("same").alias("verdict")),
    f"""WITH {SCORED}, p AS (SELECT pred, round(coalesce(count(*) FILTER (WHERE y = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE pred = 1), 0), 0), 6) AS p FROM scored GROUP BY 1)
    SELECT pred, CASE WHEN p > 0.205 THEN 'better' WHEN p < 0.195 THEN 'worse' ELSE 'same' END AS verdict FROM p""")  # fmt: skip
add("n06_trends_rollup", lambda s, d: found(s, d).rollup(prefix().alias("district"), "station_code").agg(F.count("*").alias("n_events"), F.sum("duration_minutes").alias("minutes")),
    f"WITH {EVENTS} SELECT split_part(station_code, '.', 2) AS district, station_code, count(*) AS n_events, sum(duration_minutes)::BIGINT AS minutes FROM found GROUP BY ROLLUP (split_part(station_code, '.', 2), station_code)")
add("n05_miss_concentration", lambda s, d: scored(s, d).where("y = 1 AND pred = 0").groupBy("station_code").agg(F.count("*").alias("n")).withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("n"), "station_code")), "all": F.sum("n").over(Window.partitionBy())}).where("rank <= 10").agg(F.round(F.sum("n") / F.max("all"), 6).alias("top10_share")),
    f"WITH {SCORED}, m AS (SELECT station_code, count(*) AS n FROM scored WHERE y = 1 AND pred = 0 GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, station_code) AS k, sum(n) OVER () AS total FROM m) SELECT round(sum(n) / max(total), 6) AS top10_share FROM r WHERE k <= 10")

# -- joins -----------------------------------------------------------------
_side = lambda h, n: h.where(f"hour(ts) % {n} = 0").select("district", "ts", F.col("fcst").alias(f"every_{n}h"))
add("j10_external_outer", lambda s, d: _side(hourly(s, d), 2).join(_side(hourly(s, d), 3), ["district", "ts"], "full"),
    f"WITH {GRID}, {EXTERNAL} SELECT district, ts, a.fcst AS every_2h, b.fcst AS every_3h FROM (SELECT * FROM hourly WHERE hour(ts) % 2 = 0) a FULL JOIN (SELECT * FROM hourly WHERE hour(ts) % 3 = 0) b USING (district, ts)")
add("j11_inner", lambda s, d: _side(hourly(s, d), 2).join(_side(hourly(s, d), 3), ["district", "ts"]),
    f"WITH {GRID}, {EXTERNAL} SELECT district, ts, a.fcst AS every_2h, b.fcst AS every_3h FROM (SELECT * FROM hourly WHERE hour(ts) % 2 = 0) a JOIN (SELECT * FROM hourly WHERE hour(ts) % 3 = 0) b USING (district, ts)")
add("j14_daily_by_dimension", lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")),
    "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("d30_blind_spots", lambda s, d: table(s, d, "nation").join(table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti").select("n_name"),
    "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
add("d34_first_per_prefix", lambda s, d: stores.first_per_prefix(table(s, d, "supplier").select(F.substring("s_name", 1, 10).alias("prefix"), F.col("s_nationkey").alias("district"), "s_suppkey"), "s_suppkey"),
    "SELECT substr(s_name, 1, 10) AS prefix, s_nationkey AS district, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY substr(s_name, 1, 10) ORDER BY s_suppkey) = 1")

# -- comparisons and metrics ------------------------------------------------
add("d29_rain_value", lambda s, d: readings(s, d).groupBy(prefix().alias("district"), F.to_date("ts").cast("string").alias("day")).agg(F.avg("flood").alias("rain"), F.max((F.col("flood") >= 200).cast("int")).alias("wet")).where("wet IS NOT NULL").groupBy("wet").agg(F.count("*").alias("n"), F.round(F.avg("rain"), 6).alias("mean_rain")),
    f"WITH {READINGS}, x AS (SELECT split_part(station_code, '.', 2) AS district, ts::DATE AS day, avg(flood) AS rain, max((flood >= 200)::INT) AS wet FROM readings GROUP BY 1, 2) SELECT wet, count(*) AS n, round(avg(rain), 6) AS mean_rain FROM x WHERE wet IS NOT NULL GROUP BY 1")
add("d31_coflooding", lambda s, d: readings(s, d).groupBy("station_code", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.max("flood").alias("deepest")).groupBy(prefix().alias("district"), "h").agg(F.count("deepest").alias("n"), F.count_if(F.col("deepest") >= 50).alias("wet")).where("n >= 2 AND wet > 0").groupBy("district").agg(F.round(F.avg(F.col("wet") / F.col("n")), 6).alias("share")),
    f"""WITH {READINGS}, a AS (SELECT station_code, date_trunc('hour', ts) AS h, max(flood) AS deepest FROM readings GROUP BY 1, 2), b AS (SELECT split_part(station_code, '.', 2) AS district, h, count(deepest) AS n, count(*) FILTER (WHERE deepest >= 50) AS wet FROM a GROUP BY 1, 2)
    SELECT district, round(avg(wet / n), 6) AS share FROM b WHERE n >= 2 AND wet > 0 GROUP BY 1""")  # fmt: skip
add("d35_three_states", lambda s, d: _states(hourly(s, d)),
    f"""WITH {GRID}, {EXTERNAL}, x AS (SELECT district, fcst, lag(fcst) OVER (PARTITION BY district ORDER BY ts) AS other FROM hourly), y AS (SELECT district, count(other) / count(*) AS present, avg((fcst = other)::INT) AS same FROM x GROUP BY 1)
    SELECT district, CASE WHEN present < 0.5 THEN 'NO DATA' WHEN same > 0.99 THEN 'SAME' ELSE 'DIFFERENT' END AS state FROM y""")  # fmt: skip


def _states(h):
    x = h.withColumn("other", F.lag("fcst").over(Window.partitionBy("district").orderBy("ts")))
    y = x.groupBy("district").agg((F.count("other") / F.count("*")).alias("present"), F.avg((F.col("fcst") == F.col("other")).cast("double")).alias("same"))
    return y.select("district", F.when(F.col("present") < 0.5, "NO DATA").when(F.col("same") > 0.99, "SAME").otherwise("DIFFERENT").alias("state"))


add("d36_roughness", lambda s, d: with_quantiles(grid(s, d).select("station_code").distinct(), grid(s, d).withColumn("step", F.abs(F.col("flood") - F.lag("flood").over(Window.partitionBy("station_code").orderBy("ts")))), "step", {"median_step": 0.5, "p99_step": 0.99}, ("station_code",)),
    f"WITH {GRID}, x AS (SELECT station_code, abs(flood - lag(flood) OVER (PARTITION BY station_code ORDER BY ts)) AS step FROM grid) SELECT station_code, round(quantile_cont(step, 0.5), 6) AS median_step, round(quantile_cont(step, 0.99), 6) AS p99_step FROM x GROUP BY 1")
_base = lambda s, d, f: metrics.average_precision(f(scored(s, d).drop("score")))
add("d14_persistence_score", lambda s, d: _base(s, d, lambda x: baselines.persistence(x, "flood")),
    f"""WITH {SCORED}, per AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1), curve AS (SELECT score, round(sum(pos) OVER w / sum(n) OVER w, 9) AS p, round(sum(pos) OVER w / sum(pos) OVER (), 9) AS r FROM per WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    steps AS (SELECT p, r - coalesce(lag(r) OVER (ORDER BY score DESC), 0) AS step FROM curve) SELECT round(sum(p * step), 6) AS average_precision FROM steps""")  # fmt: skip
add("d14_always_negative", lambda s, d: metrics.binary_metrics(baselines.always_negative(scored(s, d)).withColumn("pred", (F.col("score") > 0).cast("int"))).select("tp", "fp", "fn", "tn", "recall"),
    f"WITH {SCORED} SELECT 0::BIGINT AS tp, 0::BIGINT AS fp, count(*) FILTER (WHERE y = 1) AS fn, count(*) FILTER (WHERE y = 0) AS tn, 0.0::DOUBLE AS recall FROM scored")
add("m13_base_rate", lambda s, d: scored(s, d).agg(F.round(F.avg("y"), 6).alias("base_rate"), F.round(F.try_divide(F.avg(F.when(F.col("pred") == 1, F.col("y"))), F.avg("y")), 6).alias("lift")),
    f"WITH {SCORED} SELECT round(avg(y), 6) AS base_rate, round(avg(y) FILTER (WHERE pred = 1) / avg(y), 6) AS lift FROM scored")
add("m14_lead_histogram", lambda s, d: metrics.event_hits(scored(s, d), "flood", "pred", 100, 6).where("hit").groupBy(F.floor(F.col("lead_minutes") / 60).cast("int").alias("hours")).agg(F.count("*").alias("n")),
    f"""WITH {SCORED}, wet AS (SELECT station_code, ts, lag(ts) OVER (PARTITION BY station_code ORDER BY ts) AS was FROM scored WHERE flood >= 100),
    starts AS (SELECT station_code, ts AS began, greatest(ts - INTERVAL 6 HOURS, was + INTERVAL 60 MINUTES) AS since FROM wet WHERE was IS NULL OR date_diff('minute', was, ts) > 60),
    hits AS (SELECT s.station_code, began, epoch(began - min(a.ts)) / 60 AS lead FROM starts s JOIN scored a ON a.station_code = s.station_code AND a.pred = 1 AND a.ts >= since AND a.ts < began GROUP BY 1, 2)
    SELECT floor(lead / 60)::INT AS hours, count(*) AS n FROM hits GROUP BY 1""")  # fmt: skip

# -- predicates and projections --------------------------------------------
add("p04_feature_columns", lambda s, d: labelled(s, d).select("station_code", "ts", *features.feature_columns(labelled(s, d))), f"WITH {LABELLED} SELECT station_code, ts, flood FROM labelled")
add("p12_phrase_or_word", lambda s, d: table(s, d, "documents").select("doc_id", (F.coalesce(F.col("text").rlike("(?:licen[cs]e|GNU)"), F.lit(False)) | payloads.any_keyword(F.col("text"), ("rights",))).alias("hit")),
    "SELECT doc_id, coalesce(regexp_matches(text, '(?:licen[cs]e|GNU)'), false) OR contains(lower(coalesce(text, '')), 'rights') AS hit FROM documents")
add("p16_neither", lambda s, d: table(s, d, "orders").where(~(F.col("o_orderstatus") == "F") & ~(F.col("o_orderpriority").startswith("1"))).groupBy("o_orderstatus").agg(F.count("*").alias("n")),
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT o_orderstatus = 'F' AND NOT o_orderpriority LIKE '1%' GROUP BY 1")
add("p09_point_lookup", lambda s, d: grid(s, d).where(F.col("ts") == F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")), f"WITH {GRID} SELECT * FROM grid WHERE ts = TIMESTAMP '2024-01-15 12:00:00'")
add("s11_registry_quality", lambda s, d: stores.coordinate_quality(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).alias("lat"), (F.col("s_suppkey") % 3 == 0).alias("is_district_centroid"), (F.col("s_suppkey") % 2 == 0).alias("is_subdistrict_centroid"))).groupBy("coord_quality").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'none' WHEN s_suppkey % 3 = 0 THEN 'district_centroid' WHEN s_suppkey % 2 = 0 THEN 'subdistrict_centroid' ELSE 'inferred_other' END AS coord_quality, count(*) AS n FROM supplier GROUP BY 1")
add("s14_prefer_last", lambda s, d: stores.preferred([hourly(s, d).where("hour(ts) < 12").select("district", "ts", "fcst"), hourly(s, d).select("district", "ts", (F.col("fcst") + 1).alias("fcst"))], ["district", "ts"], "fcst"),
    f"WITH {GRID}, {EXTERNAL} SELECT district, ts, fcst + 1 AS fcst FROM hourly WHERE fcst IS NOT NULL")
add("s18_poll_store", lambda s, d: stores.read_history(s, stores.append_poll(stores.append_poll(None, readings(s, d).where("event_id % 2 = 0"), "v1"), readings(s, d).where("event_id % 2 = 1"), "v1")).select("event_id", "station_code", "_collector_version"),
    f"WITH {READINGS} SELECT event_id, station_code, 'v1' AS _collector_version FROM readings")
