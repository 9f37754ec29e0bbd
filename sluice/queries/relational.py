"""Joins, aggregations, windows, samples and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import constants as C
from sluice.functions.timeutil import floor_minutes, minutes_between
from sluice.operators import baselines, metrics, sampling
from sluice.operators.quantiles import with_quantiles
from sluice.registry import add
from sluice.sources import payloads

from .base import GRID, READINGS, exact_mean, exact_mean_sql, grid, readings, table
from .core import DEPTH, EVENTS, EXTERNAL, LABELLED, SCORED, TIERS, depth, found, hourly, labelled, rain, scored  # noqa: F401


def prefix():
    return F.split_part("station_code", F.lit("."), F.lit(2))


# -- joins ----------------------------------------------------------------
add("j07_full_outer", lambda s, d: readings(s, d).where("station_code LIKE 'FL.CLI%'").groupBy(floor_minutes("ts", 15).alias("ts")).agg(F.count("*").alias("a")).join(
        readings(s, d).where("station_code LIKE 'FL.VIE%'").groupBy(floor_minutes("ts", 15).alias("ts")).agg(F.count("*").alias("b")), "ts", "full"),
    f"""WITH {READINGS}, a AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS a FROM readings WHERE station_code LIKE 'FL.CLI%' GROUP BY 1),
    b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS b FROM readings WHERE station_code LIKE 'FL.VIE%' GROUP BY 1) SELECT ts, a, b FROM a FULL JOIN b USING (ts)""")  # fmt: skip
TRAIN, TEST = "ts < TIMESTAMP_NTZ '2024-01-20'", "ts >= TIMESTAMP_NTZ '2024-01-20'"
CLIMATE = LABELLED + """, train AS (SELECT station_code, hour(ts) AS hour, month(ts) AS month, y_ge50_3h::INT::DOUBLE AS y FROM labelled WHERE ts < TIMESTAMP '2024-01-20' AND y_ge50_3h IS NOT NULL),
    cell AS (SELECT station_code, hour, month, count(*) AS n, avg(y) AS cell_rate FROM train GROUP BY 1, 2, 3), station AS (SELECT station_code, avg(y) AS station_rate FROM train GROUP BY 1),
    climate AS (SELECT station_code, hour::INT AS hour, month::INT AS month, n, round(CASE WHEN n >= 5 THEN cell_rate ELSE station_rate END, 6) AS rate FROM cell LEFT JOIN station USING (station_code))"""
climate = lambda s, d: baselines.climatology(labelled(s, d).where(TRAIN), "y_ge50_3h", 5)
add("d15_climatology", climate, f"WITH {CLIMATE} SELECT * FROM climate")
add("j13_apply_climatology", lambda s, d: baselines.apply_climatology(labelled(s, d).where(TEST).select("station_code", "ts"), climate(s, d), labelled(s, d).where(TRAIN), "y_ge50_3h"),
    f"""WITH {CLIMATE} SELECT l.station_code, l.ts, coalesce(rate, (SELECT round(avg(y), 6) FROM train)) AS score FROM labelled l
    LEFT JOIN climate c ON c.station_code = l.station_code AND c.hour = hour(l.ts) AND c.month = month(l.ts) WHERE l.ts >= TIMESTAMP '2024-01-20'""")  # fmt: skip
add("j12_shifted_self_join", lambda s, d: hourly(s, d).select("district", "ts", "fcst").join(
        hourly(s, d).select("district", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("fcst").alias("fcst_before")), ["district", "ts"], "left"),
    f"WITH {GRID}, {EXTERNAL} SELECT a.district, a.ts, a.fcst, b.fcst AS fcst_before FROM hourly a LEFT JOIN hourly b ON b.district = a.district AND b.ts + INTERVAL 1 HOUR = a.ts")
add("j15_district_day_flag", lambda s, d: table(s, d, "nation").select("n_name").crossJoin(
        F.broadcast(readings(s, d).select(F.to_date("ts").cast("string").alias("day")).distinct())).join(
        table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n_orders")), "n_name", "left")
        .select("n_name", "day", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"), F.col("n_orders").isNotNull().alias("has_orders")),
    f"""WITH {READINGS}, days AS (SELECT DISTINCT ts::DATE::VARCHAR AS day FROM readings), o AS (SELECT n_name, count(*) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT n_name, day, coalesce(n_orders, 0) AS n_orders, n_orders IS NOT NULL AS has_orders FROM nation CROSS JOIN days LEFT JOIN o USING (n_name)""")  # fmt: skip
add("j16_fill_missing", lambda s, d: table(s, d, "nation").join(table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_sensors")), "n_nationkey", "left").select("n_name", F.coalesce("n_sensors", F.lit(0).cast("long")).alias("n_sensors")),
    "SELECT n_name, coalesce(n, 0) AS n_sensors FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
add("j17_reconcile_counts", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).join(table(s, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_lines").agg(F.count("*").alias("n_orders")),
    "SELECT n_lines, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
add("j18_score_context", lambda s, d: scored(s, d).select("station_code", "ts", "score").join(depth(s, d).select("station_code", "ts", "fl_max_3h", "fl_mean_1h"), ["station_code", "ts"]),
    f"WITH {SCORED}, {DEPTH[len(GRID) + 2:]} SELECT s.station_code, s.ts, s.score, d.fl_max_3h, d.fl_mean_1h FROM scored s JOIN depth d USING (station_code, ts)")
add("j19_prefix_coverage", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).withColumn("side", F.lit("both")).unionByName(
        table(s, d, "customer").select(F.col("c_nationkey").alias("k")).distinct().join(table(s, d, "supplier").select(F.col("s_nationkey").alias("k")), "k", "left_anti").withColumn("side", F.lit("customer"))),
    "SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customer' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
add("j20_before_after", lambda s, d: table(s, d, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n")).alias("a").join(
        table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).alias("b"), "o_orderpriority").select("o_orderpriority", F.col("a.n").alias("n_after"), F.col("b.n").alias("n_before")),
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_after, count(*) AS n_before FROM orders GROUP BY 1 HAVING n_after > 0")
add("p15_membership", lambda s, d: readings(s, d).where(~F.col("station_code").isin("FL.CLI.00", "FL.CLI.01")).groupBy("station_code").agg(F.count("*").alias("n")),
    f"WITH {READINGS} SELECT station_code, count(*) AS n FROM readings WHERE station_code NOT IN ('FL.CLI.00', 'FL.CLI.01') GROUP BY 1")

# -- aggregations ---------------------------------------------------------
add("a07_district_spread", lambda s, d: grid(s, d).groupBy(prefix().alias("district"), "ts").agg(F.round(F.max("flood") - F.avg("flood"), 6).alias("spread"), F.count("flood").alias("n")),
    f"WITH {GRID} SELECT split_part(station_code, '.', 2) AS district, ts, round(max(flood) - avg(flood), 6) AS spread, count(flood) AS n FROM grid GROUP BY 1, 2")
add("a16_null_trend", lambda s, d: readings(s, d).groupBy(F.to_date("ts").cast("string").alias("day"), "station_code").agg(F.count("*").alias("n"), F.count_if(F.col("flood").isNull()).alias("nulls")).groupBy("day").agg(
        F.round(100 * F.sum("nulls") / F.sum("n"), 6).alias("null_pct"), F.count("*").alias("n_stations"), F.count_if(F.col("nulls") / F.col("n") > 0.5).alias("n_offline")),
    f"""WITH {READINGS}, x AS (SELECT ts::DATE::VARCHAR AS day, station_code, count(*) AS n, count(*) - count(flood) AS nulls FROM readings GROUP BY 1, 2)
    SELECT day, round(100.0::DOUBLE * sum(nulls) / sum(n), 6) AS null_pct, count(*) AS n_stations, count(*) FILTER (WHERE nulls / n > 0.5) AS n_offline FROM x GROUP BY 1""")  # fmt: skip
add("a18_inventory_rollup", lambda s, d: readings(s, d).select(prefix().alias("district"), F.to_date("ts").cast("string").alias("day"), "ts").rollup("district", "day").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("n_distinct"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
    f"WITH {READINGS} SELECT split_part(station_code, '.', 2) AS district, ts::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT ts) AS n_distinct, min(ts) AS first_ts, max(ts) AS last_ts FROM readings GROUP BY ROLLUP (1, 2)")
add("a21_days_per_station", lambda s, d: readings(s, d).groupBy("station_code").agg(F.countDistinct(F.to_date("ts")).alias("n_days")).withColumn("partial", F.col("n_days") < 30),
    f"WITH {READINGS} SELECT station_code, count(DISTINCT ts::DATE) AS n_days, count(DISTINCT ts::DATE) < 30 AS partial FROM readings GROUP BY 1")
add("a22_daily_district_rain", lambda s, d: readings(s, d).groupBy(prefix().alias("district"), F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("flood") / F.countDistinct("station_code"), 6).alias("rain")),
    f"WITH {READINGS} SELECT split_part(station_code, '.', 2) AS district, ts::DATE::VARCHAR AS day, round(sum(flood) / count(DISTINCT station_code), 6) AS rain FROM readings GROUP BY 1, 2")


def _ranked(df: DataFrame, c: str, rank: str) -> DataFrame:
    """``df`` with the mean rank of its ``c``, by a running count of distinct values."""
    counts = metrics.running(df.groupBy(c).agg(F.count("*").alias("n")), c, ("n",))
    n = df.agg(F.count("*").alias("all"))
    return df.join(counts.crossJoin(F.broadcast(n)).select(c, (F.col("all") - F.col("run_n") + (F.col("n") + 1) / 2).alias(rank)), c)


add("a23_correlations", lambda s, d: _ranked(_ranked(table(s, d, "part").select("p_size", "p_retailprice"), "p_size", "rx"), "p_retailprice", "ry").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman")),
    """SELECT round(corr(p_size, p_retailprice), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT p_size, p_retailprice,
    rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS ry FROM part)""")  # fmt: skip
add("a26_coverage_report", lambda s, d: readings(s, d).groupBy(F.weekofyear("ts").alias("week")).agg(F.countDistinct("station_code").alias("n_stations"), F.count("*").alias("n_rows"), F.count("flood").alias("n_values")),
    f"WITH {READINGS} SELECT weekofyear(ts)::INT AS week, count(DISTINCT station_code) AS n_stations, count(*) AS n_rows, count(flood) AS n_values FROM readings GROUP BY 1")
add("a27_coverage_hours", lambda s, d: readings(s, d).agg(F.round(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 3600, 2).alias("hours")).withColumn("cold_start", F.col("hours") < C.COLD_START_HOURS),
    f"WITH {READINGS}, h AS (SELECT round(datesub('second', min(ts), max(ts)) / 3600.0::DOUBLE, 2) AS hours FROM readings) SELECT hours, hours < 24 AS cold_start FROM h")
add("a28_registry_summary", lambda s, d: table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")),
    "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
add("a29_two_level", lambda s, d: readings(s, d).groupBy("station_code", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts")).agg(F.max("flood").alias("deepest")).groupBy(prefix().alias("district"), "hour_ts").agg(F.count("deepest").alias("n"), F.count_if(F.col("deepest") >= 100).alias("n_wet"), F.max("deepest").alias("deepest")),
    f"""WITH {READINGS}, x AS (SELECT station_code, date_trunc('hour', ts) AS hour_ts, max(flood) AS deepest FROM readings GROUP BY 1, 2)
    SELECT split_part(station_code, '.', 2) AS district, hour_ts, count(deepest) AS n, count(*) FILTER (WHERE deepest >= 100) AS n_wet, max(deepest) AS deepest FROM x GROUP BY 1, 2""")  # fmt: skip
add("a30_misses_by_hour", lambda s, d: scored(s, d).where("y = 1").groupBy(F.hour("ts").alias("hour")).agg(F.count_if(F.col("pred") == 0).alias("fn"), F.count_if(F.col("pred") == 1).alias("tp")).withColumn("miss_rate", F.round(F.col("fn") / (F.col("fn") + F.col("tp")), 6)),
    f"WITH {SCORED} SELECT hour(ts)::INT AS hour, count(*) FILTER (WHERE pred = 0) AS fn, count(*) FILTER (WHERE pred = 1) AS tp, round(count(*) FILTER (WHERE pred = 0) / count(*), 6) AS miss_rate FROM scored WHERE y = 1 GROUP BY 1")
add("a31_caught_and_missed", lambda s, d: with_quantiles(scored(s, d).where("y = 1").groupBy("pred").agg(F.count("*").alias("n")), scored(s, d).where("y = 1"), "flood", {"median_depth": 0.5}, ("pred",)),
    f"WITH {SCORED} SELECT pred, count(*) AS n, round(median(flood), 6) AS median_depth FROM scored WHERE y = 1 GROUP BY 1")
add("a36_grouped_transform", lambda s, d: hourly(s, d).select("district", "ts", "fcst", exact_mean("fcst", 3, Window.partitionBy("district", F.month("ts"), F.hour("ts"))).alias("usual")),
    f"WITH {GRID}, {EXTERNAL} SELECT district, ts, fcst, {exact_mean_sql('fcst', 3, 'OVER (PARTITION BY district, month(ts), hour(ts))')} AS usual FROM hourly")
add("a37_wet_hour_skill", lambda s, d: hourly(s, d).withColumn("later", F.lead("fcst").over(Window.partitionBy("district").orderBy("ts"))).agg(F.round(F.corr("fcst", "later"), 6).alias("corr"), F.round(F.avg(((F.col("fcst") >= 50) == (F.col("later") >= 50)).cast("double")), 6).alias("agree")),
    f"WITH {GRID}, {EXTERNAL}, x AS (SELECT fcst, lead(fcst) OVER (PARTITION BY district ORDER BY ts) AS later FROM hourly) SELECT round(corr(fcst, later), 6) AS corr, round(avg(((fcst >= 50) = (later >= 50))::INT), 6) AS agree FROM x")
add("a38_summary", lambda s, d: with_quantiles(readings(s, d).agg(F.count("flood").alias("n"), F.round(F.avg("flood"), 6).alias("mean"), F.round(F.stddev_pop("flood"), 6).alias("std")), readings(s, d), "flood", {f"p{p}": p / 100 for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}),
    f"WITH {READINGS} SELECT count(flood) AS n, round(avg(flood), 6) AS mean, round(stddev_pop(flood), 6) AS std, " + ", ".join(f"round(quantile_cont(flood, {p / 100}), 6) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM readings")
add("w20_histogram_percentiles", lambda s, d: _histogram(readings(s, d)),
    f"""WITH {READINGS}, b AS (SELECT floor(flood)::INT AS bin, count(*) AS n FROM readings WHERE flood IS NOT NULL GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS total FROM b)
    SELECT q::INT AS q, min(bin) + 0.5::DOUBLE AS value FROM c, (VALUES (10), (50), (90)) t(q) WHERE run >= total * q / 100.0 GROUP BY 1""")  # fmt: skip


def _histogram(df):
    """Percentiles from one-unit bins: counts merge by addition, so the sketch fits any number of rows."""
    bins = df.where("flood IS NOT NULL").groupBy(F.floor("flood").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    run = bins.withColumns({"run": F.sum("n").over(Window.orderBy("bin")), "total": F.sum("n").over(Window.partitionBy())})
    q = F.explode(F.array(F.lit(10), F.lit(50), F.lit(90))).alias("q")
    return run.select("*", q).where(F.col("run") >= F.col("total") * F.col("q") / 100.0).groupBy("q").agg((F.min("bin") + 0.5).alias("value"))


add("a39_fold_means", lambda s, d: scored(s, d).groupBy(F.weekofyear("ts").alias("fold"), "pred").agg(F.avg("y").alias("rate")).groupBy("pred").agg(F.round(F.avg("rate"), 6).alias("mean_rate")),
    f"WITH {SCORED}, x AS (SELECT weekofyear(ts) AS fold, pred, avg(y) AS rate FROM scored GROUP BY 1, 2) SELECT pred, round(avg(rate), 6) AS mean_rate FROM x GROUP BY 1")
add("a40_identical_share", lambda s, d: _identical(hourly(s, d)),
    f"""WITH {GRID}, {EXTERNAL} SELECT round(avg((fcst = past)::INT), 6) AS same_all, round(avg((fcst = past)::INT) FILTER (WHERE fcst > 50), 6) AS same_wet, count(past) AS n
    FROM (SELECT fcst, lag(fcst) OVER (PARTITION BY district ORDER BY ts) AS past FROM hourly)""")  # fmt: skip


def _identical(h):
    x = h.withColumn("past", F.lag("fcst").over(Window.partitionBy("district").orderBy("ts")))
    same = (F.col("fcst") == F.col("past")).cast("double")
    return x.agg(F.round(F.avg(same), 6).alias("same_all"), F.round(F.avg(F.when(F.col("fcst") > 50, same)), 6).alias("same_wet"), F.count("past").alias("n"))


add("a44_poll_reference", lambda s, d: with_quantiles(readings(s, d).groupBy("station_code").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id")), readings(s, d), "flood", {"median_depth": 0.5}, ("station_code",)),
    f"WITH {READINGS} SELECT station_code, arg_max(event_id, (ts, event_id)) AS last_id, round(median(flood), 6) AS median_depth FROM readings GROUP BY 1")
add("a47_monotone_decay", lambda s, d: labelled(s, d).agg(*(F.count_if(F.col(f"y_ge50_{h}h")).alias(f"h{h}") for h in (1, 3, 6))).selectExpr("stack(3, 1, h1, 3, h3, 6, h6) AS (horizon, n)").select("horizon", "n", (F.col("n") >= F.coalesce(F.lag("n").over(Window.orderBy("horizon")), F.lit(0))).alias("grows")),
    f"""WITH {LABELLED}, x AS (SELECT 1 AS horizon, count(*) FILTER (WHERE y_ge50_1h) AS n FROM labelled UNION ALL SELECT 3, count(*) FILTER (WHERE y_ge50_3h) FROM labelled UNION ALL SELECT 6, count(*) FILTER (WHERE y_ge50_6h) FROM labelled)
    SELECT horizon, n, n >= coalesce(lag(n) OVER (ORDER BY horizon), 0) AS grows FROM x""")  # fmt: skip

# -- windows --------------------------------------------------------------
by = lambda: Window.partitionBy("station_code").orderBy("ts", "event_id")
add("w05_lags", lambda s, d: readings(s, d).select("event_id", F.lag("flood").over(by()).alias("was"), F.lag("ts").over(by()).alias("was_ts")),
    f"WITH {READINGS} SELECT event_id, lag(flood) OVER w AS was, lag(ts) OVER w AS was_ts FROM readings WINDOW w AS (PARTITION BY station_code ORDER BY ts, event_id)")
add("w11_lag_after_filter", lambda s, d: readings(s, d).where("flood IS NOT NULL").select("event_id", F.lag("flood", 12).over(by()).alias("before")),
    f"WITH {READINGS} SELECT event_id, lag(flood, 12) OVER (PARTITION BY station_code ORDER BY ts, event_id) AS before FROM readings WHERE flood IS NOT NULL")
add("w15_event_starts", lambda s, d: readings(s, d).where("flood >= 100").withColumn("was", F.lag("ts").over(by())).where(F.col("was").isNull() | (minutes_between("was", "ts") > 60)).select("station_code", "ts"),
    f"WITH {READINGS}, x AS (SELECT station_code, ts, lag(ts) OVER (PARTITION BY station_code ORDER BY ts, event_id) AS was FROM readings WHERE flood >= 100) SELECT station_code, ts FROM x WHERE was IS NULL OR date_diff('minute', was, ts) > 60")
add("w16_reverse_cumsum", lambda s, d: found(s, d).groupBy("tier_cm", "duration_minutes").agg(F.count("*").alias("n")).withColumn("at_least", F.sum("n").over(Window.partitionBy("tier_cm").orderBy("duration_minutes").rowsBetween(0, Window.unboundedFollowing))),
    f"WITH {EVENTS}, x AS (SELECT tier_cm, duration_minutes, count(*) AS n FROM found GROUP BY 1, 2) SELECT *, (sum(n) OVER (PARTITION BY tier_cm ORDER BY duration_minutes DESC))::BIGINT AS at_least FROM x")
add("w17_latest_per_group", lambda s, d: sampling.latest(readings(s, d), ["station_code"], [F.desc("ts"), F.desc("event_id")]),
    f"WITH {READINGS} SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY station_code ORDER BY ts DESC, event_id DESC) = 1")
add("w18_alert_episodes", lambda s, d: readings(s, d).where("flood >= 60").withColumn("was", F.lag("ts").over(by())).agg(F.count("*").alias("n_alerts"), (F.count_if(minutes_between("was", "ts") > 180) + F.countDistinct("station_code")).alias("n_episodes")),
    f"WITH {READINGS}, x AS (SELECT station_code, ts, lag(ts) OVER (PARTITION BY station_code ORDER BY ts, event_id) AS was FROM readings WHERE flood >= 60) SELECT count(*) AS n_alerts, count(*) FILTER (WHERE date_diff('minute', was, ts) > 180) + count(DISTINCT station_code) AS n_episodes FROM x")
_means = lambda s, d: readings(s, d).groupBy("station_code").agg(exact_mean("flood", 1).alias("mean_depth"))
add("w21_rank_ties", lambda s, d: _means(s, d).select("station_code", F.rank().over(Window.orderBy("mean_depth")).alias("rank_min"), F.floor(F.rank().over(Window.orderBy(F.desc("mean_depth"))) + (F.count("*").over(Window.partitionBy("mean_depth")) - 1) / 2).cast("int").alias("rank_avg")),
    f"""WITH {READINGS}, m AS (SELECT station_code, {exact_mean_sql('flood', 1)} AS mean_depth FROM readings GROUP BY 1)
    SELECT station_code, rank() OVER (ORDER BY mean_depth NULLS FIRST) AS rank_min, floor(rank() OVER (ORDER BY mean_depth DESC NULLS LAST) + (count(*) OVER (PARTITION BY mean_depth) - 1) / 2.0)::INT AS rank_avg FROM m""")  # fmt: skip
add("w10_order_check", lambda s, d: readings(s, d).groupBy("station_code").agg((F.count("*") - F.countDistinct("ts")).alias("n_repeated_ts")),
    f"WITH {READINGS} SELECT station_code, count(*) - count(DISTINCT ts) AS n_repeated_ts FROM readings GROUP BY 1")

# -- limits, samples, sets, reshapes ---------------------------------------
add("l01_top_k", lambda s, d: readings(s, d).where("flood IS NOT NULL").orderBy(F.desc("flood"), "event_id").limit(10).select("event_id", "flood"),
    f"WITH {READINGS} SELECT event_id, flood FROM readings WHERE flood IS NOT NULL ORDER BY flood DESC, event_id LIMIT 10")
add("l03_hash_sample", lambda s, d: sampling.first_by_hash(readings(s, d), ("event_id",), 100, 7).select("event_id"),
    f"WITH {READINGS} SELECT event_id FROM readings ORDER BY md5(event_id::VARCHAR || '|7'), event_id LIMIT 100")
add("l04_thinned_negatives", lambda s, d: sampling.thinned_negatives(readings(s, d), F.coalesce(F.col("flood") >= 100, F.lit(False)), ("event_id",), 0.05, 3).select("event_id"),
    f"WITH {READINGS} SELECT event_id FROM readings WHERE coalesce(flood >= 100, false) OR ('0x' || substr(md5(event_id::VARCHAR || '|3'), 1, 8))::BIGINT % 1000000 < 50000")
add("l06_union_all", lambda s, d: sampling.first_by_hash(readings(s, d), ("event_id",), 50, 1).unionByName(sampling.first_by_hash(readings(s, d).where("flood >= 100"), ("event_id",), 50, 1)).select("event_id"),
    f"WITH {READINGS} (SELECT event_id FROM readings ORDER BY md5(event_id::VARCHAR || '|1'), event_id LIMIT 50) UNION ALL (SELECT event_id FROM readings WHERE flood >= 100 ORDER BY md5(event_id::VARCHAR || '|1'), event_id LIMIT 50)")
add("l09_keep_last", lambda s, d: sampling.latest(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"),
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
add("l10_order_by_abs", lambda s, d: table(s, d, "customer").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(20).select("c_custkey", "c_acctbal"),
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
add("l11_pivot", lambda s, d: found(s, d).groupBy("station_code").pivot("tier_cm", [float(t) for t in TIERS]).agg(F.count(F.lit(1))).select("station_code", *(F.coalesce(f"`{float(t)}`", F.lit(0).cast("long")).alias(f"n_{t}") for t in TIERS)),
    f"WITH {EVENTS} SELECT station_code, " + ", ".join(f"count(*) FILTER (WHERE tier_cm = {t}) AS n_{t}" for t in TIERS) + " FROM found GROUP BY 1")
add("l12_complete_domain", lambda s, d: s.range(24).select(F.col("id").cast("int").alias("hour")).join(readings(s, d).where("flood >= 150").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0).cast("long")).alias("n")),
    f"WITH {READINGS} SELECT h::INT AS hour, count(event_id) AS n FROM range(24) t(h) LEFT JOIN readings ON hour(ts) = h AND flood >= 150 GROUP BY 1")
add("l13_argmax_and_mode", lambda s, d: readings(s, d).groupBy("station_code").agg(F.max_by("event_id", F.struct(F.coalesce("flood", F.lit(-1.0)), "event_id")).alias("deepest_id"), F.mode(F.hour("ts"), True).alias("usual_hour")),
    f"""WITH {READINGS} SELECT r.station_code, arg_max(event_id, (coalesce(flood, -1.0), event_id)) AS deepest_id,
    (SELECT hour(ts)::INT FROM readings q WHERE q.station_code = r.station_code GROUP BY hour(ts) ORDER BY count(*) DESC, hour(ts) LIMIT 1) AS usual_hour FROM readings r GROUP BY 1""")  # fmt: skip

# -- expressions and payloads ----------------------------------------------
BANDS = ((1, "trace"), (5, "damp"), (15, "shallow"), (30, "ankle"), (60, "knee"), (100, "deep"), (200, "very deep"))


def _band():
    out = F.when(F.col("flood").isNull(), "offline")
    for limit, name in BANDS:
        out = out.when(F.col("flood") < limit, name)
    return out.otherwise("extreme")


add("p13_depth_bands", lambda s, d: readings(s, d).groupBy(_band().alias("band")).agg(F.count("*").alias("n")),
    f"WITH {READINGS} SELECT CASE WHEN flood IS NULL THEN 'offline' " + " ".join(f"WHEN flood < {a} THEN '{n}'" for a, n in BANDS) + " ELSE 'extreme' END AS band, count(*) AS n FROM readings GROUP BY 1")
WORDS = ("license", "rights reserved", "the and")
add("p11_keywords", lambda s, d: table(s, d, "documents").select("doc_id", payloads.any_keyword(F.col("text"), WORDS).alias("hit")),
    "SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in WORDS) + " AS hit FROM documents")
add("p10_case_insensitive", lambda s, d: table(s, d, "customer").where(F.lower("c_mktsegment") == "building").groupBy("c_nationkey").agg(F.count("*").alias("n")),
    "SELECT c_nationkey, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY 1")
add("s22_json_fields", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).groupBy((F.col("k") % 10).alias("k10")).agg(F.count("*").alias("n"), F.sum("k").alias("total")),
    "SELECT (props->>'k')::BIGINT % 10 AS k10, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
add("p14_risk_cut", lambda s, d: hourly(s, d).select("district", "ts", F.when(F.col("fcst") / 200 <= 0, "none").when(F.col("fcst") / 200 <= 0.34, "low").when(F.col("fcst") / 200 <= 0.67, "moderate").when(F.col("fcst").isNotNull(), "high").alias("risk")),
    f"WITH {GRID}, {EXTERNAL} SELECT district, ts, CASE WHEN fcst / 200 <= 0 THEN 'none' WHEN fcst / 200 <= 0.34 THEN 'low' WHEN fcst / 200 <= 0.67 THEN 'moderate' WHEN fcst IS NOT NULL THEN 'high' END AS risk FROM hourly")
