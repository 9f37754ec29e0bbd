"""The test tables in the shape of a sensor network, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from sluice.functions.timeutil import floor_minutes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of 20 stations; an error event is a reading without a value."""
    code = F.concat(F.lit("FL."), F.upper(F.substring("event_type", 1, 3)), F.lit("."), F.lpad((F.col("user_id") % 4).cast("string"), 2, "0"))
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select(code.alias("station_code"), "ts", value.alias("flood"), "event_id")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings on the five-minute grid, the deepest of a slot."""
    return readings(spark, sf_dir).groupBy("station_code", floor_minutes("ts", 5).alias("ts")).agg(F.max("flood").alias("flood"))


READINGS = """readings AS (
    SELECT 'FL.' || upper(substr(event_type, 1, 3)) || '.' || lpad((user_id % 4)::VARCHAR, 2, '0') AS station_code, ts,
           CASE WHEN event_type <> 'error' THEN value END AS flood, event_id FROM events)"""
GRID = READINGS + """, grid AS (
    SELECT station_code, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, max(flood) AS flood FROM readings GROUP BY ALL)"""


def exact_mean(c: str, digits: int, over: WindowSpec | None = None) -> Column:
    """The mean of numbers of six decimals to ``digits``, in whole numbers: no order of summing moves a tie."""
    total, n = F.sum(F.round(F.col(c) * 1_000_000).cast("long")), F.count(c)
    total, n = (total.over(over), n.over(over)) if over else (total, n)
    unit = F.lit(10 ** (6 - digits)).cast("long")
    half = 2 * F.abs(total) + unit * n
    return F.try_divide(half - F.pmod(half, F.nullif(2 * unit * n, F.lit(0))), 2 * unit * n) * F.signum(total) / 10**digits


def exact_mean_sql(c: str, digits: int, over: str = "") -> str:
    total, n = f"sum(round({c} * 1000000)::BIGINT) {over}", f"count({c}) {over}"
    unit = 10 ** (6 - digits)
    return f"((2 * abs({total}) + {unit} * {n}) // nullif({2 * unit} * {n}, 0))::DOUBLE * sign({total}) / {10**digits}"
