"""Baseline scorers: persistence, a rain rule, climatology with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def persistence(df: DataFrame, depth: str) -> DataFrame:
    """The present depth is the score; unknown depth is no prediction."""
    return df.withColumn("score", F.col(depth))


def rain_rule(df: DataFrame, rain: str) -> DataFrame:
    return df.withColumn("score", F.col(rain))


def always_negative(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(0.0))


def climatology(train: DataFrame, label: str, min_rows: int) -> DataFrame:
    """Positive rate by station, hour and month; below ``min_rows`` the station's rate."""
    known = train.where(F.col(label).isNotNull()).select("station_code", F.hour("ts").alias("hour"), F.month("ts").alias("month"), F.col(label).cast("double").alias("y"))
    cell = known.groupBy("station_code", "hour", "month").agg(F.count("*").alias("n"), F.avg("y").alias("cell_rate"))
    station = known.groupBy("station_code").agg(F.avg("y").alias("station_rate"))
    rate = F.when(F.col("n") >= min_rows, F.col("cell_rate")).otherwise(F.col("station_rate"))
    return cell.join(station, "station_code", "left").select("station_code", "hour", "month", "n", F.round(rate, 6).alias("rate"))


def apply_climatology(df: DataFrame, table: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """The cell's rate, or the overall rate where the cell was never seen."""
    overall = train.where(F.col(label).isNotNull()).agg(F.round(F.avg(F.col(label).cast("double")), 6).alias("overall"))
    keyed = df.withColumns({"hour": F.hour("ts"), "month": F.month("ts")})
    joined = keyed.join(table.drop("n"), ["station_code", "hour", "month"], "left").crossJoin(F.broadcast(overall))
    return joined.withColumn("score", F.coalesce("rate", "overall")).drop("hour", "month", "rate", "overall")
