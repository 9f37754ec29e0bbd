"""Append-only poll store, registry helpers, merging of sources by preference."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import shared_dir


def append_poll(root: str | None, rows: DataFrame, version: str) -> str:
    """Add a poll's rows under ``dt=`` folders, stamped with the parser's version; nothing is overwritten."""
    root = root or f"{shared_dir(rows.sparkSession)}/polls-{uuid.uuid4().hex}"
    stamped = rows.withColumns({"_collector_version": F.lit(version), "dt": F.to_date("ts")})
    stamped.write.mode("append").partitionBy("dt").parquet(root)
    return root


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """All polls; columns may have changed over time."""
    return spark.read.option("mergeSchema", True).parquet(root)


def is_stale(history: DataFrame, version: str, needed: set[str]) -> bool:
    """Whether any row was parsed by another version, or a column is missing: then all is parsed again."""
    return bool(needed - set(history.columns)) or not history.where(F.col("_collector_version") != version).isEmpty()


def write_raw(payloads: DataFrame, root: str | None = None) -> str:
    """Keep ``(fetched_at, body)`` as they came, a compressed text file a payload in ``dt=`` folders named by the time.

    Times are told apart by the second; a payload's body is one line.
    """
    root = root or f"{shared_dir(payloads.sparkSession)}/raw-{uuid.uuid4().hex}"
    stamped = payloads.select(F.to_date("fetched_at").alias("dt"), F.date_format("fetched_at", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), F.col("body").alias("value"))
    stamped.write.mode("append").partitionBy("dt", "stamp").option("compression", "gzip").text(root)
    return root


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """``(fetched_at, body)`` of every stored payload, the time read off its path; paths without one are passed over."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.input_file_name().alias("path"))
    stamp = F.regexp_extract("path", r"(\d{8}T\d{6}Z)", 1)
    timed = lines.select(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz").alias("fetched_at"), F.col("value").alias("body"))
    return timed.where("fetched_at IS NOT NULL")


def reparse(raw: DataFrame, parse: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """All payloads through today's parser; nothing stored is rewritten."""
    return parse(raw).withColumn("_collector_version", F.lit(version))


def history(stored: DataFrame, raw: DataFrame, parse: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """The stored rows, or all of them parsed again if any is of another version or a column is missing.

    Times of one column may mean another zone under another version, which
    no comparison of columns shows; so it is all or nothing.
    """
    again = reparse(raw, parse, version)
    return again if "_collector_version" not in stored.columns or is_stale(stored, version, set(again.columns)) else stored


def kept_days(rows: DataFrame, now: str, days: int = 90) -> DataFrame:
    """The rolling window of a store: rows of the last ``days`` days, by folder and then by time."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    out = rows.where(F.col("dt") >= F.to_date(since)) if "dt" in rows.columns else rows
    return out.where((F.col("ts") > since) & (F.col("ts") <= F.lit(now).cast("timestamp_ntz")))


def preferred(frames: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Rows of several sources with a value; for a key the last source wins."""
    ranked = [f.where(F.col(value).isNotNull()).withColumn("__source", F.lit(k)) for k, f in enumerate(frames)]
    both = ranked[0]
    for f in ranked[1:]:
        both = both.unionByName(f)
    w = Window.partitionBy(*keys).orderBy(F.desc("__source"))
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__source")


def first_per_prefix(registry: DataFrame, order: str) -> DataFrame:
    """One district per prefix, the first in registry order: the map is never inverted."""
    w = Window.partitionBy("prefix").orderBy(order)
    return registry.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def coordinate_quality(registry: DataFrame) -> DataFrame:
    """How a station's coordinates came about; the order of the cases matters."""
    quality = (
        F.when(F.col("lat").isNull(), "none").when(F.col("is_district_centroid"), "district_centroid")
        .when(F.col("is_subdistrict_centroid"), "subdistrict_centroid").otherwise("inferred_other")
    )
    return registry.withColumn("coord_quality", quality)


def vertex_mean(features: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """Unweighted mean of a ring's vertices (``array<array<double>>`` of [lon, lat]), to five places."""
    v = features.select("district", F.explode(coordinates).alias("v"))
    return v.groupBy("district").agg(F.round(F.avg(F.col("v")[1]), 5).alias("lat"), F.round(F.avg(F.col("v")[0]), 5).alias("lon"))
