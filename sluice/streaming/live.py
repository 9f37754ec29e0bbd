"""The poll store as streams: file source, watermark, windows, sessions, append-only sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """New files of the store as a stream of readings, event time as a timestamp for the watermark."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Process what is there and stop; the result is read back from the sink.

    Offsets and state live in the shared checkpoint folder, so a restarted
    query goes on where it stopped.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stored(stream: DataFrame, version: str, root: str | None = None) -> str:
    """Add what has come in to the poll store under ``dt=`` folders, stamped with the parser's version; returns the store.

    The same ``root`` again goes on after the files that were read before.
    """
    root = root or f"{shared_dir(stream.sparkSession)}/store-{uuid.uuid4().hex}"
    stamped = stream.withColumns({"_collector_version": F.lit(version), "dt": F.to_date("ts")})
    writer = stamped.writeStream.outputMode("append").partitionBy("dt").format("parquet").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/rows").start().awaitTermination()
    return f"{root}/rows"


class Feed:
    """A store that fills up slice by slice, and streams that are run over what has come in.

    Every ``run`` is a new start of the same query from its checkpoint: it
    reads the slices that came since, with the state that the last one left.
    """

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
        self.dropped = 0
        #: rows of state after each run
        self.state: list[int] = []

    def add(self, rows: DataFrame) -> None:
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.base}/in")

    def source(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.base}/in").withColumn("ts", F.col("ts").cast("timestamp"))

    def run(self, stream: DataFrame) -> None:
        """Append what the stream has to say by now; rows behind the watermark are counted as dropped."""
        writer = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{self.base}/checkpoint")
        query = writer.format("parquet").option("path", f"{self.base}/out").start()
        query.awaitTermination()
        steps = [op for progress in query.recentProgress for op in progress.stateOperators]
        self.dropped += sum(op.numRowsDroppedByWatermark for op in steps)
        if steps:
            self.state.append(steps[-1].numRowsTotal)

    def out(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/out")

    def closed(self, make: Callable[[DataFrame], DataFrame], last: str) -> DataFrame:
        """What is said once time has passed ``last``: empty readings of that time carry the watermark on."""
        empty = ", ".join(f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in self.schema.split(", ") if not f.startswith("ts "))
        for _ in range(2):  # a batch sees the watermark that the one before left
            self.add(self.spark.sql(f"SELECT TIMESTAMP_NTZ '{last}' AS ts, {empty}"))
            self.run(make(self.source()))
        return self.out()


def replayed(rows: DataFrame, schema: str, make: Callable[[DataFrame], DataFrame], arrival: Column, cuts: Sequence[str], last: str) -> DataFrame:
    """A table as a stream: its rows come in slices of their ``arrival`` time, cut at ``cuts``, and then nothing until ``last``."""
    feed = Feed(rows.sparkSession, schema)
    edges = [None, *(F.lit(c).cast("timestamp_ntz") for c in cuts), None]
    for low, high in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else arrival >= low
        feed.add(rows.where(inside if high is None else inside & (arrival < high)))
        feed.run(make(feed.source()))
    return feed.closed(make, last)


def tumbling(stream: DataFrame, minutes: int = 15, late: str = "24 hours") -> DataFrame:
    """Counts, means and maxima per type and tumbling window, once each: when the watermark passes the window's end.

    Readings more than ``late`` behind the newest one are dropped; a window
    that was put out leaves the state.
    """
    slot = F.window("ts", f"{minutes} minutes")
    agg = stream.withWatermark("ts", late).groupBy("event_type", slot).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value")
    )
    return agg.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "mean_value", "max_value")


def sliding(stream: DataFrame, hours: int = 3, step: int = 15, late: str = "24 hours") -> DataFrame:
    """Counts and maxima per type over the last ``hours``, every ``step`` minutes, each when the watermark passes its end."""
    slot = F.window("ts", f"{hours} hours", f"{step} minutes")
    agg = stream.withWatermark("ts", late).groupBy("event_type", slot).agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return agg.select("event_type", F.col("window.end").cast("timestamp_ntz").alias("ts"), "n", "max_value")


def deduplicated(spark: SparkSession, path: str, late: str = "24 hours") -> DataFrame:
    """Readings polled again within the watermark are dropped; the sink is append-only."""
    once = source(spark, path).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return _run(once, "append").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


def sessions(spark: SparkSession, path: str, tier: float, gap: int) -> DataFrame:
    """Online events: wet readings of a station at most ``gap`` minutes apart are one session."""
    wet = source(spark, path).where(F.col("value") >= tier).withWatermark("ts", "24 hours")
    agg = wet.groupBy("user_id", F.session_window("ts", f"{gap} minutes")).agg(
        F.min("ts").alias("started_at"), F.count("*").alias("n_readings"), F.max("value").alias("peak")
    )
    return _run(agg, "complete").select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "n_readings", "peak")


def is_due(last_poll: str | None, now: str, cadence_minutes: float, tolerance: float = 0.8) -> bool:
    """Whether a source is due: the cadence, short of a tolerance, has passed since the last poll."""
    from datetime import datetime

    if last_poll is None:
        return True
    return (datetime.fromisoformat(now) - datetime.fromisoformat(last_poll)).total_seconds() >= tolerance * cadence_minutes * 60
