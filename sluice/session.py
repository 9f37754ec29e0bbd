"""Session set-up and shared storage for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def connect(app: str = "sluice", master: str | None = None, memory: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE, Arrow.

    ``memory`` bounds the driver; on a cluster leave it and ``master`` to
    spark-submit.  Anything in ``conf`` wins over the defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (a single
    machine, as in tests) is a temporary folder made and registered; a
    cluster without the setting is an error, since its machines would not
    see each other's files.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="sluice-checkpoint-")
    spark.sparkContext.setCheckpointDir("file://" + os.path.abspath(made))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet on shared storage, read back: its plan ends here, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def state_in_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams on disk, as arbitrary stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
