"""Raw sensor files: declared schemas, range checks, cleaned Parquet with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import constants as C
from sluice.operators.quality import flag_counts, range_checked
from sluice.session import shared_dir, written

VERSION = "1"


def schema(dataset: str) -> T.StructType:
    """Declared, not inferred: an all-null column must stay a number."""
    names = [T.StructField(f"{dataset}_code", T.StringType()), T.StructField(f"{dataset}_name", T.StringType()), T.StructField("site_timestamp", T.TimestampNTZType())]
    return T.StructType(names + [T.StructField(c, T.DoubleType()) for c in C.VALUES[dataset]])


def read_raw(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """CSV with a header, quoted commas and the NULL token; columns go by position, so a byte-order mark does no harm."""
    return spark.read.schema(schema(dataset)).options(header=True, nullValue="NULL", quote='"', enforceSchema=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def cleaned(raw: DataFrame, dataset: str) -> DataFrame:
    renamed = raw.withColumnsRenamed({f"{dataset}_code": "station_code", f"{dataset}_name": "station_name", "site_timestamp": "ts"})
    return range_checked(renamed, C.RANGES[dataset])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def raw_file(spark: SparkSession, root: str, patterns: tuple[str, ...], dataset: str, year: int) -> str:
    """The first pattern below ``root``, with the dataset and the year filled in, that any file matches; none is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for pattern in patterns:
        path = hadoop.Path(f"{root}/{pattern.format(dataset=dataset, year=year)}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return path.toString()
    raise FileNotFoundError(f"no raw file of {dataset} {year} below {root}")


def manifest(spark: SparkSession, path: str, dataset: str, year: int) -> dict:
    """What ``ingest`` noted of a dataset-year: rows, version, values out of range."""
    return json.loads(spark.read.text(f"{path}-interim/{dataset}-{year}.manifest").first()["value"])


def ingest(source: tuple[SparkSession, str], dataset: str, year: int, overwrite: bool = False) -> DataFrame:
    """Clean one dataset-year into ZSTD Parquet beside a JSON manifest, unless both are there already."""
    spark, path = source
    target, noted = f"{path}-interim/{dataset}/year={year}", f"{path}-interim/{dataset}-{year}.manifest"
    if overwrite or not (exists(spark, target) and exists(spark, noted)):
        noted_rows = Observation()
        raw = read_raw(spark, path, dataset).withColumn("site_timestamp", _of_year(F.col("site_timestamp"), year))
        # counts come with the one reading that writes
        watched = raw.observe(noted_rows, F.count("*").alias("rows"), *flag_counts(C.RANGES[dataset]))
        cleaned(watched, dataset).write.mode("overwrite").option("compression", "zstd").parquet(target)
        spark.createDataFrame([(json.dumps({**noted_rows.get, "version": VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(noted)
    return spark.read.schema(cleaned(spark.createDataFrame([], schema(dataset)), dataset).schema).parquet(target)


def _of_year(ts: Column, year: int) -> Column:
    """``ts``, or an error where it lies outside ``year``: such a file has another year's rows."""
    said = F.concat(F.lit(f"a row of another year than {year}: "), ts.cast("string"))
    return F.when(ts.isNull() | (F.year(ts) == year), ts).otherwise(F.raise_error(said).cast("timestamp_ntz"))


def interim(spark: SparkSession, root: str, dataset: str, years: list[int]) -> DataFrame:
    """Several years as one table; a missing year is an error, not a smaller table."""
    paths = [f"{root}/{dataset}/year={y}" for y in years]
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"not ingested: {', '.join(missing[:3])}")
    return spark.read.parquet(*paths)


def write_csv_fixture(readings: DataFrame, dataset: str, ordered: str | None = None) -> tuple[SparkSession, str]:
    """Raw files of the given readings in the shared folder, for tests and queries; in the order of a column if one is named."""
    spark = readings.sparkSession
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    readings = readings.orderBy(ordered) if ordered else readings
    rows = readings.select("station_code", F.col("station_code").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), *C.VALUES[dataset])
    rows.write.options(header=True, nullValue="NULL").csv(path)
    return spark, path


def in_file_order(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(before, now)`` for rows as they stand in their files: structs of ``columns`` of neighbours, null before the first.

    ``rows`` come straight from a file source.  A split of a file is read
    from its start to its end in one task, so its rows have an order; the
    last row of a split then meets the first of the next one, by the name
    of the file and the place of the split.  No task sees more than a split
    or a row per split of a file.
    """
    now = F.struct(*columns)
    placed = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), now.alias("now"), F.monotonically_increasing_id().alias("nth"))
    placed = written(placed, "ordered")  # places are what this one reading found
    split = Window.partitionBy("path", "start").orderBy("nth")
    inside = placed.withColumn("before", F.lag("now").over(split)).withColumn("first", F.row_number().over(split) == 1)
    ends = placed.groupBy("path", "start").agg(F.max_by("now", "nth").alias("last"))
    # splits of one file, then the last of a file meets the first of the next file: a row per split, a row per file
    in_path = Window.partitionBy("path").orderBy("start")
    linked = ends.withColumns({"from_same": F.lag("last").over(in_path), "nth": F.row_number().over(in_path)})
    files = ends.groupBy("path").agg(F.max_by("last", "start").alias("last"))
    over = files.withColumn("carried", F.lag("last").over(Window.orderBy("path"))).select("path", "carried")
    linked = linked.join(over, "path").select("path", "start", F.when(F.col("nth") > 1, F.col("from_same")).otherwise(F.col("carried")).alias("carried"))
    met = inside.join(F.broadcast(linked), ["path", "start"])  # a row per split
    return met.select(F.when(F.col("first"), F.col("carried")).otherwise(F.col("before")).alias("before"), "now")


def order_check(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """How many rows there are, how many lie before the row above them in the file, and how many repeat its time."""
    pairs = in_file_order(rows, (ts,))
    return pairs.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(f"now.{ts}") < F.col(f"before.{ts}")).alias("n_inversions"), F.count_if(F.col(f"now.{ts}") == F.col(f"before.{ts}")).alias("n_repeats")
    )
