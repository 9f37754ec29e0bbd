"""Reports that come in pages, as a Spark source: batch and stream, until a page brings nothing new."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sluice.session import written

Fetch = Callable[[int], str | None]


def stored(root: str) -> Fetch:
    """Pages kept below ``root`` as ``page=<number>/`` folders of one JSON text each; None where there is none."""
    files, base = pyarrow.fs.FileSystem.from_uri(root)

    def fetch(page: int) -> str | None:
        found = files.get_file_info(pyarrow.fs.FileSelector(f"{base}/page={page}", allow_not_found=True))
        texts = [files.open_input_stream(f.path).read().decode() for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.startswith("part-")]
        return "".join(texts) or None

    return fetch


#: Pages of a folder of ``blocks``.
BLOCK = 64


def blocks(root: str) -> Fetch:
    """Pages kept below ``root`` as ``block=<number // BLOCK>/`` folders with a line a page: its number, a tab, its JSON text.

    The block that was read last is kept, so pages in order cost a file a block.
    """
    files, base = pyarrow.fs.FileSystem.from_uri(root)
    last: tuple[int, dict[int, str]] = (-1, {})

    def fetch(page: int) -> str | None:
        nonlocal last
        if last[0] != page // BLOCK:
            found = files.get_file_info(pyarrow.fs.FileSelector(f"{base}/block={page // BLOCK}", allow_not_found=True))
            parts = [f.path for f in found if f.is_file and f.base_name.startswith("part-")]
            lines = [x.split("\t", 1) for p in parts for x in files.open_input_stream(p).read().decode().split("\n") if x]
            last = page // BLOCK, {int(n): text for n, text in lines}
        return last[1].get(page)

    return fetch


def _fetcher(options: dict) -> Fetch:
    """The fetcher that the option ``fetch`` names as ``module:function``, made for ``root``; stored pages by default."""
    module, _, name = options.get("fetch", f"{__name__}:stored").partition(":")
    return getattr(importlib.import_module(module), name)(options["root"])


def _features(fetch: Fetch, page: int) -> list:
    text = fetch(page)
    return (json.loads(text).get("features") or []) if text else []


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _rows(options: dict, part: _Pages) -> Iterator[tuple]:
    fetch = _fetcher(options)
    for page in range(part.first, part.last):
        features = _features(fetch, page)
        if not features:  # an empty page is the end for this task too
            return
        for k, f in enumerate(features):
            yield page, k, json.dumps(f)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Pages]:
        most, size = int(self.options.get("maxpages", 1000)), int(self.options.get("pagesperpartition", 20))
        fetch = _fetcher(self.options)
        # the last page there is: by doubling, then by halving; a page missing in between shows later
        low, high = 0, 1
        while high < most and _features(fetch, high - 1):
            low, high = high, high * 2
        high = min(high, most)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if _features(fetch, mid) else (low, mid)
        return [_Pages(k, min(k + size, low)) for k in range(0, low, size)] or [_Pages(0, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return _rows(self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """A batch takes the pages that have come since, ``pagesPerBatch`` at most; an empty page ends it for now."""

    def __init__(self, options: dict):
        self.options = options
        self.reached = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        fetch = _fetcher(self.options)
        end = self.reached + int(self.options.get("pagesperbatch", 10))
        while self.reached < end and _features(fetch, self.reached):
            self.reached += 1
        return {"page": self.reached}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        self.reached = max(self.reached, end["page"])
        return [_Pages(k, k + 1) for k in range(start["page"], end["page"])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, end["page"])


class PagedReports(DataSource):
    """``format("paged_reports")``: ``(page, k, feature)`` of every report on every page there is.

    Options: ``root``, ``fetch`` (``module:function``), ``maxPages``,
    ``pagesPerPartition``, ``pagesPerBatch``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_reports"

    def schema(self) -> str:
        return "page int, k int, feature string"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


FEATURE = "geometry struct<coordinates:array<double>>, properties struct<ticket_id:string,timestamp:string,district:string,province:string,description:string,state:string>"


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(PagedReports)
    return spark.read.format("paged_reports").options(root=root, **options).load()


def until_nothing_new(pages: DataFrame) -> DataFrame:
    """The reports up to the first page that brings none that an earlier page hadn't, or is missing: the first of each ticket.

    A source that has no more to say may go on serving what it said before;
    reading page by page would stop there, so what lies beyond doesn't count.
    """
    r = pages.select("page", "k", F.from_json("feature", FEATURE).alias("f"))
    p = F.col("f.properties")
    # written, so that each page is fetched once
    flat = r.select(
        "page", "k", p["ticket_id"].alias("ticket_id"), F.try_to_timestamp(p["timestamp"], F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("lon"), F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("lat"),
        p["district"].alias("district"), p["description"].alias("description"), p["state"].alias("state"),
    )
    flat = written(flat, "reports")
    first = flat.withColumn("n", F.row_number().over(Window.partitionBy("ticket_id").orderBy("page", "k"))).where("n = 1").drop("n")
    # pages without a first report, and pages that aren't there; the least of them ends the reading
    there = flat.select("page").distinct()
    stale = there.join(first.select("page").distinct(), "page", "left_anti")
    missing = there.select((F.col("page") + 1).alias("page")).join(there, "page", "left_anti")
    end = stale.unionByName(missing).agg(F.min("page").alias("end"))
    return first.crossJoin(F.broadcast(end)).where(F.col("page") < F.col("end")).drop("end", "k")  # one row
