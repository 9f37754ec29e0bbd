"""Files, pages and tables as they are written and read back."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import evaluation, features
from sluice.sources import pages, raw

T0 = datetime(2024, 5, 1)


def test_file_order_across_splits_and_files(spark, tmp_path):
    """Rows of an unsorted CSV in several splits meet their neighbours in the file."""
    stamps = [T0 + timedelta(minutes=(k * 7919) % 1000) for k in range(400)]
    lines = [f"S{k},x,{t:%Y-%m-%d %H:%M:%S},1.5" for k, t in enumerate(stamps)]
    for name, part in (("a.csv", lines[:300]), ("b.csv", lines[300:])):
        (tmp_path / name).write_text("\n".join(["flood_code,flood_name,site_timestamp,flood", *part]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = raw.read_raw(spark, str(tmp_path), "flood")
        assert rows.rdd.getNumPartitions() >= 4
        pairs = raw.in_file_order(rows, ("flood_code",)).collect()
        checked = raw.order_check(rows, "site_timestamp").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.now.flood_code: r.before and r.before.flood_code for r in pairs} == {f"S{k}": f"S{k - 1}" if k else None for k in range(400)}
    assert checked.n_rows == 400
    assert checked.n_inversions == sum(b < a for a, b in zip(stamps, stamps[1:], strict=False))


def test_a_row_of_another_year_stops_the_ingest(spark, tmp_path):
    head = "flood_code,flood_name,site_timestamp,flood\n"
    path = tmp_path / "flood.csv"
    path.write_text(head + "A,a,2024-01-01 00:05:00,300\nA,a,2023-12-31 23:55:00,1\n")
    with pytest.raises(Exception, match="another year than 2024"):
        raw.ingest((spark, str(path)), "flood", 2024)
    path.write_text(head + "A,a,2024-01-01 00:05:00,300\nA,a,,NULL\n")
    got = raw.ingest((spark, str(path)), "flood", 2024, overwrite=True).collect()
    assert sorted((r.ts is None, r.flood) for r in got) == [(False, None), (True, None)]
    assert raw.manifest(spark, str(path), "flood", 2024) == {"rows": 2, "flagged_flood": 1, "version": raw.VERSION}


def test_a_year_of_the_feature_table_is_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = lambda year, x: spark.createDataFrame([(f"S{k}", datetime(year, 3, 1, k), x + k / 3, True) for k in range(6)], "station_code string, ts timestamp_ntz, fl_max_3h double, y_valid_3h boolean")
    features.write_feature_table(rows(2023, 0.0).unionByName(rows(2024, 10.0)), path)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "features" / "year=2023").iterdir()}
    features.write_feature_table(rows(2024, 100.0), path)
    assert {str(f): f.stat().st_mtime_ns for f in (tmp_path / "features" / "year=2023").iterdir()} == before
    table = features.read_feature_table(spark, path)
    assert dict(table.dtypes)["fl_max_3h"] == "float"
    assert table.groupBy("year").agg(F.count("*"), F.min("fl_max_3h")).orderBy("year").collect() == [(2023, 6, 0.0), (2024, 6, 100.0)]
    one = table.where("year = 2023")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert all("year=2023" in r[0] for r in one.select(F.input_file_name()).collect())
    columns = ("fl_max_3h",)
    with pytest.raises(ValueError, match="no column"):
        evaluation.load_features(table, (2023,), columns, 100, 3)


def put(root, number, tickets):
    folder = root / f"page={number}"
    folder.mkdir(parents=True)
    feature = lambda t: {"geometry": {"coordinates": [100.5, 13.7]}, "properties": {"ticket_id": t, "timestamp": "2024-05-01 10:00:00", "district": "d"}}
    (folder / "part-0.txt").write_text(json.dumps({"features": [feature(t) for t in tickets]}))


def test_pages_end_where_nothing_is_new(spark, tmp_path):
    for number, tickets in enumerate((["a", "b"], ["b", "c"], ["d", "d", "a"], ["a", "b"], ["e"])):
        put(tmp_path, number, tickets)
    root = f"file://{tmp_path}"
    read = pages.read(spark, root, pagesPerPartition=2)
    assert read.rdd.getNumPartitions() == 3
    assert read.count() == 10
    got = pages.until_nothing_new(read).collect()
    assert sorted((r.ticket_id, r.page) for r in got) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]
    assert {(r.lon, r.lat, r.ts) for r in got} == {(100.5, 13.7, datetime(2024, 5, 1, 10))}
    assert pages.read(spark, f"file://{tmp_path}/none").count() == 0
    for number in (0, 1, 3):
        put(tmp_path / "gap", number, [f"t{number}"])
    assert sorted(r.ticket_id for r in pages.until_nothing_new(pages.read(spark, f"{root}/gap")).collect()) == ["t0", "t1"]
    assert pages.until_nothing_new(pages.read(spark, root, maxPages=2)).count() == 3


def test_pages_as_a_stream_go_on_where_they_were(spark, tmp_path):
    root = tmp_path / "in"
    for number, tickets in enumerate((["a"], ["b"], ["c"])):
        put(root, number, tickets)
    spark.dataSource.register(pages.PagedReports)

    def run():
        stream = spark.readStream.format("paged_reports").options(root=f"file://{root}", pagesPerBatch=2).load()
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query = writer.start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.page for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [0, 1, 2]
    put(root, 3, ["d"])
    assert run() == [0, 1, 2, 3]


def test_a_forecast_that_is_the_measurement_stops_its_reader(spark):
    hours = [(y, datetime(y, 6, 1) + timedelta(hours=h), float(h % 5)) for y in (2021, 2022, 2023) for h in range(200)]
    forecast = spark.createDataFrame([("d", t, v if y < 2023 else None) for y, t, v in hours], "district string, ts timestamp_ntz, fcst double")
    seen = spark.createDataFrame([("d", t, v if y == 2021 else v + 1) for y, t, v in hours], "district string, ts timestamp_ntz, seen double")
    report = evaluation.forecast_report(forecast, seen)
    assert {r.year: r.status for r in report.collect()} == {2021: "reanalysis", 2022: "usable", 2023: "empty"}
    assert evaluation.guarded(forecast.where("year(ts) = 2022"), report).count() == 200
    with pytest.raises(Exception, match="no forecast for 2021: reanalysis"):
        evaluation.guarded(forecast, report).where("year(ts) <= 2022").agg(F.sum("fcst")).collect()


def test_pages_in_blocks_are_fetched_once(spark, tmp_path):
    lines = {}
    for number, tickets in enumerate(([f"t{n}"] for n in range(pages.BLOCK + 3))):
        put(tmp_path / "single", number, tickets)
        text = "".join(p.read_text() for p in sorted((tmp_path / "single" / f"page={number}").glob("part-*")))
        lines.setdefault(number // pages.BLOCK, []).append(f"{number}\t{text.strip()}")
    for block, rows in lines.items():
        (tmp_path / f"many/block={block}").mkdir(parents=True)
        (tmp_path / f"many/block={block}/part-0").write_text("\n".join(rows) + "\n")
    read = pages.read(spark, f"file://{tmp_path}/many", fetch="sluice.sources.pages:blocks", pagesPerPartition=pages.BLOCK)
    assert read.rdd.getNumPartitions() == 2
    got = pages.until_nothing_new(read)
    for part in (tmp_path / "many").glob("*/part-0"):
        part.unlink()
    assert sorted((r.ticket_id, r.page) for r in got.collect()) == sorted((f"t{n}", n) for n in range(pages.BLOCK + 3))
    fetch = pages.blocks(f"file://{tmp_path}/none")
    assert fetch(0) is None and fetch(200) is None
