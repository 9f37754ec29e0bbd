"""Worked examples with answers known by construction."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions.timeutil import interval
from sluice.operators import evaluation, events, features, labels, live, metrics
from sluice.plans import models
from sluice.sources import payloads, raw, stores
from sluice.streaming.live import is_due

T0 = datetime(2024, 5, 1, 12)


def frame(spark, values, step=5, station="FL.AAA.01"):
    rows = [(station, T0 + timedelta(minutes=step * k), v) for k, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "station_code string, ts timestamp_ntz, flood double")


def test_a_hole_breaks_a_run_and_a_single_reading_is_dropped(spark):
    r = frame(spark, [20.0, 20.0, "gap", 20.0, 1.0, None, 20.0, 30.0])
    runs = sorted((x.n_readings, x.peak_depth_cm) for x in events.excursions(r, (15,)).collect())
    assert runs == [(1, 20.0), (2, 20.0), (2, 30.0)]
    found = events.detect(r, (15,)).collect()
    assert [(e.n_readings, e.n_excursions_merged, e.duration_minutes) for e in found] == [(4, 2, 40)]


@pytest.mark.parametrize(("gap", "n"), [(60, 1), (65, 2)])
def test_a_gap_of_exactly_the_limit_merges(spark, gap, n):
    r = frame(spark, [20.0, 20.0, *[0.0] * (gap // 5 - 1), 20.0, 20.0])
    assert events.detect(r, (15,)).count() == n


def test_runs_against_a_plain_loop(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, 20.0, 20.0, None, "gap", 15.0]) for _ in range(400)]
    want, size, last = [], 0, None
    for k, v in enumerate(values):
        if v == "gap" or v is None:
            continue
        if v >= 15 and size and last == k - 1:
            size += 1
        elif v >= 15:
            want += [size] if size else []
            size = 1
        else:
            want += [size] if size else []
            size = 0
        last = k
    want += [size] if size else []
    got = [r.n_readings for r in events.excursions(frame(spark, values), (15,)).orderBy("started_at").collect()]
    assert got == want


def test_labels_ignore_the_present_and_features_ignore_the_future(spark):
    values = [float(k % 7) for k in range(120)]
    changed = list(values)
    changed[60] = 99.0
    for f, keep in ((labels.labels, lambda t: t == T0 + timedelta(minutes=300)), (features.depth_features, lambda t: t < T0 + timedelta(minutes=300))):
        a, b = ({r.ts: r.asDict() for r in f(frame(spark, v)).collect()} for v in (values, changed))
        for t in a:
            if keep(t):
                drop = {"flood", *(k for k in a[t] if k.startswith("is_onset"))}
                assert {k: v for k, v in a[t].items() if k not in drop} == {k: v for k, v in b[t].items() if k not in drop}


def test_confusion_and_average_precision(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (0, 1), (0, 0)], "y int, pred int")
    m = metrics.binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 1) and abs(m.f1 - 2 / 3) < 1e-5
    ap = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, score double")
    assert metrics.average_precision(ap).first()[0] == 1.0
    best = metrics.best_threshold(ap).first()
    assert best.f2 == 1.0 and 0.2 < best.threshold <= 0.8


def test_zero_inflated_scores_still_find_a_threshold(spark):
    rng = np.random.default_rng(0)
    scores = np.concatenate([rng.uniform(0.6, 3, 150), rng.uniform(0.05, 0.4, 150), np.zeros(19_700)])
    rows = [(int(k < 150), float(s)) for k, s in enumerate(scores)]
    assert 0.4 < metrics.best_threshold(spark.createDataFrame(rows, "y int, score double")).first().threshold < 0.8


@pytest.mark.parametrize(("minutes", "hit", "lead"), [((-45,), True, 45.0), ((15,), False, None), ((-240,), False, None), ((0,), False, None)])
def test_event_hits(spark, minutes, hit, lead):
    rows = [("s", T0 + timedelta(minutes=m), 20.0 if 0 <= m < 60 else 0.0, int(m in minutes)) for m in range(-300, 300, 15)]
    df = spark.createDataFrame(rows, "station_code string, ts timestamp_ntz, depth double, pred int")
    (r,) = metrics.event_hits(df, "depth", "pred", 15, 1).collect()
    assert (r.hit, r.lead_minutes) == (hit, lead)


def test_coverage_looks_at_wet_rows(spark):
    rows = [(0.0, 0.0, 0.0)] * 990 + [(20.0, 0.0, 0.0)] * 10
    c = metrics.coverage(spark.createDataFrame(rows, "t double, lo double, hi double"), "t", "lo", "hi").first()
    assert c.coverage_all > 0.98 and c.coverage_wet == 0 and not c.passes


def test_forward_rain_needs_the_last_stamp(spark):
    rows = [("d", T0 + timedelta(hours=k), 1.0) for k in range(5)]
    got = features.forward_rain(spark.createDataFrame(rows, "district string, ts timestamp_ntz, r double"), "r", (3,)).orderBy("ts").collect()
    assert [r.r_3h for r in got] == [3.0, 3.0, None, None, None] and [r.r_past_3h for r in got] == [1, 2, 3, 3, 3]
    assert interval(3, micros=-1) == "INTERVAL '0 02:59:59.999999' DAY TO SECOND"


def test_payloads(spark):
    now = T0
    body = '{"hourly":{"time":["2024-05-01T11:00","2024-05-01T13:00","bad"],"precipitation":[1.0,null,2.0]}}'
    got = payloads.forecast_rows(spark.createDataFrame([(body, now)], "body string, fetched_at timestamp_ntz")).collect()
    assert [(r.is_forecast, r.lead_hours) for r in got] == [(False, -1.0), (True, 1.0), (None, None)]
    report = lambda i, lon, lat: f'{{"geometry":{{"coordinates":[{lon},{lat}]}},"properties":{{"ticket_id":"{i}","comment":"Street FLOOD","type":null}}}}'
    body = '{"features":[' + ",".join([report(1, 100.5, 13.7), report(1, 100.5, 13.7), report(2, 99.0, 13.7)]) + "]}"
    (r,) = payloads.report_rows(spark.createDataFrame([(body,)], "body string"), ("flood",), {"lat": (13.4, 14.1), "lon": (100.2, 100.95)}).collect()
    assert (r.ticket_id, r.lat, r.is_flood) == ("1", 13.7, True)
    body = '[{"code":"PH.DDG.06","status":"online","level":"1.5","phone":"x","pumps":[{"name":"a","running":true},{"name":"b","running":false}]},{"code":"dds-2","status":"offline","level":"0","pumps":[]}]'
    got = {r.code: r for r in payloads.pump_rows(spark.createDataFrame([(body,)], "body string")).collect()}
    assert (got["PH.DDG.06"].prefix, got["PH.DDG.06"].level_m, got["PH.DDG.06"].running) == ("DDG", 1.5, "a")
    assert got["dds-2"].prefix is None and got["dds-2"].level_m is None and "phone" not in got["dds-2"]
    odd = payloads.aliased(spark.createDataFrame([("x", 1)], "`station.code` string, extra int"), {"code": ("code",), "level": ("level", "wl")}, "2")
    assert odd.columns == ["code", "level", "raw_extra", "_collector_version"] and odd.first().level is None


def test_missing_year_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        raw.interim(spark, "/tmp/no-such-interim", "flood", [2024])
    assert is_due(None, "2024-01-01T00:00:00", 60) and not is_due("2024-01-01T00:00:00", "2024-01-01T00:40:00", 60)


def test_a_fold_trains_tunes_and_reports(spark):
    rng = np.random.default_rng(1)
    rows = [("s", T0 + timedelta(minutes=5 * k), float(x) if k % 9 else None, bool(x > 1)) for k, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "station_code string, ts timestamp_ntz, a double, y_x boolean")
    _, threshold, report = models.run_fold(df, df, df, ["a"], "y_x", 0.5, iterations=3, depth=2)
    r = report.first()
    assert 0 < threshold < 1 and r.recall > 0.7
    cal = models.isotonic(spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.15), (1, 0.9)], "y int, prob double")).orderBy("prob").collect()
    assert [c.calibrated for c in cal] == sorted(c.calibrated for c in cal)


def test_years_are_kept_apart(spark):
    start = datetime(2023, 12, 31, 22)
    rows = [("FL.AAA.01", start + timedelta(minutes=15 * k), float(k)) for k in range(16)]
    r = spark.createDataFrame(rows, "station_code string, ts timestamp_ntz, flood double")
    first = datetime(2024, 1, 1)
    apart = {x.ts: x for x in features.depth_features(r, by_year=True).collect()}
    joined = {x.ts: x for x in features.depth_features(r).collect()}
    assert joined[first].fl_max_3h == 8 and joined[first].fl_depth_lag_1h == 4
    assert apart[first].fl_max_3h == 8 and apart[first].fl_depth_lag_1h is None and apart[first].fl_hours_since_5cm == 0
    assert apart[start + timedelta(hours=1)].fl_max_3h == joined[start + timedelta(hours=1)].fl_max_3h
    last = datetime(2023, 12, 31, 23, 45)
    both = [{x.ts: x for x in labels.labels(r, (5,), (1,), by_year=y).collect()} for y in (False, True)]
    assert both[0][last].y_maxdepth_1h == 11 and both[1][last].y_maxdepth_1h is None
    assert both[0][first].y_maxdepth_1h == both[1][first].y_maxdepth_1h == 12


def test_running_sums_over_ranges(spark):
    rng = random.Random(4)
    values = sorted({rng.choice([rng.random(), float(rng.randrange(5))]) for _ in range(500)}, reverse=True)
    rows = [(v, rng.randrange(4)) for v in values]
    got = {r.k: r.run_n for r in metrics.running(spark.createDataFrame(rows, "k double, n long"), "k", ("n",), parts=8).collect()}
    total, want = 0, {}
    for v, n in rows:
        total += n
        want[v] = total
    assert got == want
    assert metrics.running(spark.createDataFrame([], "k double, n long"), "k", ("n",)).count() == 0


def test_loading_features_asks_for_what_exists_and_folds_are_embargoed(spark):
    row = ("FL.AAA.01", datetime(2021, 12, 31, 23), True, True, False, 20.0, 1.0)
    names = "station_code string, ts timestamp_ntz, y_ge15_1h boolean, y_valid_1h boolean, is_onset_15 boolean, y_maxdepth_1h double, x double"
    t = spark.createDataFrame([row, ("FL.AAA.01", datetime(2022, 1, 2), True, None, True, 1.0, 2.0), ("FL.AAA.01", datetime(2020, 5, 1), True, True, True, 1.0, 2.0)], names)
    assert evaluation.load_features(t, (2021, 2022), ("x",), 15, 1).count() == 1
    assert evaluation.load_features(t, (2021, 2022), ("x",), 15, 1, scorable_only=False).columns == ["station_code", "ts", "y_ge15_1h", "y_valid_1h", "is_onset_15", "y_maxdepth_1h", "x"]
    with pytest.raises(ValueError, match="nothing"):
        evaluation.load_features(t, (2021,), ("nothing",), 15, 1)
    parts = {k: [r.ts.year for r in v.collect()] for k, v in evaluation.folds(t, 0).items()}
    assert parts == {"train": [2020], "val": [], "test": [2022]}


def test_baselines_are_tuned_on_one_part_and_tested_on_another(spark):
    rows = [("FL.AAA.01", T0 + timedelta(minutes=15 * k), int(k % 4 == 0), 30.0 if k % 4 == 0 else 2.0, None if k % 8 == 0 else float(k % 4 == 0)) for k in range(80)]
    df = spark.createDataFrame(rows, "station_code string, ts timestamp_ntz, y int, depth double, rain double")
    got = {r.scorer: r for r in evaluation.run_baselines(df, df, df, "depth", "rain").collect()}
    assert (got["persistence"].tp, got["persistence"].fp, got["persistence"].fn) == (20, 0, 0)
    assert (got["rain_rule"].tp, got["rain_rule"].fn) == (10, 10)  # an unknown score is no alert
    assert set(got) == {"persistence", "rain_rule", "climatology", "always_negative"}


def test_a_snapshot_of_nothing_and_a_poll_three_hours_old(spark):
    rows = [(T0 - timedelta(hours=h), 2.0 - h / 10, 0.1 if h else None, -1.0 if h == 0 else None) for h in (0, 1, 3, 5)]
    polls = spark.createDataFrame(rows, "polled_at timestamp_ntz, level double, rise double, flow double")
    one = live.water_snapshot(polls, str(T0)).first()
    assert one.water_rise_3h_mean == 0.3 and one.water_rise_1h_mean is None and one.flow_negative_share == 1.0 and one.water_offline_share == 0.0
    none = live.water_snapshot(polls, "2030-01-01 00:00:00").collect()
    assert len(none) == 1 and none[0].polled_at is None and none[0].flow_mean is None


def test_forecast_of_a_flooded_and_of_an_unknown_station(spark):
    cold = spark.createDataFrame([(True,)], "cold_start boolean")
    got = {r.station_code: r for r in live.live_forecast(spark.createDataFrame([("a", 20.0, 0.9), ("b", None, None), ("c", 1.0, 0.5), ("d", 1.0, 0.01)], "station_code string, depth_now double, prob double"), cold, 15, 0.1).collect()}
    assert {k: (r.status, r.alert, r.probability) for k, r in got.items()} == {"a": ("flooded_now", True, None), "b": ("unknown", False, None), "c": ("at_risk", True, 0.5), "d": ("clear", False, 0.01)}
    assert all(r.cold_start for r in got.values())


def test_raw_files_with_a_mark_and_quoted_commas_and_the_manifest(spark, tmp_path):
    text = '\ufeffflood_code,flood_name,site_timestamp,flood\nFL.AAA.01,"a, b",2024-01-01 00:05:00,12.5\nFL.AAA.01,c,2024-01-01 00:10:00,NULL\nFL.AAA.02,d,2024-01-01 00:10:00,900\n'
    (tmp_path / "flood_2024.csv").write_text(text, encoding="utf-8")
    path = raw.raw_file(spark, str(tmp_path), ("{dataset}-{year}.csv", "{dataset}_{year}.csv"), "flood", 2024)
    got = raw.ingest((spark, path), "flood", 2024)
    assert sorted((r.station_code, r.station_name, r.flood) for r in got.collect() if r.flood) == [("FL.AAA.01", "a, b", 12.5)]
    note = raw.manifest(spark, path, "flood", 2024)
    assert note["rows"] == got.count() == 3 and note["version"] == raw.VERSION and 1 in note.values()
    assert raw.ingest((spark, path), "flood", 2024).inputFiles() == got.inputFiles()  # not written again
    with pytest.raises(FileNotFoundError):
        raw.raw_file(spark, str(tmp_path), ("{dataset}-{year}.csv",), "flood", 2024)


def test_a_store_of_several_versions_and_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", T0, 1.0)], "station_code string, ts timestamp_ntz, x double")
    root = stores.append_poll(str(tmp_path / "polls"), rows, "1")
    stores.append_poll(root, rows.withColumn("y", F.lit(2)), "2")
    both = stores.read_history(spark, root)
    assert both.count() == 2 and {"x", "y", "dt"} <= set(both.columns)
    assert stores.is_stale(both, "2", {"x"}) and not stores.is_stale(both.where("y = 2"), "2", {"x", "y"}) and stores.is_stale(both.where("y = 2"), "2", {"z"})
    again = stores.history(both, spark.createDataFrame([("q",)], "body string"), lambda raw: raw, "2")
    assert again.columns == ["body", "_collector_version"]
    assert stores.kept_days(both, "2024-05-02 00:00:00", 1).count() == 2 and stores.kept_days(both, "2024-06-02 00:00:00", 1).count() == 0
