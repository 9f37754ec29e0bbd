"""The board's alerts, peaks, messages and card on small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import sampling
from sluice.plans import board, serving
from sluice.sources import payloads, stores
from sluice.streaming import live

T0 = datetime(2024, 5, 1, 12)
H, TIERS = (1, 3), (15, 30)


def rows(spark, *given):
    """Rows of (station, depth, risk at 1 h and 3 h, P95 at 1 h and 3 h)."""
    names = [f"{k}{t}_{h}h" for k in ("raw", "prob") for t in TIERS for h in H] + [f"{q}_{h}h" for q in ("p05", "p50", "p95") for h in H]
    schema = "station_code string, ts timestamp_ntz, depth_now double, " + ", ".join(f"{n} double" for n in names)
    data = [(s, T0, d, *(r[k % 2] for k in range(8)), -1.0, None, d, d, *p) for s, d, r, p in given]
    return spark.createDataFrame(data, schema)


def test_alerts_and_peaks(spark):
    df = rows(
        spark, ("A.X.1", 20.0, (0.1, 0.1), (40.0, 40.0)), ("A.X.2", 1.0, (0.7, 0.9), (10.0, 31.0)), ("A.X.3", None, (0.7, None), (None, 16.0)), ("A.X.4", None, (None, None), (None, None))
    )
    cut = {(t, h): 0.5 for t in TIERS for h in H}
    got = board.with_kpis(board.predictions(df, cut, TIERS, H, ((30, 1),)), 15, (15, 30)).orderBy("station_code").collect()
    alerts = {r.station_code: [(x.alert.ge15, x.alert.ge30) for x in r.horizons] for r in got}
    # the depth alerts below its tier's score; at (30, 1) the score doesn't count; the unknown never alert
    assert alerts == {"A.X.1": [(True, False), (True, False)], "A.X.2": [(True, False), (True, True)], "A.X.3": [(True, False), (False, False)], "A.X.4": [(False, False)] * 2}
    assert [(r.peak_risk_pct, r.peak_risk_time_h, r.time_to_warning_h, r.time_to_15_h, r.time_to_30_h) for r in got] == [
        (10.0, 1, 1, 1, 1), (90.0, 3, 1, 3, 3), (70.0, 1, 1, 3, None), (None, None, None, None, None)
    ]
    assert [x.depth.p05 for x in got[0].horizons] == [0.0, None]
    areas = {r.horizon_h: r for r in board.area(board.predictions(df, cut, TIERS, H), ("ts",), 15).collect()}
    assert (areas[1].n_stations, areas[1].stations_alerting, areas[1].risk_pct_p95, areas[3].depth_p95_max) == (4, 3, 70.0, 40.0)


def test_a_station_without_coordinates_is_not_on_the_map(spark):
    df = spark.createDataFrame([("A", 100.5, 13.5), ("B", None, 13.5)], "station_code string, lon double, lat double")
    assert [r.value for r in board.map_features(df).collect()] == ['{"type":"Feature","geometry":{"type":"Point","coordinates":[100.5,13.5]},"properties":{"station_code":"A"}}']


def test_messages_come_back_from_xml(spark, tmp_path):
    levels = [("watch", 6, 1.0), ("watch", 1, 1.0), ("warning", 3, 1.0), ("critical", 3, 40.0), ("critical", 3, 60.0), ("critical", 3, None)]
    df = spark.createDataFrame([(f"S{k}", 'A & <B> "C"', T0, *row) for k, row in enumerate(levels)], "station_code string, district string, ts timestamp_ntz, level string, horizon_h int, depth_now double")
    sent = board.cap_messages(df, "a@example.org")
    board.write_cap(sent, str(tmp_path / "cap"))
    back = board.read_cap(spark, str(tmp_path / "cap")).orderBy("identifier").collect()
    assert back == sent.orderBy("identifier").collect()
    told = [(r.info[1].urgency, r.info[1].severity, r.info[1].responseType, r.info[1].onset) for r in back]
    assert told == [
        ("Future", "Minor", "Monitor", T0 + timedelta(hours=6)), ("Immediate", "Minor", "Monitor", T0 + timedelta(hours=1)), ("Expected", "Severe", "Avoid", T0 + timedelta(hours=3)),
        ("Immediate", "Severe", "Avoid", T0), ("Immediate", "Extreme", "Execute", T0), ("Immediate", "Severe", "Avoid", T0),
    ]
    assert {r.status for r in back} == {"Test"}
    assert all(i.expires - i.onset == timedelta(hours=3) for r in back for i in r.info)


def test_the_card_counts_episodes(spark):
    at = [0, 15, 30, 300, 600]
    scored = spark.createDataFrame([("A", T0 + timedelta(minutes=m), int(m == 30), 1, True) for m in at], "station_code string, ts timestamp_ntz, y int, pred int, is_onset boolean")
    hits = spark.createDataFrame([("A", True, 15.0), ("A", True, 60.0), ("A", False, None)], "station_code string, hit boolean, lead_minutes double")
    card = board.model_card(scored, hits).first()
    assert (card.n_episodes, card.n_detected, card.episodes_per_flood_warned, card.one_step_share, card.precision) == (3, 2, 1.5, 0.5, 0.2)
    assert card.caveats == ["80 % of the alerts do not become floods.", "67 % of the floods are warned of.", "50 % of the warnings come one step ahead or later."]
    nothing = board.model_card(scored.where("false"), hits.where("false")).first()
    assert (nothing.n_events, nothing.pod, nothing.episodes_per_flood_warned) == (0, None, None)


def test_requests_snap_to_the_step(spark):
    available = spark.createDataFrame([(T0, T0 + timedelta(hours=1))], "first_ts timestamp_ntz, last_ts timestamp_ntz")
    asked = spark.createDataFrame([(0, T0 + timedelta(minutes=29)), (1, None), (2, T0 + timedelta(minutes=80)), (3, T0 - timedelta(minutes=1))], "id int, ts timestamp_ntz")
    got = {r.id: ((r.ts - T0).total_seconds() / 60, r.served) for r in serving.served_at(asked, available).collect()}
    assert got == {0: (15, True), 1: (60, True), 2: (75, False), 3: (-15, False)}


def test_matrix_and_probe_rows(spark):
    df = spark.range(400).selectExpr("cast(id as string) station_code", "timestamp_ntz'2024-01-01' ts", "id % 4 = 0 y_ge15_1h", "id % 5 <> 0 y_valid_1h", "id % 2 = 0 is_onset_15", "id * 1.0D y_maxdepth_1h", "id f")
    general = sampling.build_matrix(df, ("f",), 15, 1, negative_rate=0.2).collect()
    assert sum(r.y for r in general) == 80 and 20 < len(general) - 80 < 90
    assert {r.f for r in sampling.build_matrix(df, ("f",), 15, 1, kind="onset", negative_rate=1.0).collect()} == {k for k in range(400) if k % 5 and k % 2 == 0}
    assert all(r.y == r.f for r in sampling.build_matrix(df, ("f",), 15, 1, target="depth").collect())
    with pytest.raises(ValueError, match="no matrix"):
        sampling.build_matrix(df, ("f",), 15, 1, kind="other")
    probe = sampling.probe_rows(df, F.col("f") < 10, ("station_code", "ts"), 30).collect()
    assert {r.f for r in probe} >= set(range(10)) and len(probe) == len({r.f for r in probe}) <= 40


def test_outlines_of_several_rings(spark):
    body = '{"features":[{"properties":{"dname":"A"},"geometry":{"type":"Polygon","coordinates":[[[100,13],[102,14]],[[101,15]]]}},{"properties":{"dname":"B"},"geometry":null}]}'
    got = payloads.district_points(spark.createDataFrame([(body,), ("no json",), (None,)], "body string")).collect()
    assert [(r.district, r.lat, r.lon) for r in got] == [("A", 14.0, 101.0)]


def test_the_store_of_a_stream_goes_on(spark, tmp_path):
    rows_ = spark.range(6).selectExpr("id event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id)) ts", "id user_id", "'a' event_type", "1.0D value", "'' props")
    for part in ("event_id < 4", "event_id >= 4"):
        rows_.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        path = live.stored(live.source(spark, f"{tmp_path}/in/*.parquet"), "2", str(tmp_path / "store"))
    kept = stores.read_history(spark, path)
    assert sorted(r.event_id for r in kept.collect()) == list(range(6))
    assert kept.select("dt").distinct().count() == 6
