"""Boosted trees: quantiles that cover, models that stop, are saved and score alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import metrics
from sluice.plans import boosting
from sluice.session import written

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """y follows a with a spread that grows, is zero below 2, and a is missing here and there; z follows b."""
    rng = np.random.default_rng(0)
    n = 6000
    a, b, c = rng.uniform(0, 10, n), rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = np.maximum(0, 3 * a - 6 + rng.normal(0, 1 + a / 5, n))
    z = (b + rng.normal(0, 0.1, n) > 0.6).astype(float)
    part = np.arange(n) % 4
    said = [
        (int(i), None if rng.random() < 0.02 else float(a[i]), float(b[i]), float(c[i]), None if i % 50 == 0 else float(y[i]), float(z[i]), bool(part[i] == 1), bool(part[i] == 2), float(rng.integers(2)))
        for i in range(n)
    ]
    df = spark.createDataFrame(said, "id long, a double, b double, c double, y double, z double, validation boolean, held_out boolean, coin double")
    return written(df, "test")


@pytest.fixture(scope="module")
def nodes(rows):
    made = boosting.train(rows.where("NOT held_out"), INPUTS, {"y": [0.05, 0.95]}, ["z", "coin"], rules=boosting.Rules(rounds=16, depth=3, rate=0.3, patience=3))
    return written(made, "test")


def test_outer_quantiles_cover_wet_held_out_rows(rows, nodes):
    scored = boosting.score(nodes, rows.where("held_out AND y IS NOT NULL AND a IS NOT NULL"), INPUTS)
    got = metrics.coverage(scored, "y", "y_p05", "y_p95", 5.0).first()
    assert 0.85 <= got.coverage_wet <= 0.95
    assert got.passes
    right = scored.agg(F.avg(((F.col("z_prob") > 0.5) == (F.col("z") == 1)).cast("double"))).first()[0]
    assert right > 0.85


def test_models_stop_by_themselves_and_say_what_they_used(nodes):
    trees = {(r.target, r.alpha): r.n for r in nodes.where("tree >= 0").groupBy("target", "alpha").agg(F.countDistinct("tree").alias("n")).collect()}
    assert trees.get(("coin", None), 0) < 10 < trees["z", None] + 3  # nothing foretells a coin
    gained = boosting.gain_importance(nodes, 1).where("target <> 'coin'").collect()
    assert {(r.target, r.feature) for r in gained} == {("y", "a"), ("z", "b")}
    assert all(r.gain_share > 0.9 for r in gained)


def test_a_saved_model_scores_alike(spark, rows, nodes, tmp_path):
    boosting.save(nodes, {"features": INPUTS, "negative_rate": 0.25}, str(tmp_path / "model"))
    again, meta = boosting.load(spark, str(tmp_path / "model"))
    assert meta == {"features": INPUTS, "negative_rate": 0.25}
    some = rows.where("id < 200")
    key = lambda n: sorted(map(tuple, boosting.score(n, some, INPUTS).select("id", "y_p05", "y_p95", "z_prob").collect()))
    assert key(again) == key(nodes)


def test_scores_follow_the_nodes(rows, nodes):
    """Each tree walked by hand."""
    table = nodes.toPandas()
    some = {r.id: r for r in rows.where("id < 60").collect()}
    got = {r.id: r.y_p95 for r in boosting.score(nodes, rows.where("id < 60"), INPUTS).collect()}
    own = table[(table["target"] == "y") & (table["alpha"] == 0.95)]
    for i, r in some.items():
        total = own[own["tree"] < 0]["value"].iloc[0]
        for _, tree in own[own["tree"] >= 0].groupby("tree"):
            tree = tree.set_index("node")
            at = 0
            while isinstance(f := tree["feature"][at], str):
                x = r[f]
                at = int(tree["left" if (tree["missing_left"][at] if x is None else x <= tree["threshold"][at]) else "right"][at])
            total += tree["value"][at]
        assert got[i] == pytest.approx(total)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1.0, 2.0, False), (1.0, 2.0, True)], "a double, y double, validation boolean")
    nodes = boosting.train(df, ["a"], {"y": [0.5]}, rules=boosting.Rules(rounds=2, depth=2))
    assert [tuple(r) for r in boosting.score(nodes, df, ["a"]).select("y_p50").collect()] == [(2.0,), (2.0,)]
