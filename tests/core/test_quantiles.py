"""Quantiles by ranges against NumPy."""

import random

import numpy as np
import pytest

from sluice.operators import metrics
from sluice.operators.quantiles import quantiles, with_quantiles

WANTED = {"low": 0.0, "q25": 0.25, "mid": 0.5, "q99": 0.99, "high": 1.0}


def rows():
    rng = random.Random(2)
    out = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", float(rng.randrange(3))) for _ in range(100)] + [(None, 5.0), (None, -1.0), ("c", None), ("d", 7.0)]
    return out + [("a", 1e300), ("a", -1e300), ("a", None)]


@pytest.mark.parametrize("fits", [1_000_000, 10])
def test_groups_equal_numpy(spark, fits):
    df = spark.createDataFrame(rows(), "g string, v double")
    got = {r.g: [r[k] for k in WANTED] for r in quantiles(df, "v", WANTED, ("g",), fits=fits, ranges=4).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g, values in got.items():
        assert values == pytest.approx(np.quantile([v for k, v in rows() if k == g and v is not None], list(WANTED.values())).tolist())
    beside = with_quantiles(df.select("g").distinct(), df, "v", {"mid": 0.5}, ("g",))
    assert {r.g: r.mid for r in beside.collect()}["c"] is None
    assert beside.count() == 5


def test_one_group_weights_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 0)], "v double, n long").where("n > 0")
    assert quantiles(df, "v", {"mid": 0.5, "top": 1.0}, weight="n").first() == (1.0, 2.0)
    assert quantiles(df.limit(0), "v", {"mid": 0.5}).count() == 0


def test_threshold_grid_equals_a_plain_search(spark):
    rng = random.Random(6)
    for n_grid in (5, 20):
        data = [(rng.choice([0.0, 0.0, round(rng.random(), 2)]), int(rng.random() < 0.3)) for _ in range(300)]
        s, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
        at = np.linspace(0, 1, n_grid)
        grid = np.unique(np.concatenate([np.quantile(x, at) for x in (s, s[s > s.min()], s[y == 1])]))
        f2 = {t: 5 * (y[s >= t]).sum() / (4 * y.sum() + (s >= t).sum()) for t in grid}
        best = min(f2, key=lambda t: (-round(f2[t], 6), t))
        got = metrics.best_threshold(spark.createDataFrame(data, "score double, y int"), n_grid=n_grid).first()
        assert (got.threshold, got.f2) == pytest.approx((round(best, 6), round(f2[best], 6)))
