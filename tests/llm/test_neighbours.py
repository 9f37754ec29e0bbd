import numpy as np
from pyspark.sql import functions as F

from sluice.llm import neighbours as nn


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:1500] = x[500]  # a vector that a third of the rows share
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] * 16), (5100, [float("inf")] * 16), (5120, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(3))
    got = {}
    for r in nn.search(df, F.col("id") % 20 == 0, block=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(np.arange(3000), x.astype(float))
    assert got.keys() == want.keys()
    hit = total = 0
    for q, w in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, 21))
        keys = [(-s, v) for _, v, s in got[q]]
        assert keys == sorted(keys) and q not in [v for _, v, _ in got[q]]
        hit += len({v for v, _ in w} & {v for _, v, _ in got[q]})
        total += len(w)
        scores = dict(w)
        assert all(abs(scores[v] - s) < 1e-12 for _, v, s in got[q] if v in scores)
    assert hit / total >= 0.9


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nn.search(few, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert nn.search(few.limit(0), F.col("id") % 20 == 0).count() == 0


def test_repeated_ids_count_once_and_dimensions_are_apart(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    other = [(100 + i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(30, 3)))]
    more = [rows[0], (20, [9.0] * 5), rows[7], (3, None)]
    df = spark.createDataFrame(rows + other + more, "vec_id long, embedding array<double>")
    got = {}
    for r in nn.search(df, F.col("id") % 20 == 0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 100, 120}
    assert all(len(v) == len(set(v)) == 4 for v in got.values())
    assert got[0] == [v for v, _ in brute(np.arange(60), x, 4)[0]]
    assert all(v >= 100 for q in (100, 120) for v in got[q])


def test_tree_covers_all_leaves_and_walk_visits_each_once():
    x = np.random.default_rng(2).normal(size=(2000, 8))
    tree = nn.fit_tree(x)
    assert sorted(tree.best_first(x[0])) == list(range(tree.leaves))
    assert np.bincount(tree.assign(x), minlength=tree.leaves).max() < 400
