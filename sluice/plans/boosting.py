"""Boosted trees over histograms of binned features: quantiles and yes-or-no targets, many models in one pass.

Features are cut into bins once.  For each level of a round's trees one
job reads the bins, adds up gradients per model, node, feature and bin, and
returns sums whose number depends on the parameters only; splits are chosen
from them.  Gradients are whole multiples of 2^-20, so sums don't depend on
the order of the rows.  A model is a table of nodes: it is saved, ranked by
gain and scored as one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import written

_UNIT = 1 << 20
#: Bins of scores from which the average precision of a validation part is read.
_SCORE_BINS = 1024
NODES = "target string, alpha double, tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double, gain double, n long"


@dataclass
class Rules:
    """How trees grow."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    least_rows: int = 50
    l2: float = 1.0
    #: rounds without a better validation score after which a model stops
    patience: int = 5


@dataclass
class _Tree:
    feature: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    n: list[int] = field(default_factory=lambda: [0])

    def divide(self, node: int, feature: int, split: int, missing_left: bool, gain: float, sides: tuple[tuple[int, float], ...]) -> list[int]:
        made = []
        for n, value in sides:
            made.append(len(self.feature))
            for column, first in ((self.feature, -1), (self.split, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0), (self.n, n)):
                column.append(first)
        self.feature[node], self.split[node], self.missing_left[node], self.gain[node] = feature, split, missing_left, gain
        self.left[node], self.right[node] = made
        return made

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins; bin 0 is a missing value."""
        feature, split, missing, left, right = (np.array(c) for c in (self.feature, self.split, self.missing_left, self.left, self.right))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := feature[node] >= 0).any():
            b = x[rows, np.maximum(feature[node], 0)]
            goes_left = np.where(b == 0, missing[node], b <= split[node])
            node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
        return node


@dataclass
class _Model:
    target: str
    #: the quantile, or None for a yes-or-no target
    alpha: float | None
    base: float = 0.0
    trees: list[_Tree] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    growing: bool = True

    def predicted(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaf_of(x)]
        return out

    def gradient(self, y: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Downhill direction and curvature, in units."""
        if self.alpha is None:
            p = 1 / (1 + np.exp(-predicted))
            return np.rint((y - p) * _UNIT), np.rint(p * (1 - p) * _UNIT)
        return np.where(y > predicted, round(self.alpha * _UNIT), round((self.alpha - 1) * _UNIT)).astype(float), np.full(len(y), float(_UNIT))

    def best_round(self) -> int:
        """Trees to keep: up to the best validation score, the earliest of equal ones."""
        return int(np.argmin(self.scores)) if self.scores else len(self.trees)


def _edges(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    at = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), at, F.lit(10_000)).alias(c) for c in features)).first()
    return {c: sorted(set(found[c] or [])) for c in features}


def _binned(rows: DataFrame, features: list[str], edges: dict[str, list[float]], targets: list[str], validation: str) -> DataFrame:
    """Bins per feature, targets, and whether a row is for validation; 0 is missing, k + 1 has k edges below."""

    def number(c: str):
        over = F.filter(F.array(*map(F.lit, edges[c])).cast("array<double>"), lambda e: e < F.col(c).cast("double"))
        return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0).otherwise(F.size(over) + 1).cast("short")

    made = [number(c).alias(f"b{k}") for k, c in enumerate(features)] + [F.col(t).cast("double").alias(f"y{k}") for k, t in enumerate(targets)]
    return written(rows.select(*made, F.col(validation).cast("boolean").alias("v")), "bins")


def _arrays(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    columns = [batch.column(k) for k in range(batch.num_columns)]
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns[:n_features]]).astype(np.int64)
    ys = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns[n_features:-1]]
    return x, ys, columns[-1].to_numpy(zero_copy_only=False).astype(bool)


def _sums(binned: DataFrame, models: list[_Model], ys: dict[str, int], growing: list[_Tree], frontier: list[list[int]], n_features: int, bins: int) -> pd.DataFrame:
    """(model, cell, n, g, h) over training rows, a cell being a frontier node, a feature and a bin; cell -1 - k counts validation."""
    wide = bins + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, len(f) * n_features * wide)) for f in frontier]
        judged: list[dict[int, np.ndarray]] = [{} for _ in models]
        for batch in batches:
            x, targets, validation = _arrays(batch, n_features)
            for k, m in enumerate(models):
                if not m.growing:
                    continue
                y = targets[ys[m.target]]
                known = ~np.isnan(y)
                use = known & ~validation
                xs, yt = x[use], y[use]
                g, h = m.gradient(yt, m.predicted(xs))
                slot = np.full(len(growing[k].feature), -1)
                slot[frontier[k]] = np.arange(len(frontier[k]))
                at = slot[growing[k].leaf_of(xs)]
                open_ = at >= 0
                for f in range(n_features):
                    cell = (at[open_] * n_features + f) * wide + xs[open_, f]
                    for r, w in enumerate((None, g[open_], h[open_])):
                        held[k][r] += np.bincount(cell, w, held[k].shape[1])
                if len(growing[k].feature) == 1 and (known & validation).any():  # once a round
                    xv, yv = x[known & validation], y[known & validation]
                    score = m.predicted(xv)
                    if m.alpha is None:
                        cell = np.minimum((_SCORE_BINS / (1 + np.exp(-score))).astype(np.int64), _SCORE_BINS - 1)
                        for c in np.unique(cell).tolist():
                            judged[k][c] = judged[k].get(c, 0) + np.array([(cell == c).sum(), yv[cell == c].sum(), 0])
                    else:
                        off = yv - score
                        judged[k][0] = judged[k].get(0, 0) + np.array([len(off), np.rint(np.maximum(m.alpha * off, (m.alpha - 1) * off) * _UNIT).sum(), 0])
        for k in range(len(models)):
            cell = np.flatnonzero(held[k][0])
            values = np.column_stack([held[k][:, cell], *(v[:, None] for v in judged[k].values())]).astype(np.int64)
            cell = np.concatenate((cell, -1 - np.array(list(judged[k]), np.int64))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k)), pa.array(cell), *map(pa.array, values)], names=["model", "cell", "n", "g", "h"])

    found = binned.mapInArrow(run, "model long, cell long, n long, g long, h long")
    return found.groupBy("model", "cell").agg(*(F.sum(c).alias(c) for c in "ngh")).toPandas()


def _judge(m: _Model, rows: pd.DataFrame) -> float:
    """Mean pinball loss, or the share that the average precision lacks; lower is better."""
    if m.alpha is not None:
        return float(rows["g"].sum() / _UNIT / max(rows["n"].sum(), 1))
    rows = rows.sort_values("cell")  # the highest scores have the least cells
    n, pos = rows["n"].to_numpy(), rows["g"].to_numpy()
    return 1 - float((pos / max(pos.sum(), 1) * np.cumsum(pos) / np.cumsum(n)).sum())


def _best_split(n: np.ndarray, g: np.ndarray, h: np.ndarray, rules: Rules) -> tuple | None:
    """(gain, feature, split, missing left, sides) of one node's sums, each (features, bins)."""
    total_n, total_g, total_h = n[0].sum(), g[0].sum(), h[0].sum()
    worth = lambda a, b: a * a / (b + rules.l2)
    best = None
    for missing_left in (True, False):
        left = [np.cumsum(c[:, 1:], axis=1)[:, :-1] + (c[:, :1] if missing_left else 0) for c in (n, g, h)]
        right = [t - c for t, c in zip((total_n, total_g, total_h), left, strict=True)]
        gain = worth(left[1], left[2]) + worth(right[1], right[2]) - worth(total_g, total_h)
        gain = np.where((left[0] >= rules.least_rows) & (right[0] >= rules.least_rows), gain, -np.inf)
        if gain.size and gain.max() > max(best[0] if best else 0.0, 1e-9):
            f, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
            sides = tuple((int(s[0][f, k]), float(s[1][f, k] / (s[2][f, k] + rules.l2)) * rules.rate) for s in (left, right))
            best = (float(gain[f, k]), int(f), int(k) + 1, missing_left, sides)
    return best


def _leaf_quantiles(binned: DataFrame, models: list[_Model], ys: dict[str, int], growing: list[_Tree], n_features: int) -> dict[tuple[int, int], list[float]]:
    """Per model and leaf the quantiles, at every model's alpha, of what is left to explain of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, targets, validation = _arrays(batch, n_features)
            for k, m in enumerate(models):
                if m.growing and m.alpha is not None:
                    y = targets[ys[m.target]]
                    use = ~np.isnan(y) & ~validation
                    left = y[use] - m.predicted(x[use])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(use.sum(), k)), pa.array(growing[k].leaf_of(x[use])), pa.array(left)], names=["model", "leaf", "rest"])

    at = F.array(*(F.lit(a) for a in sorted({m.alpha for m in models if m.alpha is not None})))
    found = binned.mapInArrow(run, "model long, leaf long, rest double").groupBy("model", "leaf").agg(F.percentile_approx("rest", at, F.lit(10_000)).alias("q"))
    return {(r["model"], r["leaf"]): r["q"] for r in found.collect()}  # models by leaves


def train(rows: DataFrame, features: list[str], quantiles: dict[str, list[float]], yes_no: list[str] = (), validation: str = "validation", rules: Rules | None = None) -> DataFrame:
    """The nodes of a model per target and quantile, and per yes-or-no target; ``validation`` marks the rows that stop them.

    A row without a target's value is not used for that target.  Missing
    features go to the side that gains more.  Each model stops by itself
    after ``patience`` rounds without a better validation score, and keeps
    the trees up to its best.  The driver holds sums and trees only: models
    by 2^depth nodes by features by bins.
    """
    rules = rules or Rules()
    targets = [*quantiles, *yes_no]
    edges = _edges(rows.where(~F.col(validation)), features, rules.bins)
    binned = _binned(rows, features, edges, targets, validation)
    ys = {t: k for k, t in enumerate(targets)}
    models = [_Model(t, a) for t, alphas in quantiles.items() for a in alphas] + [_Model(t, None) for t in yes_no]
    start = binned.where("NOT v").agg(*(
        (F.percentile_approx(f"y{ys[m.target]}", m.alpha, 10_000) if m.alpha is not None else F.avg(f"y{ys[m.target]}")).alias(f"m{k}") for k, m in enumerate(models)
    )).first()
    for m, value in zip(models, start, strict=True):
        if value is None:
            m.growing = False
        elif m.alpha is None:
            share = min(max(value, 1e-6), 1 - 1e-6)
            m.base = float(np.log(share / (1 - share)))
        else:
            m.base = float(value)
    alphas = sorted({m.alpha for m in models if m.alpha is not None})
    wide, n_features = rules.bins + 2, len(features)
    for done in range(rules.rounds + 1):
        growing: list[_Tree] = [_Tree() for _ in models]
        frontier = [[0] if m.growing else [] for m in models]
        for level in range(rules.depth if done < rules.rounds else 1):
            if not any(frontier):
                break
            sums = _sums(binned, models, ys, growing, frontier, n_features, rules.bins)
            for k, m in enumerate(models):
                own = sums[sums["model"] == k]
                if level == 0 and m.growing:
                    m.scores.append(_judge(m, own[own["cell"] < 0]))
                    m.growing = done < rules.rounds and len(m.scores) - 1 - m.best_round() < rules.patience
                own = own[own["cell"] >= 0]
                cells = np.zeros((3, len(frontier[k]) * n_features * wide))
                cells[:, own["cell"]] = own[["n", "g", "h"]].to_numpy().T
                cells[1:] /= _UNIT
                grown = []
                for s, node in enumerate(frontier[k] if m.growing else []):
                    n, g, h = cells.reshape(3, len(frontier[k]), n_features, wide)[:, s]
                    if split := _best_split(n, g, h, rules):
                        gain, f, at, missing_left, sides = split
                        grown += growing[k].divide(node, f, at, missing_left, gain, sides)
                frontier[k] = grown
        if not any(len(t.feature) > 1 for t in growing):
            break
        rest = _leaf_quantiles(binned, models, ys, growing, n_features) if alphas else {}
        for k, m in enumerate(models):
            if not m.growing:
                continue
            tree = growing[k]
            if len(tree.feature) == 1:
                m.growing = False  # nothing to split any more
                continue
            if m.alpha is not None:
                which = alphas.index(m.alpha)
                tree.value = [rest[k, node][which] * rules.rate if (k, node) in rest else 0.0 for node in range(len(tree.feature))]
            m.trees.append(tree)
    found = []
    for m in models:
        base = (m.target, m.alpha)
        found.append((*base, -1, 0, None, None, None, None, None, m.base, 0.0, 0))
        for t, tree in enumerate(m.trees[: m.best_round()]):
            for node, f in enumerate(tree.feature):
                inner = f >= 0
                found.append((
                    *base, t, node, features[f] if inner else None, float(edges[features[f]][tree.split[node] - 1]) if inner else None, bool(tree.missing_left[node]) if inner else None,
                    tree.left[node] if inner else None, tree.right[node] if inner else None, None if inner else float(tree.value[node]), float(tree.gain[node]), int(tree.n[node]),
                ))
    return rows.sparkSession.createDataFrame(found, NODES)


def gain_importance(nodes: DataFrame, top: int = 20) -> DataFrame:
    """``(target, alpha, feature, gain, splits, gain_share)``: what each model's splits gained, the ``top`` features of each."""
    per = nodes.where("feature IS NOT NULL").groupBy("target", "alpha", "feature").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))
    ranked = per.selectExpr("*", "gain / sum(gain) OVER (PARTITION BY target, alpha) AS gain_share", "row_number() OVER (PARTITION BY target, alpha ORDER BY gain DESC, feature) AS rank")
    return ranked.where(F.col("rank") <= top).drop("rank")


def save(nodes: DataFrame, meta: dict, path: str) -> None:
    """The nodes, and beside them what is needed to use them: features, fold, rate of negatives and so on."""
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    nodes.sparkSession.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), json.loads(spark.read.text(f"{path}/meta").first()["value"])


def name_of(target: str, alpha: float | None) -> str:
    return f"{target}_prob" if alpha is None else f"{target}_p{round(alpha * 100):02d}"


def score(nodes: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with a column per model: ``<target>_p05`` for a quantile, ``<target>_prob`` for a yes-or-no target.

    Trees are walked in the JVM: the nodes ride along as arrays of one row,
    whose size the training's parameters bound.
    """
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature")).cast("int")
    trees = nodes.where("tree >= 0").groupBy("target", "alpha", "tree").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("node", place.alias("f"), "threshold", "missing_left", "left", "right", "value"))),
            lambda s: F.struct(s["f"].alias("f"), s["threshold"].alias("t"), s["missing_left"].alias("m"), s["left"].alias("l"), s["right"].alias("r"), s["value"].alias("v")),
        ).alias("nodes")
    )
    per = nodes.where("tree < 0").select("target", "alpha", F.col("value").alias("base"))
    same = (F.col("a.target") == F.col("b.target")) & F.col("a.alpha").eqNullSafe(F.col("b.alpha"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"])  # sums follow the order
    forests = per.alias("a").join(trees.groupBy("target", "alpha").agg(ordered.alias("trees")).alias("b"), same, "left").select("a.target", "a.alpha", "base", "trees")
    names = [name_of(r["target"], r["alpha"]) for r in per.select("target", "alpha").orderBy("target", "alpha").collect()]  # one a model
    one = forests.groupBy().agg(F.array_sort(F.collect_list(F.struct("target", "alpha", "base", "trees"))).alias("__models"))

    def walked(tree, x):
        def step(at, _):
            node = F.get(tree, at)
            value = F.get(x, node["f"] - 1)
            left = F.when(value.isNull() | F.isnan(value), node["m"]).otherwise(value <= node["t"])
            return F.when(node["f"].isNull(), at).when(left, node["l"]).otherwise(node["r"])

        deepest = F.sequence(F.lit(1), F.size(tree))  # as many steps as a tree may need; leaves stay
        return F.get(tree, F.aggregate(F.slice(deepest, 1, 32), F.lit(0), step))["v"]

    made = rows.withColumn("__x", F.array(*(F.col(c).cast("double") for c in features))).crossJoin(F.broadcast(one))  # one row
    for k, name in enumerate(names):
        m = F.get("__models", F.lit(k))
        raw = F.aggregate(F.coalesce(m["trees"], F.array()), m["base"], lambda total, tree: total + walked(tree, F.col("__x")))
        made = made.withColumn(name, F.when(m["alpha"].isNotNull(), raw).otherwise(1 / (1 + F.exp(-raw))))
    return made.drop("__x", "__models")
