"""Hollows of a raster of any size: the level at which the water of each cell runs off.

A cell's spill level is the least, over all ways to an outlet, of the
highest cell on the way (eight neighbours; an outlet is a cell that lacks
one of its four).  Tiles are flooded by themselves and tell how their rim
cells are joined inside; the rims of all tiles make one graph, small beside
the raster, whose levels are found in Spark; with those each tile floods
again and lifts its cells.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import written

#: Edge of a tile in cells: a task floods TILE * TILE of them.
TILE = 512
#: Edges of a graph that one task finishes; larger ones are contracted first.
SMALL = 200_000
#: The number that stands for all there is beyond the outlets.
OUTSIDE = -(1 << 63)
_HALF = 1 << 31


def cell_number(y: Column | str, x: Column | str) -> Column:
    """One long for a cell, for rows and columns within 2^31 of 0."""
    return F.shiftleft(F.col(y) if isinstance(y, str) else y, 32) + (F.col(x) if isinstance(x, str) else x) + F.lit(_HALF).cast("long")


def _tiled(cells: DataFrame, tile: int) -> DataFrame:
    """Each cell in its own tile, and once more in every tile it borders on."""
    own = lambda c: F.floor(F.col(c) / tile).cast("long")
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + k) / tile).cast("long") for k in (-1, 0, 1))))
    placed = cells.where(F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double"))).select(
        F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("z").cast("double").alias("z")
    )
    return (
        placed.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
        .withColumn("own", (F.col("ty") == own("y")) & (F.col("tx") == own("x")))
    )


class _Tile:
    """The cells of a tile and a line around it as flat arrays."""

    def __init__(self, rows: pd.DataFrame):
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        self.y0, self.x0 = int(y.min()) - 1, int(x.min()) - 1
        self.wide = int(x.max()) - self.x0 + 2
        size = (int(y.max()) - self.y0 + 2) * self.wide
        at = (y - self.y0) * self.wide + x - self.x0
        self.z = np.full(size, np.nan)
        self.z[at] = rows["z"]
        self.own = np.zeros(size, bool)
        self.own[at[rows["own"].to_numpy()]] = True
        self.there = np.isfinite(self.z)
        w = self.wide
        self.around = (-w - 1, -w, -w + 1, -1, 1, w - 1, w, w + 1)
        own = np.flatnonzero(self.own)
        self.outlets = own[~np.all([self.there[own + d] for d in (-w, -1, 1, w)], axis=0)]
        beyond = self.there & ~self.own
        self.rim = own[np.any([beyond[own + d] for d in self.around], axis=0)]

    def number(self, at: np.ndarray) -> np.ndarray:
        return ((at // self.wide + self.y0) << 32) + at % self.wide + self.x0 + _HALF

    def flood(self, seeds: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Level and label of each own cell, from (level, place, label) inwards, the lowest first; a seed keeps its label."""
        z, own = self.z.tolist(), self.own.tolist()
        level, label = [np.nan] * len(z), [0] * len(z)
        heap = [(low, at, 0, name) for low, at, name in seeds]
        heapify(heap)
        while heap:
            low, at, _, name = heappop(heap)
            if own[at]:
                own[at] = False  # reached
                level[at], label[at] = low, name
                for d in self.around:
                    if own[at + d]:
                        heappush(heap, (max(low, z[at + d]), at + d, 1, name))
        return np.array(level), np.array(label, np.int64)


def _spanning(a: np.ndarray, b: np.ndarray, level: np.ndarray) -> pd.DataFrame:
    """The edges of a least spanning forest; the lowest way between any two nodes stays."""
    parent: dict[int, int] = {}

    def top(n: int) -> int:
        while (up := parent.setdefault(n, n)) != n:
            parent[n] = n = parent[up]
        return n

    kept = []
    order = np.argsort(level, kind="stable")
    for u, v, h in zip(a[order].tolist(), b[order].tolist(), level[order].tolist(), strict=True):
        if (p := top(u)) != (q := top(v)):
            parent[p] = q
            kept.append((u, v, h))
    return pd.DataFrame(kept, columns=["a", "b", "level"]).astype({"a": "int64", "b": "int64", "level": "float64"})


def _joined_rims(rows: pd.DataFrame) -> pd.DataFrame:
    """How a tile's rim cells reach each other, the outside and the cells beyond the rim: (a, b, level)."""
    if not rows["own"].any():
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "level": pd.Series(dtype="float64")})
    t = _Tile(rows)
    names = t.number(t.rim)
    inner = np.setdiff1d(t.outlets, t.rim)
    seeds = [*zip(t.z[t.rim].tolist(), t.rim.tolist(), names.tolist(), strict=True), *((h, i, OUTSIDE) for h, i in zip(t.z[inner].tolist(), inner.tolist(), strict=True))]
    level, label = t.flood(seeds)
    edges = []
    for d in t.around[4:]:  # each pair of neighbours once
        here = np.flatnonzero(t.own)
        here = here[t.own[here + d]]
        here = here[label[here] != label[here + d]]
        edges.append((label[here], label[here + d], np.maximum(level[here], level[here + d])))
    out = np.intersect1d(t.outlets, t.rim)
    edges.append((t.number(out), np.full(len(out), OUTSIDE), t.z[out]))
    inside = _spanning(*(np.concatenate(c) for c in zip(*edges, strict=True)))
    across = []
    for d in t.around:
        here = t.rim[t.there[t.rim + d] & ~t.own[t.rim + d]]
        here = here[t.number(here) < t.number(here + d)]  # the other tile leaves this pair out
        across.append(pd.DataFrame({"a": t.number(here), "b": t.number(here + d), "level": np.maximum(t.z[here], t.z[here + d])}))
    return pd.concat([inside, *across], ignore_index=True)


def _lifted(rows: pd.DataFrame, rims: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not rows["own"].any():
        return pd.DataFrame({"y": [], "x": [], "filled": []})
    t = _Tile(rows)
    known = pd.Series(rims["level"].to_numpy(), index=rims["node"].to_numpy()).reindex(t.number(t.rim)).to_numpy()
    seeds = [(h, i, 0) for at, levels in ((t.rim, known), (t.outlets, t.z[t.outlets])) for h, i in zip(levels.tolist(), at.tolist(), strict=True)]
    level, _ = t.flood(seeds)
    own = np.flatnonzero(t.own)
    return pd.DataFrame({"y": own // t.wide + t.y0, "x": own % t.wide + t.x0, "filled": level[own]})


def _finish(edges: pd.DataFrame) -> pd.DataFrame:
    """Levels of a graph that fits one task: the lowest way from the outside first."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, h in zip(edges["a"].tolist(), edges["b"].tolist(), edges["level"].tolist(), strict=True):
        near.setdefault(a, []).append((b, h))
        near.setdefault(b, []).append((a, h))
    level, heap = {}, [(-np.inf, OUTSIDE)]
    while heap:
        low, node = heappop(heap)
        if node not in level:
            level[node] = low
            for other, h in near.get(node, ()):
                if other not in level:
                    heappush(heap, (max(low, h), other))
    del level[OUTSIDE]
    return pd.DataFrame({"node": list(level), "level": list(level.values())}).astype({"node": "int64", "level": "float64"})


def spill_levels(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``(node, level)``: the least highest edge on a way from each node to ``OUTSIDE``.

    ``edges`` are ``(a, b, level)``, either way.  Each round a node looks at
    its lowest edge.  Some nodes, by a coin that changes with the round,
    stay; the others join the one at the end of that edge if it stays.  A
    node's level is the larger of the edge it joined by and the level of
    whom it joined, so what a round found suffices to go back.  A quarter of
    the nodes is gone after a round; nothing is gathered per node, and the
    last ``small`` edges are finished in one task.
    """
    once = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level").where("a <> b").groupBy("a", "b").agg(F.min("level").alias("level"))
    e = written(once(edges), "spill")
    joined: list[DataFrame] = []
    while e.count() > small:
        k = len(joined)
        stays = lambda c: (F.col(c) == OUTSIDE) | (F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(2)) == 0)  # noqa: B023, E731
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "level"))
        # ties go by the pair, so that both ends see them alike
        best = both.where(F.col("a") != OUTSIDE).groupBy("a").agg(F.min(F.struct("level", F.least("a", "b"), F.greatest("a", "b"), "b")).alias("m"))
        moved = best.select(F.col("a").alias("node"), F.col("m.b").alias("to"), F.col("m.level").alias("by"))
        moved = written(moved.where(stays("to") & ~stays("node")), "spill")
        joined.append(moved)
        for end in ("a", "b"):
            e = e.join(moved.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        e = written(once(e), "spill")
    levels = e.groupBy().applyInPandas(_finish, "node long, level double")
    for moved in reversed(joined):
        through = moved.join(levels.withColumnRenamed("node", "to"), "to", "left")
        found = through.select("node", F.greatest("by", F.coalesce("level", "by")).alias("level"))
        levels = written(levels.unionByName(found), "spill")
    return levels


def filled(cells: DataFrame, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """``(y, x, filled)`` of the cells ``(y, x, z)``: the surface when every hollow is full to its brim.

    Missing cells, nulls and NaN let water out.  Work and memory of a task
    follow the tile; the graph of rims has some 4 / ``tile`` of the cells.
    """
    tiled = _tiled(cells, tile)
    edges = tiled.groupBy("ty", "tx").applyInPandas(_joined_rims, "a long, b long, level double")
    levels = spill_levels(edges, small)
    place = levels.select("node", "level", F.shiftright("node", 32).alias("y"), (F.col("node").bitwiseAND(F.lit((1 << 32) - 1)) - _HALF).alias("x"))
    rims = place.select("node", "level", F.floor(F.col("y") / tile).cast("long").alias("ty"), F.floor(F.col("x") / tile).cast("long").alias("tx"))
    return tiled.groupBy("ty", "tx").cogroup(rims.groupBy("ty", "tx")).applyInPandas(_lifted, "y long, x long, filled double")


def hollows(cells: DataFrame, least: float = 0.05, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """``(y, x, z, filled, depth)``: how deep the water of a full hollow stands; depths under ``least`` count as none."""
    both = cells.select("y", "x", "z").join(filled(cells, tile, small), ["y", "x"])
    depth = F.round(F.col("filled") - F.col("z"), 6)
    return both.withColumn("depth", F.when(depth >= least, depth).otherwise(0.0))


def routing_surface(hollow: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """``hollows`` with ``z`` as the surface to route water over: full hollows dented by ``epsilon`` of their depth.

    A full hollow is flat and has no way down; the dent leads its water to
    the deepest place, where it gathers.
    """
    dent = F.col("filled") - epsilon * (F.col("filled") - F.col("z"))
    return hollow.select("y", "x", F.round(dent, 9).alias("z"))


def wetness(cells: DataFrame, drained: DataFrame, size: float) -> DataFrame:
    """``(y, x, wetness)``: the logarithm of the area above a cell per width over the tangent of its slope.

    ``cells`` carry ``slope`` in degrees, ``drained`` the ``cells`` that run
    through each; a slope counts as 0.05 degrees at least.
    """
    tangent = F.tan(F.radians(F.greatest("slope", F.lit(0.05))))
    both = cells.select("y", "x", "slope").join(drained, ["y", "x"])
    return both.select("y", "x", F.round(F.log(F.col("cells") * size / tangent), 6).alias("wetness"))
