"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is indexed by the
leaf it descends to.  A query walks the tree best bin first, through a
priority queue of nodes by their centre's inner product, and visits
leaves until as many are open as a calibration against brute force asks
for.  Queries then meet the rows of their leaves in one join.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sorted_groups

#: Rows the tree is fitted on at most, children of a node, sample rows above which a node splits.
SAMPLE, BRANCHES, LEAF = 20_000, 16, 48
#: Queries whose brute-force answers calibrate the visits, and the recall aimed at (0.9 is asked for).
CALIBRATED, RECALL = 256, 0.94
#: How far a blocked product may be from the ordered sum, relative to the vectors' lengths.
ROUNDING = 1e-12
#: Rows, and queries, that one task compares at once.
BLOCK = 4096
K = 20


@dataclass
class Tree:
    """Centres of all nodes, children per inner node, and leaf numbers."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to, by the nearest child."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = np.argmin((c * c).sum(axis=1)[None, :] - 2 * x[rows] @ c.T, axis=1)
            stack += [(int(kids[k]), rows[near == k]) for k in np.unique(near)]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not len(kids):
                yield int(self.leaf[node])
                continue
            for worth, kid in zip((self.centres[kids] @ q).tolist(), kids.tolist(), strict=True):
                heapq.heappush(heap, (-worth, kid))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        near = np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 0) -> Tree:
    """Split the sample by k-means until a node has at most ``leaf`` rows or they are all alike."""
    rng = np.random.default_rng(seed)
    centres, children, leaves = [x.mean(axis=0)], [np.zeros(0, np.int64)], [0]
    stack, count = [(0, np.arange(len(x)))], 0
    while stack:
        node, rows = stack.pop()
        own = x[rows]
        distinct = len(np.unique(own, axis=0)) if len(rows) > leaf else 0
        if distinct < 2:
            leaves[node] = count
            count += 1
            continue
        c = _k_means(own, min(branches, distinct, max(2, -(-len(rows) // leaf))), rng)
        near = np.argmin((c * c).sum(axis=1)[None, :] - 2 * own @ c.T, axis=1)
        used = np.unique(near)
        if len(used) < 2:
            leaves[node] = count
            count += 1
            continue
        kids = np.arange(len(centres), len(centres) + len(used))
        children[node] = kids
        for k, kid in zip(used.tolist(), kids.tolist(), strict=True):
            centres.append(c[k])
            children.append(np.zeros(0, np.int64))
            leaves.append(-1)
            stack.append((kid, rows[near == k]))
        leaves[node] = -1
    return Tree(np.array(centres), children, np.array(leaves))


def ordered_products(q: np.ndarray, row: np.ndarray, p: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The inner products of rows ``row`` of ``q`` and ``col`` of ``p``, in double precision, summed in the order of the components.

    Equal vectors get equal scores wherever they stand, unlike with a
    blocked matrix product, so ties break by id.
    """
    out = np.zeros(len(row))
    for d in range(q.shape[1]):
        out += q[row, d] * p[col, d]
    return out


def top(q: np.ndarray, own: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's ``k`` best candidates with other ids than its own; ties to the smaller id.

    A matrix product finds who may be among them, within its rounding; the
    scores that decide are ordered sums.
    """
    rough = q @ p.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    slack = ROUNDING * max(1.0, float(np.sqrt((q * q).sum(axis=1).max(initial=0) * (p * p).sum(axis=1).max(initial=0))))
    bound = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - slack if len(ids) > k else np.full(len(q), -np.inf)
    row, col = np.nonzero((rough >= bound[:, None]) & (rough > -np.inf))
    score = ordered_products(q, row, p, col)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return row[kept], col[kept], score[kept]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, n, v)``: vectors of finite components that aren't all zero, as packed doubles, and their dimension.

    An id counts once: of rows that repeat it the one with the least vector.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)) & F.exists(v, lambda c: c != 0)
    kept = rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).alias("id"), v.alias("v"))
    again = materialise(kept.groupBy("id").count().where("count > 1").select("id"), "repeated-vectors")
    if not again.isEmpty():
        once = kept.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        kept = kept.join(again, "id", "left_anti").unionByName(once)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = 8 * np.cumsum(sizes)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
            v = [flat[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(v, pa.binary())], names=["id", "n", "v"])

    return kept.mapInArrow(packed, "id long, n long, v binary")


def _brute_force(points: DataFrame, queries: list, k: int) -> DataFrame:
    """Exact top ``k`` of a bounded list of queries over all points: ``(query, id, leaf)``."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((np.array([q["id"] for q in queries], np.int64), np.array([np.frombuffer(q["v"], "<f8") for q in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids = part.column(0).to_numpy()
                rows, cols, s = top(q, own, _vectors(part.column(1)), ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[rows]), pa.array(ids[cols]), pa.array(part.column(2).to_numpy()[cols]), pa.array(s)],
                    names=["query", "id", "leaf", "score"],
                )

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    local = points.select("id", "v", "leaf").mapInArrow(run, "query long, id long, leaf long, score double")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "id", "leaf")


def calibrate(tree: Tree, points: DataFrame, queries: list, k: int, recall: float) -> tuple[int, float]:
    """Leaf visits that reach ``recall`` on the given queries, and the recall they reach."""
    true: dict[int, list[int]] = {}
    for r in _brute_force(points, queries, k).collect():  # k rows a calibration query
        true.setdefault(r["query"], []).append(r["leaf"])
    order = {q["id"]: {leaf: n for n, leaf in enumerate(tree.best_first(np.frombuffer(q["v"], "<f8")))} for q in queries}
    needed = np.sort([order[q][leaf] + 1 for q, found in true.items() for leaf in found])
    if not len(needed):
        return 1, 1.0
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def search(
    rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL,
    sample: int = SAMPLE, calibrated: int = CALIBRATED, block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest rows by inner product of each row that satisfies ``is_query``.

    ``is_query`` is a condition on ``id``.  Returns ``(query_id, rank,
    vec_id, score)``.  Null vectors, zero vectors and those with null or
    non-finite components take no part; an id that rows repeat counts once,
    with its least vector; vectors of different dimension have no inner
    product, so each dimension is searched by itself.  Candidates are all
    rows but the query's own; ties go to the smaller id.  Leaves and queries
    of a leaf above ``block`` are compared block by block, so a vector that
    many rows share is not one task's work.  Other columns aren't read.
    """
    made = materialise(usable(rows, id_col, vector_col), "vectors")
    sizes = [r["n"] for r in made.select("n").distinct().orderBy("n").collect()]
    found = [_search(made.where(F.col("n") == n).select("id", "v"), is_query, k, recall, sample, calibrated, block) for n in sizes]
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionByName, found, empty)


def _search(usable_rows: DataFrame, is_query, k: int, recall: float, sample: int, calibrated: int, block: int) -> DataFrame:
    """``search`` among vectors of one dimension, ``(id, v)``."""
    spark = usable_rows.sparkSession
    fitted = usable_rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    tree = spark.sparkContext.broadcast(fit_tree(np.array([np.frombuffer(r["v"], "<f8") for r in fitted])))  # at most 2 x sample centres

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.value.assign(_vectors(b.column(1))))], names=["id", "v", "leaf"])

    points = materialise(usable_rows.mapInArrow(index, "id long, v binary, leaf long"), "indexed")
    asked = points.where(is_query).select("id", "v")
    trial = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(calibrated).collect()
    visits, _ = calibrate(tree.value, points, trial, k, recall)
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in points.groupBy("leaf").count().collect():  # at most ``sample`` leaves
        sizes[r["leaf"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows_, leaves = [], []
            for r, q in enumerate(_vectors(b.column(1))):
                seen = 0
                for n, leaf in enumerate(tree.value.best_first(q)):
                    if n >= visits and seen > k:
                        break
                    rows_.append(r)
                    leaves.append(leaf)
                    seen += int(held.value[leaf])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows_)), b.column(1).take(pa.array(rows_)), pa.array(leaves)], names=["id", "v", "leaf"])

    opened = materialise(asked.mapInArrow(walk, "id long, v binary, leaf long"), "visits")
    asking = np.zeros(tree.value.leaves, np.int64)
    for r in opened.groupBy("leaf").count().collect():
        asking[r["leaf"]] = r["count"]
    parts = spark.createDataFrame([(i, int(max(1, -(-a // block))), int(max(1, -(-b // block)))) for i, (a, b) in enumerate(zip(sizes.tolist(), asking.tolist(), strict=True))], "leaf long, p_parts int, q_parts int")

    def dealt(side: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_parts")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(other)
        return side.join(F.broadcast(parts), "leaf").select("leaf", mine, every, "id", "v").select("leaf", "p", "q", F.lit(kind).alias("kind"), "id", "v")

    met = dealt(points, 0, "p", "q").unionByName(dealt(opened, 1, "q", "p"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in sorted_groups(batches, 3):
            heads = [groups.column(c).to_numpy() for c in range(3)]
            change = np.ones(groups.num_rows, bool)
            change[1:] = np.logical_or.reduce([h[1:] != h[:-1] for h in heads])
            starts = np.append(np.flatnonzero(change), groups.num_rows)
            kind, ids, packed = groups.column(3).to_numpy(), groups.column(4).to_numpy(), groups.column(5).to_pylist()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                m = s + int((kind[s:e] == 0).sum())
                if m == s or m == e:
                    continue
                p = np.frombuffer(b"".join(packed[s:m]), "<f8").reshape(m - s, -1)
                for at in range(m, e, 256):
                    to = min(e, at + 256)
                    q = np.frombuffer(b"".join(packed[at:to]), "<f8").reshape(to - at, -1)
                    r, c, scores = top(q, ids[at:to], p, ids[s:m], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][r]), pa.array(ids[s:m][c]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    near = met.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q", "kind").mapInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
