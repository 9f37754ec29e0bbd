"""SimHash near-duplicates, linked exactly through vantage-point shards.

Fingerprints at most ``radius`` bits apart are linked.  A vantage-point
tree keeps, at a node, the distances of its points to a vantage point; by
the triangle bound two points within ``radius`` of one another have
distances to the vantage that differ by at most ``radius``, so a shell of
points only has to meet the shells that overlap its boundary.

On 64-bit fingerprints of unrelated texts those distances crowd around 32
with a deviation of 4, and a tree over the whole distance alone visits some
0.8 of a node's pairs at each level at radius 4.  The top of the tree
therefore measures distance on blocks of the bits: of n even blocks at
least n - ``radius`` are equal in a linked pair, so for each choice of n -
``radius`` blocks there is a tree whose vantage points are the values of
those bits, and the pair is at distance zero, in the same shard, in one of
them.  n follows the number of fingerprints, so shards don't grow with it.
Within a shard a tree over the whole distance goes on, node by node, with
boundary-overlapping parts compared across.

A shard returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SAMPLED, by_bucket, met, numbered, once, pairs_within, unpacked_rows
from .common import arrow_rows, connected_components, materialise, tidied, within, without
from .text import mixed

RADIUS = 4
SHINGLE = 4
#: Fingerprints that one task compares at once at most (larger shards are dealt out as pairs of blocks),
#: those of an average shard, and of one that is compared without a tree.
BLOCK, SHARD, SMALL = 4096, 256, 128
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of each word shingle, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    majority = counts * 2 > len(starts)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is the fingerprint's bits as a signed long."""

    def rows(ids, texts):
        values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
        return zip(ids, values.tolist(), strict=True)

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs, [id_col, text_col], f"{id_col} {id_type}, fp long", rows)


class _Groups:
    """Groups of positions as labels; remembers the joins as edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, x: int, others: np.ndarray) -> None:
        label = self.label
        others = others[label[others] != label[x]]
        while len(others):
            y = int(others[0])
            self.edges.append((x, y))
            label[label == label[y]] = label[x]
            others = others[label[others] != label[x]]


def _compare(groups: _Groups, fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256) -> None:
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        near = np.bitwise_count(fp[part][:, None] ^ fp[right][None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            groups.join(int(part[i]), right[near[i]])


def tree_links(fp: np.ndarray, radius: int, other: np.ndarray | None = None, leaf: int = 64) -> tuple[list[tuple[int, int]], int]:
    """Positions joined by a spanning forest of the links among ``fp``, and the depth of the tree.

    With ``other`` the links are those between the two; positions of
    ``other`` count on from those of ``fp``.  A node's vantage point parts
    its points at the median distance.  Either side is a child, and a third
    one compares the points of the two that lie within ``radius`` of the
    boundary; what is farther from it needs no comparison.
    """
    n = len(fp)
    fp = fp if other is None else np.concatenate([fp, other])
    groups, depth = _Groups(len(fp)), 0
    stack = [(np.arange(n), None if other is None else np.arange(n, len(fp)), 1)]
    while stack:
        left, right, level = stack.pop()
        if not len(left) or right is not None and not len(right) or right is None and len(left) < 2:
            continue
        depth = max(depth, level)
        if len(left) * len(left if right is None else right) <= leaf * leaf:
            _compare(groups, fp, left, left if right is None else right, radius)
            continue
        vantage = fp[left[0]]
        d = np.bitwise_count(fp[left] ^ vantage).astype(np.int16)
        e = d if right is None else np.bitwise_count(fp[right] ^ vantage).astype(np.int16)
        if right is None and d.max() <= radius // 2:  # any two of this ball are linked
            groups.join(int(left[0]), left)
            continue
        middle = int(np.median(d if right is None else np.concatenate([d, e])))
        middle = min(middle, int(max(d.max(), e.max())) - 1)
        if (d > middle).all() and (e > middle).all():  # all at one distance: nothing to part by
            _compare(groups, fp, left, left if right is None else right, radius)
            continue
        inner, outer, near_in, near_out = d <= middle, d > middle, (d <= middle) & (d > middle - radius), (d > middle) & (d <= middle + radius)
        if right is None:
            stack += [(left[inner], None, level + 1), (left[outer], None, level + 1), (left[near_in], left[near_out], level + 1)]
            continue
        halves = [(inner, e <= middle), (outer, e > middle)]
        halves += [(near_in, (e > middle) & (e <= middle + radius)), (near_out, (e <= middle) & (e > middle - radius))]
        for x, y in halves:
            if x.all() and y.all():  # the boundary parts nothing off
                _compare(groups, fp, left, right, radius)
            else:
                stack.append((left[x], right[y], level + 1))
    return groups.edges, depth


def shard_blocks(count: int, radius: int, most: int = SHARD) -> int:
    """The number of even blocks by which ``count`` fingerprints fall into shards of ``most`` on average.

    Of n blocks ``radius`` bits spoil at most ``radius``; the other n -
    ``radius`` agree, and every choice of as many is a tree of its own.
    """
    n = radius + 1
    while n < radius + 6 and count > most * 2 ** (64 * (n - radius) // n):
        n += 1
    return n


def _choices(blocks: int, radius: int) -> list[int]:
    """The bits of each choice of ``blocks`` - ``radius`` even blocks."""
    mask = [((1 << 64 * (k + 1) // blocks) - 1) ^ ((1 << 64 * k // blocks) - 1) for k in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(mask, blocks - radius)]


def shard_keys(fp: np.ndarray, blocks: int, radius: int) -> Iterator[np.ndarray]:
    """For each choice of ``blocks`` - ``radius`` blocks, a hash of their bits and of the choice."""
    for chosen in _choices(blocks, radius):
        bits = np.uint64(chosen)
        yield mixed((fp & bits) ^ mixed(np.array([bits]))).view(np.int64)


def finer_blocks(blocks: int, radius: int) -> np.ndarray:
    """For each choice, the bits outside of it in ``radius`` + 1 blocks: of a linked pair in its shard one agrees as well."""
    out = []
    for chosen in _choices(blocks, radius):
        rest = [k for k in range(64) if not chosen >> k & 1]
        cuts = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
        out.append([sum(1 << k for k in rest[a:b]) for a, b in itertools.pairwise(cuts)])
    return np.array(out, np.uint64)


#: What stands in a shard: a fingerprint, the number that names it, and the choice of blocks.
_MEMBER = np.dtype([("fp", "<i8"), ("name", "<i8"), ("choice", "u1")])


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, most: int = SHARD, name: str = "fp") -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``radius`` bits.

    ``fps`` has distinct values in ``fp``; the long in ``name`` stands for
    them in the edges.  A shard above about ``block`` is dealt out as all
    pairs of its blocks.  A partition is compared in memory: some
    ``blocks.ROWS`` rows.  Within a shard fingerprints meet by one more
    block of their other bits; where many still do, in a tree.
    """
    count = fps.count()
    n = shard_blocks(count, radius, most)

    def keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        made = np.empty(batch.num_rows, _MEMBER)
        made["fp"], made["name"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for choice, shard in enumerate(shard_keys(made["fp"].astype(np.uint64), n, radius)):
            own = made.copy()
            own["choice"] = choice
            yield shard, own

    fps = fps.select(F.col("fp"), F.col(name).alias("name"))
    sampled = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    dealt, row = met(fps, sampled, keys, _MEMBER, count * math.comb(n, radius), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = unpacked_rows(batches, row)
        made = made[by_bucket(made["bucket"].copy())]
        shard, fp, named, choice = made["bucket"].astype(np.uint64), made["unit"]["fp"].astype(np.uint64), made["unit"]["name"].copy(), made["unit"]["choice"]
        found = [np.zeros((0, 2), np.int64)]
        for k, bits in enumerate(finer_blocks(n, radius).T):
            key = mixed(shard + mixed((fp & bits[choice]) + np.uint64(k)))
            order = by_bucket(key)
            group = numbered(key[order])
            small = np.bincount(group)[group] <= SMALL if len(group) else np.zeros(0, bool)
            few, many = order[small], order[~small]
            for x, y in pairs_within(group[small]):
                near = np.bitwise_count(fp[few[x]] ^ fp[few[y]]) <= radius
                found.append(np.column_stack([named[few[x[near]]], named[few[y[near]]]]))
            for at in np.split(many, np.flatnonzero(np.diff(group[~small])) + 1) if len(many) else []:
                joined, _ = tree_links(fp[at], radius)
                if joined:
                    found.append(named[at[np.array(joined)]])
        pairs = once(np.concatenate(found))
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(tidied(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    Rows are the units: equal texts share a fingerprint whatever their ids.
    ``component_id`` is the least id reachable over links of at most
    ``radius`` bits, the row's own included.  A null or empty text has
    fingerprint 0 and links like any other; an empty table gives no rows.
    Other columns of ``docs`` are not read, so their names don't matter.
    """
    fps = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    members = connected_components(links(distinct.select("fp"), radius))
    linked = distinct.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    linked = materialise(linked, "linked-fingerprints")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = linked.join(names, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row per component: the one whose id is the component's least.

    Of rows that repeat an id one stays.  Rows without an id can't be told
    apart and stay.  Columns are those of ``docs``, whatever their names.
    """
    found = near_duplicates(docs, radius, shingle).where("doc_id is not null")
    by_id = materialise(
        found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("head"), F.count("*").alias("rows")),
        "heads",
    )
    kept = without(docs, by_id.where("not head"))
    repeated = by_id.where("head and rows > 1").select("doc_id")
    if not repeated.isEmpty():
        again = within(docs, repeated).dropDuplicates(["doc_id"])
        kept = without(docs, by_id.where("not head or rows > 1")).unionByName(again)
    return kept.select(*docs.columns)
