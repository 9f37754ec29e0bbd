"""Pairs that share a bucket: dealing hot buckets out, comparing by size and parities, checking what is left.

A unit is a sequence of words by its hashes.  Units that share a key meet
in its bucket.  There the pairs that size and parities can't rule out are
found; of a small bucket they are returned, to be checked once each
however many buckets they share, and of a larger one the units, to be
checked together and joined as a forest.  Near copies share most of their
buckets, so each unit of a larger bucket is first paired with the least
one there that may be alike: these pairs are few and mostly the same from
bucket to bucket, and what they connect isn't compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, sorted_groups, tidied
from .text import mixed

#: Units that a task compares at once in one bucket at most, and in a bucket whose pairs are returned.
BLOCK, SMALL = 2048, 32
#: Pairs that are verified at once at most, and those of hot buckets that wait for it at least.
TOGETHER, HELD = 2048, 256
#: Bucket rows of a partition, those that a task packs at once, and the share of units by which hot buckets are found.
ROWS, PACKED, SAMPLED = 400_000, 1 << 18, 16
#: Parities a unit carries: columns of 32 bits.
PARITIES = 3
#: What a bucket row carries besides its bucket.
UNIT = np.dtype([("uid", "<i8"), ("bits", "<u4", PARITIES), ("n", "<u2")])
#: The greatest size that fits; such units are never ruled out by size or parities.
HUGE = 2**16 - 1


def packed_slices(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array whose entries are the bytes of consecutive runs of ``values``."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    if offsets[-1] >= 2**31:
        raise ValueError("a batch holds more than 2 GiB of packed values; read fewer rows a batch")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def unpacked(said: pa.Array, kind: str | np.dtype = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The values of packed runs without nulls, one after the other, and their sizes."""
    if isinstance(said, pa.ChunkedArray):
        said = said.combine_chunks()
    if not len(said):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = said.buffers()
    offsets = np.frombuffer(offsets, np.int32)[said.offset : said.offset + len(said) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, kind), np.zeros(len(said), np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind), np.diff(offsets) // size


def units(uid: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    made = np.empty(len(uid), UNIT)
    made["uid"], made["bits"], made["n"] = uid, bits, np.minimum(n, HUGE)
    return made


def parities(values: np.ndarray, sizes: np.ndarray, columns: int = PARITIES) -> np.ndarray:
    """Of each run of 32-bit hashes, how often each of 32 x ``columns`` bits is drawn, modulo 2.

    Two differ in no more bits than the runs, as multisets, in members.
    """
    out, width = np.empty((len(sizes), columns), np.uint32), 32 * columns
    values = values.astype(np.uint32)
    bit = ((values >> np.uint32(5)) % np.uint32(columns) << np.uint32(5) | values & np.uint32(31)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for at in range(0, len(sizes), TOGETHER):
        own = sizes[at : at + TOGETHER]
        drawn = np.bincount(bit[ends[at] : ends[at + len(own)]] + np.repeat(np.arange(len(own)) * width, own), minlength=len(own) * width)
        out[at : at + len(own)] = np.packbits((drawn & 1).astype(bool), bitorder="little").view("<u4").reshape(len(own), columns)
    return out


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, rows being sorted by group: first all neighbours, then the next but one."""
    i, d = np.arange(len(group)), 0
    while len(i):
        d += 1
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        if len(i):
            yield i, i + d


def by_bucket(bucket: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """The rows that aren't alone in their bucket, sorted by it, and within it by ``then``."""
    if len(bucket) < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(bucket)
    ranked = bucket[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1], [False]))
    order = order[same[1:] | same[:-1]]
    return order if then is None else order[np.lexsort((then[order], bucket[order]))]


def numbered(bucket: np.ndarray) -> np.ndarray:
    """The number of each row's bucket, rows being sorted by it."""
    change = np.zeros(len(bucket), np.int64)
    change[1:] = bucket[1:] != bucket[:-1]
    return np.cumsum(change)


#: Makes, of a batch, arrays of buckets and of what stands in them, whose first field tells units apart.
Keys = Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray]]]


def hot_buckets(sampled: DataFrame, keys: Keys, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of more than about ``block`` rows, into how many blocks each is cut, and how many rows its copies add.

    ``sampled`` holds one unit in ``SAMPLED``, by which sizes are estimated;
    which pairs meet doesn't depend on the estimate.
    """

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, _ in keys(batch):
                yield pa.RecordBatch.from_arrays([pa.array(bucket)], names=["bucket"])

    counted = sampled.mapInArrow(tidied(buckets), "bucket long").groupBy("bucket").count().where(F.col("count") * SAMPLED > block)
    found = counted.toArrow()  # at most one in ``block`` of all bucket rows
    bucket, rows = found.column("bucket").to_numpy(), found.column("count").to_numpy() * SAMPLED
    order, parts = np.argsort(bucket), -(-rows // block)
    return bucket[order], parts[order], int((rows * (parts - 1)).sum())


def copied(bucket: np.ndarray, unit: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket rows, those of hot buckets dealt out to new buckets of two blocks each, so that all pairs meet."""
    at = np.minimum(np.searchsorted(hot, bucket), max(len(hot) - 1, 0))
    rows = np.flatnonzero(hot[at] == bucket) if len(hot) else np.zeros(0, np.int64)
    if not len(rows):
        return bucket, unit
    p = parts[at[rows]]
    own = (mixed(unit[unit.dtype.names[0]][rows].astype(np.uint64)) % p.astype(np.uint64)).astype(np.int64)
    other = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
    own, again = np.repeat(own, p), np.repeat(rows, p)
    two = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
    fresh = mixed(bucket[again].view(np.uint64) + mixed(two + np.uint64(1))).view(np.int64)
    rest = np.delete(np.arange(len(bucket)), rows)
    return np.concatenate([bucket[rest], fresh]), np.concatenate([unit[rest], unit[again]])


def met(df: DataFrame, sampled: DataFrame, keys: Keys, kind: np.dtype, rows: int, block: int) -> tuple[DataFrame, np.dtype]:
    """The bucket rows of ``df``, some ``rows`` of them, dealt to partitions of about ``ROWS``, and what they are packed as.

    A task packs the rows that go to one partition into one binary value,
    so Spark shuffles few rows; ``unpacked_rows`` reads them.  A bucket of
    more than about ``block`` rows is dealt out as pairs of blocks.
    """
    spark = df.sparkSession
    hot, parts, more = hot_buckets(sampled, keys, block)
    n = max(1, -(-(rows + more) // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared, row = spark.sparkContext.broadcast((hot, parts)), np.dtype([("bucket", "<i8"), ("unit", kind)])

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        made = np.concatenate(held)
        to = (mixed(made["bucket"].astype(np.uint64)) >> np.uint64(32)) % np.uint64(n)
        to = to.astype(np.uint16 if n <= 1 << 16 else np.int64)
        sizes = np.bincount(to, minlength=n)
        some = np.flatnonzero(sizes)
        packs = packed_slices(made[np.argsort(to, kind="stable")], sizes[some])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packs], names=["to", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for bucket, unit in keys(batch):
                bucket, unit = copied(bucket, unit, *shared.value)
                made = np.empty(len(bucket), row)
                made["bucket"], made["unit"] = bucket, unit
                held.append(made)
                count += len(made)
                if count >= PACKED:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    return df.mapInArrow(tidied(pack), "to int, rows binary").repartitionById(n, "to"), row


def unpacked_rows(batches: Iterable[pa.RecordBatch], row: np.dtype) -> np.ndarray:
    held = [unpacked(b.column(1), row)[0] for b in batches]
    return np.concatenate(held) if held else np.zeros(0, row)


def candidates(df: DataFrame, sampled: DataFrame, keys: Keys, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int, block: int = BLOCK) -> DataFrame:
    """``(a, b, bucket)``: pairs a < b, all of small buckets and some of larger ones, and units a = b of these with something to compare to.

    ``keys`` makes units (``UNIT``) of ``df``, and of ``sampled`` as in
    ``hot_buckets``; ``apart(n, m)`` for n <= m bounds the members by which
    alike units of these sizes differ, and stays negative as m grows.  A
    partition is compared in memory: some ``ROWS`` rows.
    """
    dealt, row = met(df, sampled, keys, UNIT, rows, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = unpacked_rows(batches, row)
        made = made[by_bucket(made["bucket"].copy(), made["unit"]["n"].copy())]
        if not len(made):
            return
        bucket, unit = made["bucket"].copy(), made["unit"]
        group, uid, n = numbered(bucket), unit["uid"].copy(), unit["n"].astype(np.int64)
        bits = [unit["bits"][:, k].copy() for k in range(PARITIES)]
        small = np.bincount(group)[group] <= SMALL
        mark, least, found = np.zeros(len(uid), bool), uid.copy(), []
        i, d = np.arange(len(group)), 0
        while len(i):
            d += 1
            i = i[: np.searchsorted(i, len(group) - d)]
            i = i[group[i] == group[i + d]]
            most, huge = apart(n[i], n[i + d]), n[i + d] == HUGE
            close = (most >= 0) | huge
            i, most, huge = i[close], most[close], huge[close]  # units grow longer within a bucket: later ones are no closer
            differ = np.bitwise_count(bits[0][i] ^ bits[0][i + d]).astype(np.int16)
            for b in bits[1:]:
                differ += np.bitwise_count(b[i] ^ b[i + d])
            hit = i[(differ <= most) | huge]
            hit = hit[uid[hit] != uid[hit + d]]
            two = hit[small[hit]]
            found.append(np.column_stack([np.minimum(uid[two], uid[two + d]), np.maximum(uid[two], uid[two + d])]))
            large = hit[~small[hit]]
            mark[large] = mark[large + d] = True
            least[large] = np.minimum(least[large], uid[large + d])
            least[large + d] = np.minimum(least[large + d], uid[large])
        at = np.flatnonzero(least < uid)
        pairs = once(np.concatenate([*found, np.column_stack([least[at], uid[at]])]))
        at = np.flatnonzero(mark)
        columns = [np.append(pairs[:, 0], uid[at]), np.append(pairs[:, 1], uid[at]), np.append(np.zeros(len(pairs), np.int64), bucket[at])]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "bucket"])

    return dealt.mapInArrow(tidied(run), "a long, b long, bucket long")


def once(pairs: np.ndarray) -> np.ndarray:
    """Pairs of longs, sorted, each once."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[first]


def verified(
    pairs: DataFrame, together: DataFrame, said: DataFrame, alike: Callable[[pa.Array, pa.Array], np.ndarray], apart: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """Links ``(a, b)`` by which the units that are ``alike`` among the candidates are connected.

    ``pairs(a, b)`` are checked one by one, then ``together(bucket, uid)``
    bucket by bucket unless already connected, there or by a unit that both
    are linked to; ``said(uid, said)`` has the units' words.  ``alike`` tells
    it of many pairs at once; ``apart`` is that of ``candidates``, here
    against more parities.
    """
    dealt = said.repartition("uid")  # one shuffle for both ends
    both = pairs.join(dealt.select(F.col("uid").alias("a"), F.col("said").alias("x")), "a")
    both = both.join(dealt.select(F.col("uid").alias("b"), F.col("said").alias("y")), "b")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                yield part.select(["a", "b"]).filter(pa.array(alike(part.column(2), part.column(3))))

    one_by_one = materialise(both.select("a", "b", "x", "y").mapInArrow(tidied(passed), "a long, b long"), "links")
    release(said.sparkSession)
    ends = one_by_one.unionByName(one_by_one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.groupBy(F.col("a").alias("uid")).agg(F.min("b").alias("to"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, 1):
            uid, words = rows.column(1).to_numpy(), rows.column(2).combine_chunks()
            group = numbered(rows.column(0).to_numpy())
            first, last = np.searchsorted(group, group), np.searchsorted(group, group, "right")
            label, links = rows.column(3).to_numpy().copy(), []
            values, n = unpacked(words)
            bits = parities(values, n, 16).view(np.uint64)
            held, count = [], 0

            def check() -> None:
                i, j = map(np.concatenate, zip(*held, strict=True))
                for at in range(0, len(i), TOGETHER):
                    x, y = i[at : at + TOGETHER], j[at : at + TOGETHER]
                    open_ = label[x] != label[y]
                    x, y = x[open_], y[open_]
                    hit = np.flatnonzero(alike(words.take(pa.array(x)), words.take(pa.array(y)))) if len(x) else []
                    for k, m in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                        if label[k] != label[m]:
                            own = label[first[k] : last[k]]
                            own[own == label[m]] = label[k]
                            links.append((uid[k], uid[m]))

            for i, j in pairs_within(group):
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
                near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= apart(np.minimum(n[i], n[j]), np.maximum(n[i], n[j]))
                if near.any():
                    held.append((i[near], j[near]))
                    count += len(held[-1][0])
                if count >= HELD:
                    check()
                    held, count = [], 0
            if held:
                check()
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    known = said.join(linked, "uid", "left").withColumn("label", F.least("uid", "to"))  # of nulls the other one
    rows = together.join(known, "uid").select("bucket", "uid", "said", "label").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(tidied(joined), "a long, b long").unionByName(one_by_one)
