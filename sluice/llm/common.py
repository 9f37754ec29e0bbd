"""Shared helpers: table access, cut lineage, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    A lost executor then costs a re-read, not a recomputation; the columns
    stay prunable, unlike those of an RDD checkpoint.  The folder goes with
    ``discard``, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing may read these frames afterwards."""
    for df in written:
        _remove(df.sparkSession, df._written_at)
    if written:
        release(written[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished plans go now.

    Spark removes them when the driver's garbage collector finds the plans
    unused, which on a large heap may be long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound, for plans that start from now on, what Spark and a Python worker hold of their rows at once.

    The session's own bound is 64 MiB, which a task of long texts fills, on
    both sides and for what comes back as well; a smaller one is left.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if not 0 < known <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker gives freed memory back: an idle one is kept, as large as it once was."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def unused_name(columns: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column of ``columns`` has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended first; the cluster's own clean-up then applies
        pass


def one_per_id(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` without null ids and with the least text of each repeated id."""
    known = docs.where("doc_id is not null")
    again = materialise(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return known
    once = known.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return known.join(again, "doc_id", "left_anti").unionByName(once)


def membership(ids: DataFrame, most_bits: int = 1 << 28) -> Callable:
    """A test, for use inside tasks, of many longs at once: true for all in ``ids(id long)`` and for few others.

    A bitmap of 16 bits an id, ``most_bits`` at most, is put together in
    Spark and broadcast.  It saves shuffling rows that a semi-join would
    drop; beyond its size it lets ever more through.
    """
    chunk = 1 << 15
    bits = 1 << min(max(int(16 * ids.count()).bit_length(), 15), most_bits.bit_length() - 1)

    def spot(values: np.ndarray) -> np.ndarray:
        return ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(spot(batch.column(0).to_numpy()))
            for c in np.unique(at // chunk).tolist():
                own = np.zeros(chunk, bool)
                own[at[np.searchsorted(at, c * chunk) : np.searchsorted(at, (c + 1) * chunk)] % chunk] = True
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(own).tobytes()])], names=["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(b, np.uint8)
                held[c] = held[c] | own if c in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([b.tobytes() for b in held.values()])], names=["chunk", "bits"])

    schema = "chunk long, bits binary"
    merged = ids.select("id").mapInArrow(tidied(mark), schema).repartition("chunk").mapInArrow(tidied(merge), schema)
    whole = np.zeros((bits // chunk, chunk // 8), np.uint8)
    for r in merged.collect():  # most_bits / 8 bytes
        whole[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def maybe(values: np.ndarray) -> np.ndarray:
        at = spot(values)
        return (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return maybe


def possible_members(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` (long) passes the ``membership`` test of ``ids``."""
    maybe, where = membership(ids), df.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe(batch.column(where).to_numpy())))

    return df.mapInArrow(tidied(keep), df.schema)


def _tested(column: str, test: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``test`` of the hashes of ``column`` as a column; what else a row holds stays in the JVM."""

    @F.arrow_udf("boolean")
    def passed(h: pa.Array) -> pa.Array:
        return pa.array(test(h.to_numpy()))

    return passed(F.xxhash64(column))


def _ids(ids: DataFrame, column: str) -> tuple[DataFrame, Callable]:
    """The values of ``ids`` once each, and a test of their hashes."""
    once = ids.select(column).where(F.col(column).isNotNull()).distinct()
    return once, membership(once.select(F.xxhash64(column).alias("id")))


def within(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids``; few others are shuffled."""
    once, inside = _ids(ids, column)
    return df.where(_tested(column, inside)).join(once, column, "left_semi").select(*df.columns)


def without(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose ``column`` isn't in ``ids``, nulls among them; few are shuffled.

    A ``membership`` test of ``ids`` lets most of these rows through.  The
    values that pass it though they aren't in ``ids`` are found by a join
    of that column alone and make a second test: what fails that one is in
    ``ids``.  Only rows that pass both, some 5 in 100, are joined as rows.
    """
    once, inside = _ids(ids, column)
    known = F.col(column).isNotNull()
    others = df.select(column).where(known).where(_tested(column, inside)).distinct().join(once, column, "left_anti")
    _, outside = _ids(materialise(others, "not-in-list"), column)
    through = df.where(~known | ~_tested(column, inside))
    unsure = df.where(known).where(_tested(column, lambda h: inside(h) & outside(h)))
    return through.unionByName(unsure.join(once, column, "left_anti").select(*df.columns))


def arrow_rows(
    df: DataFrame,
    columns: list[str],
    schema: str,
    fn: Callable[..., Iterable[tuple]],
    rows_per_batch: int = 2048,
) -> DataFrame:
    """``mapInArrow`` over whole batches of ``columns``; ``fn`` gets one list per column.

    ``fn`` returns output rows as tuples.  Output is flushed in batches so
    that a partition never sits in memory at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(at, rows_per_batch)
                rows = list(fn(*(c.to_pylist() for c in part.columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(v), type=f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
                    )

    return df.select(*columns).mapInArrow(tidied(run), schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches already sorted by the first ``n_keys`` columns.

    The open last group of a batch is carried into the next one, so memory
    follows the largest group, which callers bound.
    """
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(i)[row].as_py() for i in range(n_keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        if held and key(batch, 0) == last and key(held[-1], held[-1].num_rows - 1) == last:
            held.append(batch)
            continue
        # first row of the last group in this batch, by bisection: rows are sorted
        low, high = 0, batch.num_rows - 1
        while low < high:
            mid = (low + high) // 2
            if key(batch, mid) == last:
                high = mid
            else:
                low = mid + 1
        held.append(batch.slice(0, low))
        done = pa.Table.from_batches([b for b in held if b.num_rows] or [batch.slice(0, 0)])
        if done.num_rows:
            yield done
        held = [batch.slice(low)]
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches([b for b in held if b.num_rows])


#: Hubs that a round may broadcast, 16 bytes each, edges of a hub at least, and edges that may all meet in one task.
HUBS, LEAST_DEGREE, FEW = 500_000, 256, 16_384


def _met(edges: DataFrame, least: DataFrame, degree: int) -> DataFrame:
    """``edges`` with ``m`` of their ``a`` from ``least(a, m, n)``; edges of hubs, n > ``degree`` > 0, aren't shuffled."""
    if not degree:
        return edges.join(least.select("a", "m"), "a")
    hubs = F.broadcast(least.where(F.col("n") > degree).select("a", "m"))  # at most the number of edges by ``degree``
    rest = least.where(F.col("n") <= degree).select("a", "m")
    return edges.join(hubs, "a", "left_anti").join(rest, "a").unionByName(edges.join(hubs, "a"))


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges ``(a, b)`` of a partition as stars around the least node of each of its components there."""
    ends = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    x, y = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while len(x):  # the larger of two roots goes below the smaller one; all nodes then point to their roots
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])


def _settled(e: DataFrame) -> bool:
    """Whether ``e(a, b)``, each once and a > b, are stars: no ``a`` has two of them or is a ``b``."""
    again = e.groupBy("a").count().where("count > 1").select("a")
    return again.unionByName(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is its least node.

    First each partition turns its own edges into stars.  Then alternates
    the large-star and small-star rewrites until the edges are stars around
    each component's least node.  A round is two joins of the edges with one
    minimum per node; edges never exceed their first number and nothing is
    gathered per node.  Nodes with so many edges that at most ``HUBS`` can
    exist, by the number of edges, get their minimum by broadcast, so a
    hub's edges stay where they lie.  Each round is written to shared
    storage and replaces the one before.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = materialise(e.mapInArrow(tidied(_stars), e.schema).distinct(), "edges")
    while not _settled(e):
        count = e.count()
        degree = max(LEAST_DEGREE, 2 * count // HUBS) if count > FEW else 0
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        # large star: every larger neighbour goes to the least of the neighbourhood
        large = _met(both.where("b > a"), least, degree).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # small star: smaller neighbours and the node itself go to the least
        small = _met(down, least, degree).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, e = e, materialise(small, "edges")
        discard(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
