"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents become token ids plus an end id; one longer than a sequence is
cut into whole sequences and a rest.  The histogram of piece lengths, in
classes of ``UNIT`` tokens, is a cutting-stock instance whose size depends
on the sequence length alone.  A linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation: the
simplex multipliers price the classes and an unbounded-knapsack dynamic
program finds the best new pattern.  Rounded-down patterns plus a
first-fit packing of the few pieces left over are then dealt to the pieces
of each class in the order of their ranks.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialise

SEQUENCE = 2048
UNIT = 8
END_ID = 1
#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches of white space, or of anything else, that the fast encoder is spared.
LONG_RUN = re.compile(r"\s{2000}|\S{20000}")
#: Pieces of one class and salt that a single task ranks, on average.
RANKED_TOGETHER, LEAST_SALTS = 20_000, 64

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    ``path`` is a tokenizer file of the ``tokenizers`` library holding a
    byte-level BPE whose ids follow its merge order.  Its vocabulary is
    loaded by that library; the merging itself runs in ``tiktoken``, which
    gives the same ids several times as fast.  Its pattern matcher fails on
    very long stretches of white space and its merging is slow on very long
    words, so a text with such a stretch is encoded by ``tokenizers``.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer, pre_tokenizers

        loaded = Tokenizer.from_file(path)
        special = {t.content: i for i, t in loaded.get_added_tokens_decoder().items()}
        of_char = _byte_of_char()
        assert set(of_char) == set(pre_tokenizers.ByteLevel.alphabet()), "not a byte-level vocabulary"
        ranks = {bytes(map(of_char.__getitem__, t)): i for t, i in loaded.get_vocab(False).items() if t not in special}
        self._merger = Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special, self._loaded = set(special), loaded

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if LONG_RUN.search(text):
            return np.array(self._loaded.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = array("I", self._merger.encode(text, allowed_special=self._special, disallowed_special=()))
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``: each id lies in one piece.

    ``with_ids`` adds the token ids themselves.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def rows(ids, texts):
        encoder = Encoder.at(tokenizer)
        for doc, text in zip(ids, texts, strict=True):
            tokens = encoder.encode(text) + end
            n = len(tokens) // 4
            for start in range(0, n, size):
                part = tokens[4 * start : 4 * (start + size)]
                row = (doc, start, len(part) // 4, zlib.crc32(part), n)
                yield (*row, np.frombuffer(part, "<u4").tolist()) if with_ids else row

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return arrow_rows(docs, ["doc_id", "text"], schema, rows, rows_per_batch=1024)


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits: unbounded knapsack over classes 1..len(prices)."""
    n = len(prices)
    value, took = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for room in range(1, n + 1):
        worth = prices[:room] + value[room - 1 :: -1][:room]
        best = int(np.argmax(worth))
        if worth[best] > value[room - 1]:
            value[room], took[room] = worth[best], best + 1
        else:
            value[room], took[room] = value[room - 1], 0
    pattern, room = np.zeros(n, np.int64), n
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= int(took[room])
        else:
            room -= 1
    return float(value[n]), pattern


def cutting_stock(demand: np.ndarray, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns with multiplicities that cover ``demand`` (pieces of classes 1..len(demand)).

    A pattern's classes sum to at most len(demand).  The linear program's
    optimum is rounded down; what that leaves, at most a pattern's worth for
    each class, goes by first-fit decreasing.
    """
    n = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    basis = np.zeros((len(used), len(used)))
    columns = []
    for k, c in enumerate(used):
        pattern = np.zeros(n, np.int64)
        pattern[c] = n // (c + 1)
        columns.append(pattern)
        basis[k, k] = pattern[c]
    need = demand[used].astype(float)
    inverse = np.linalg.inv(basis)
    amount = inverse @ need
    for turn in range(rounds):
        prices = np.zeros(n)
        prices[used] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(prices)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ pattern[used]
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        columns[out] = pattern
        basis[:, out] = pattern[used]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        inverse[out] /= direction[out]
        others = np.arange(len(used)) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        if turn % 100 == 99:  # rounding errors of the updates
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ need, 0)
    plan, left = [], demand.astype(np.int64).copy()
    for pattern, x in zip(columns, amount, strict=True):
        times = int(np.floor(x + 1e-9))
        fits = [left[c] // pattern[c] for c in np.flatnonzero(pattern)]
        times = min([times, *fits])
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern, room = np.zeros(n, np.int64), n
        for c in range(n - 1, -1, -1):
            take = min(int(left[c]), room // (c + 1))
            if take:
                pattern[c] = take
                room -= take * (c + 1)
        fits = [left[c] // pattern[c] for c in np.flatnonzero(pattern)]
        plan.append((pattern, int(min(fits))))
        left -= plan[-1][1] * pattern
    return plan


def slots(plan: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """For each class rows (first rank, pieces a sequence, first sequence) by rank."""
    found: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern).tolist():
            rank, each = taken.get(c, 0), int(pattern[c])
            found.setdefault(c + 1, []).append((rank, each, sequence))
            taken[c] = rank + each * times
        sequence += times
    return {c: np.array(v, np.int64) for c, v in found.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """Pieces of all rows of ``docs`` with their place: adds ``sequence_id`` and ``offset``.

    Null and empty texts hold the end id alone; very long ones are cut into
    as many pieces as they fill.  Repeated rows are packed
    each.  Pieces of a class rank by a hash of their document and start, so
    equal tables pack equally.  An empty table gives no rows.  Only
    ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, size), "pieces").withColumn(
        "class", F.ceil(F.col("length") / unit).cast("int")
    )
    classes = -(-size // unit)
    demand = np.zeros(classes, np.int64)
    for row in cut.groupBy("class").count().collect():  # at most size / unit rows
        demand[row["class"] - 1] = row["count"]
    by_class = spark.sparkContext.broadcast(slots(cutting_stock(demand)))  # follows size / unit, not the data

    # Ranks in a class: within (class, salt), then shifted by the salts before.
    salts = max(LEAST_SALTS, -(-int(demand.sum()) // RANKED_TOGETHER))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        salted.groupBy("class", "salt").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ).drop("count")
    own = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(shift, ["class", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("shift"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(c), np.int64)
            for k in np.unique(c):
                rows, at = by_class.value[int(k)], np.flatnonzero(c == k)
                slot = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[slot, 2] + (rank[at] - rows[slot, 0]) // rows[slot, 1]
            columns = [batch.column(k) for k in (*kept, "rank")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence)], names=[*kept, "rank", "sequence_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.select("class", "rank", *kept).mapInArrow(
        place,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, sequence_id long",
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank", "doc_id", "start")
    filled = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("offset", filled - F.col("length")).select(*kept, "sequence_id", "offset")
