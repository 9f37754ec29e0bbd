"""Benchmark decontamination by a generalised suffix automaton of the items' words.

The automaton holds every run of consecutive words of every item.  A
document's words are streamed through it, tracking the longest run that
ends at each word; where that reaches a window's length, the window's words
are hit, and the automaton's state says which items the window occurs in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialise, tidied, unused_name

WINDOW = 10
#: Words of items, reckoned from their bytes, that one automaton, and so one broadcast, may hold; more take more passes.
#: 200,000 words measure 187 MB in a worker and 8 MB broadcast, so this is at most 375 MB and 17 MB.
ITEM_WORDS = 400_000
#: Contaminated runs of more words, or covering more of a document, are cut out or drop it.
SPAN_LIMIT, COVER_LIMIT = 9, 0.5

# ASCII but for letters and digits parts words; A-Z is lower-cased; all beyond ASCII belongs to words.
_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


class Automaton:
    """Suffix automaton over several word sequences."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known: list[tuple[object, list[int]]] = []
        for item, said in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in said]
            if ids:
                known.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        self._mark(known)

    def _clone(self, p: int, w: int, q: int) -> int:
        """Split off of ``q`` the runs that are one word longer than state ``p``'s."""
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _mark(self, known: list[tuple[object, list[int]]]) -> None:
        """Which items own the window that ends in a state, and the short items that do."""
        k = self.window
        self.items: list[object] = [item for item, _ in known]
        full: dict[int, set[int]] = {}
        short: dict[int, tuple[int, set[int]]] = {}
        for number, (_, ids) in enumerate(known):
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= k:
                    full.setdefault(self._suffix(state, k), set()).add(number)
            if len(ids) < k:
                short.setdefault(self._suffix(state, len(ids)), (len(ids), set()))[1].add(number)
        self.full = {s: frozenset(v) for s, v in full.items()}
        #: per state the window state on its chain of suffixes, -1 for none
        self.at_window = [-1] * len(self.next)
        self.shorts: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= k:
                self.at_window[s] = s if self.length[up] < k else self.at_window[up]
            chain = list(self.shorts.get(up, ())) if up >= 0 else []
            if s in short:
                chain.append((short[s][0], frozenset(short[s][1])))
            if chain:
                self.shorts[s] = chain

    def _suffix(self, state: int, k: int) -> int:
        while self.link[state] >= 0 and self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def hits(self, said: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs [first, past last) of hit words, merged and in order, and the numbers of the items."""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        trans, link, length, at_window, shorts, k = self.next, self.link, self.length, self.at_window, self.shorts, self.window
        state = size = 0
        for i, w in enumerate(map(self.vocabulary.get, said)):
            if w is None:
                state = size = 0
                continue
            to = trans[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = trans[state].get(w)
                size = length[state]
                if to is None:
                    state = size = 0
                    continue
            state = to
            size += 1
            reach = 0
            if size >= k:
                reach = k
                found |= self.full[at_window[state]]
            if state in shorts:
                for n, owners in shorts[state]:
                    if n <= size:
                        found |= owners
                        reach = max(reach, n)
            if reach:
                first = i + 1 - reach
                # a later run may reach back over earlier ones
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append((first, i + 1))
        return runs, found


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of runs of words."""
    raw = text.encode("utf-8", "surrogatepass")
    solid = np.frombuffer(raw.translate(_SPLIT), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.astype(np.int8), [0])))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    starts, ends = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


def _sized(items: DataFrame, item_words: int, window: int) -> tuple[DataFrame, int]:
    """``(item_id, text, turn)`` and how many turns, so that the items of a turn have at most ``item_words`` words.

    An item of more than half as many is cut into stretches that overlap by
    all but one word of a window: each of its windows lies in one.
    """
    size = (F.floor(F.octet_length("text") / 2) + 1).cast("long")  # words are at least a byte and a gap
    rough = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    step = max(item_words // 2 - window, 1)

    def stretches(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            said = words(t)
            for at in range(0, max(1, len(said) - window + 1), step):
                yield i, b" ".join(said[at : at + step + window - 1]).decode("utf-8", "surrogatepass")

    long = rough.where(size > item_words // 2)
    kind = items.schema["item_id"].dataType.simpleString()
    cut_up = arrow_rows(long, ["item_id", "text"], f"item_id {kind}, text string", stretches, rows_per_batch=16)
    pieces = materialise(rough.where(size <= item_words // 2).unionByName(cut_up).withColumn("size", size), "items")
    turns = max(1, -(-int(pieces.agg(F.sum("size")).first()[0] or 0) // item_words))
    while True:
        turn = F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)).cast("int")
        dealt = pieces.withColumn("turn", turn)
        most = dealt.groupBy("turn").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= item_words or turns > pieces.count():
            return dealt.select("item_id", "text", "turn"), turns
        turns *= 2


def match(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    item_words: int = ITEM_WORDS,
    into: tuple[str, str, str] = ("word_runs", "items", "n_words"),
) -> DataFrame:
    """``docs`` with ``word_runs``, ``items`` and ``n_words`` as new columns.

    ``into`` names the new columns; columns of ``docs`` with these names are
    replaced.  ``word_runs`` are the hit words, [start, end), merged; ``items`` the ids
    of the items with an occurring window, sorted as strings.  An item of
    fewer words than ``window`` is one window; one without words is none.
    Null texts have no words.  A null item id is matched, not listed.  Items
    beyond ``item_words`` are dealt to several automata, a pass each, long
    ones in stretches; a repeated item counts once.
    """
    spark = docs.sparkSession
    rough, passes = _sized(items, item_words, window)
    fresh = (F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>"), F.lit(0).cast("long"))
    out = docs.drop(*into).withColumns(dict(zip(into, fresh, strict=True)))
    runs_name, items_name, words_name = into
    for turn in range(passes):
        texts = rough.where(F.col("turn") == turn).select("item_id", "text").collect()  # at most item_words words
        shared = spark.sparkContext.broadcast(Automaton(((r.item_id, words(r.text)) for r in texts), window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    where = {n: k for k, n in enumerate(piece.schema.names)}
                    all_runs, all_items, counts = [], [], []
                    old = zip(piece.column(where["text"]).to_pylist(), piece.column(where[runs_name]).to_pylist(), piece.column(where[items_name]).to_pylist(), strict=True)
                    for text, runs, said in old:
                        tokens = words(text)
                        new, found = automaton.hits(tokens)
                        counts.append(len(tokens))
                        all_runs.append([{"start": a, "end": b} for a, b in _merged([(r["start"], r["end"]) for r in runs], new)])
                        all_items.append(sorted({str(automaton.items[n]) for n in found if automaton.items[n] is not None} | set(said)))
                    columns = [piece.column(k) for k in range(piece.num_columns)]
                    for n, values in ((runs_name, all_runs), (items_name, all_items), (words_name, counts)):
                        columns[where[n]] = pa.array(values, type=piece.schema.field(n).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

        out = out.mapInArrow(tidied(run), out.schema)
        if turn + 1 < passes:
            out = materialise(out, "matched")
    return out


def _merged(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(old + new) if old else new:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)`` per row of ``docs``."""
    found = match(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate("word_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (hit > 0).alias("contaminated")
    )


def cut(text: str, runs: list[tuple[int, int]], n_words: int, span_limit: int = SPAN_LIMIT, cover_limit: float = COVER_LIMIT) -> str | None:
    """The text without runs of more than ``span_limit`` words; None if those cover over ``cover_limit`` of it.

    Shorter runs come from items shorter than a window, phrases that clean
    texts hold as well: they stay and don't count.
    """
    runs = [(a, b) for a, b in runs if b - a > span_limit]
    if not runs:
        return text
    if sum(b - a for a, b in runs) > cover_limit * n_words:
        return None
    out, done = [], 0
    for a, b in char_spans(text, runs):
        out.append(text[done:a])
        done = b
    return "".join([*out, text[done:]])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, span_limit: int = SPAN_LIMIT, cover_limit: float = COVER_LIMIT) -> DataFrame:
    """``docs`` without contaminated spans, and without documents that are mostly such; limits as in ``cut``.

    Null and empty texts stay, very long ones are read whole, repeated rows
    are judged alike, and without items nothing changes.  ``n_chars``, where
    there is one, follows a changed text.  Other columns stay, whatever
    their names.
    """
    names = docs.columns
    runs_name, items_name, count_name = (unused_name(names, n) for n in ("word_runs", "items", "n_words"))
    found = match(docs, items, window, into=(runs_name, items_name, count_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(runs_name).to_pylist()
            if not any(runs):
                yield batch.select(names)
                continue
            counts, old = batch.column(count_name).to_pylist(), batch.column("text").to_pylist()
            texts = [cut(t, [(r["start"], r["end"]) for r in rs], n, span_limit, cover_limit) if rs else t for t, rs, n in zip(old, runs, counts, strict=True)]
            keep = [t is not None or not rs for t, rs in zip(texts, runs, strict=True)]
            columns = dict(zip(names, batch.select(names).columns, strict=True))
            columns["text"] = pa.array(texts, type=batch.schema.field("text").type)
            if "n_chars" in names:
                sizes = [s if t == o else t and len(t) for s, t, o in zip(columns["n_chars"].to_pylist(), texts, old, strict=True)]
                columns["n_chars"] = pa.array(sizes, type=batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(keep))

    return found.mapInArrow(tidied(run), docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
