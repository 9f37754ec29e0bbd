"""Stretches of words that repeat with a period, and texts without their repeats.

A run is a stretch of consecutive words of smallest period q, at least
``LEAST`` words and ``TIMES`` periods long, that can't be made longer on
either side.  Runs are found by the divide and conquer of Main and Lorentz:
words become numbers, a stretch of them is halved again and again, and
Z-functions at each midpoint tell which repetitions cross it.  A run
crosses the midpoints of many halvings and lies whole in the stretch of the
topmost one, where it is found; a repetition that goes on beyond its
stretch is left to a higher one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows
from .text import mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Least words and least number of periods of a run.
LEAST, TIMES = 6, 4
#: Words of texts that are looked at together, so that arrays stay small.
TOGETHER = 1 << 18

Run = tuple[int, int, int]  # start, length, period


def z_function(s: Sequence[int]) -> list[int]:
    """For each place how many items from there on equal those from the start on, in linear time."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(u: list[int], v: list[int], periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """Repetitions over the border of ``u`` and ``v`` that have two periods in ``v``: (words in u, words in v, period)."""
    far = periods[-1]
    ahead = z_function(v)
    # u and the first words of v, both read backwards: how far the words before v[q] are those before v[0]
    back = u[::-1]
    behind = z_function([*back, -1, *v[far - 1 :: -1], *back])
    for q in periods:
        if ahead[q] >= q:
            yield min(behind[len(u) + 1 + far - q], len(u)), q + ahead[q], q


def _midpoints(ids: np.ndarray, bounds: np.ndarray, half: int, sums: np.ndarray, powers: np.ndarray) -> Iterator[tuple[int, int, int, int, list[int], list[int]]]:
    """Midpoints of one halving where squares of words begin or end: (low, mid, high, text, periods after, periods before).

    Most midpoints of most texts have none; one pass over all texts finds
    the others: the first word must come again q words later, then the hash
    of q words must, on the side that holds two periods.
    """
    n = len(ids)
    mids = np.arange(half, n, 2 * half)
    text = np.searchsorted(bounds, mids, "right") - 1
    low = np.maximum(mids - half, bounds[text])
    high = np.minimum(mids + half, bounds[text + 1])
    reach = max(half // 2, 1)
    padded = np.concatenate((np.full(reach, -1, ids.dtype), ids, np.full(2 * half + reach, -2, ids.dtype)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for side in (1, -1):
        first = mids if side == 1 else mids - 1
        row, period = [], []
        for at in range(0, len(mids), max(1, (1 << 20) // reach)):
            part = slice(at, at + max(1, (1 << 20) // reach))
            near = np.arange(1, reach + 1) * side
            r, c = np.nonzero(padded[first[part, None] + near + reach] == ids[first[part]][:, None])
            row.append(r + at)
            period.append(c + 1)
        r, q = np.concatenate(row), np.concatenate(period)
        fits = (TIMES * q <= high[r] - low[r]) & (2 * q <= (high[r] - mids[r] if side == 1 else mids[r] - low[r]))
        r, q = r[fits], q[fits]
        begin = mids[r] if side == 1 else mids[r] - 2 * q
        same = (sums[begin + q] - sums[begin]) * powers[q] == sums[begin + 2 * q] - sums[begin + q]
        found.append((r[same], q[same]))
    rows = np.union1d(found[0][0], found[1][0])
    spans = [(np.searchsorted(r, rows), np.searchsorted(r, rows, "right"), q) for r, q in found]
    for k, r in enumerate(rows.tolist()):
        after, before = (q[a[k] : b[k]].tolist() for a, b, q in spans)
        yield int(low[r]), int(mids[r]), int(high[r]), int(text[r]), after, before


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text, given as the numbers of its words, by start, then period."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    n = int(bounds[-1])
    if n >= LEAST:
        ids = np.concatenate(texts).astype(np.int64)
        powers = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * powers[:n])))
        # no text of fewer words than a run; empty ones would hide the one a midpoint lies in
        held = np.flatnonzero(np.diff(bounds))
        starts = np.append(bounds[held], n)
        half = 4  # a stretch of 2 * half words; shorter ones hold no run
        while half < n:
            for low, mid, high, text, after, before in _midpoints(ids, starts, half, sums, powers):
                first, last = int(starts[text]), int(starts[text + 1])
                left, right = ids[low:mid].tolist(), ids[mid:high].tolist()
                crossing = [(mid - x, mid + y, q) for x, y, q in _crossing(left, right, after)] if after else []
                if before:  # the same, read backwards
                    crossing += [(mid - y, mid + x, q) for x, y, q in _crossing(right[::-1], left[::-1], before)]
                for start, end, q in crossing:
                    more = (start == low > first and ids[start - 1] == ids[start - 1 + q]) or (end == high < last and ids[end] == ids[end - q])
                    if end - start >= max(LEAST, TIMES * q) and not more:
                        own = found[held[text]]
                        own[start - first, end - start] = min(q, own.get((start - first, end - start), q))
            half *= 2
    return [sorted((s, length, q) for (s, length), q in own.items()) for own in found]


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds beyond its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def runs(docs: DataFrame, id_col: str = "doc_id", rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, runs, collapsed)``.

    Words are stretches without blanks; ``runs`` are ``(start, length,
    period)`` in words by start, then period; ``collapsed`` is the text's
    words joined by one space without those that a run repeats.
    ``rewrite(id, n)`` may give the numbers of the words to read instead,
    for each of the n places, or None for the text as it is.

    Null and empty texts have no words and no runs, and collapse to the
    empty string; repeated rows are answered each; a null id stays null;
    other columns are not read.  Texts are worked on row by row in tasks,
    about ``TOGETHER`` words at a time, in n log n time whatever the words.
    """

    def rows(ids, texts):
        waiting: list[tuple[object, list[str], np.ndarray]] = []
        numbers: dict[str, int] = {}
        size = 0

        def answer():
            for (i, words, _), own in zip(waiting, runs_of([w[2] for w in waiting]), strict=True):
                stays = kept(len(words), own)
                left = words if stays.all() else [words[k] for k in np.flatnonzero(stays).tolist()]
                yield i, len(words), [{"start": s, "length": n, "period": q} for s, n, q in own], " ".join(left)

        for i, t in zip(ids, texts, strict=True):
            words = WORD.findall(t or "")
            order = rewrite(i, len(words)) if rewrite else None
            if order is not None:
                words = [words[k] for k in order.tolist()]
            waiting.append((i, words, np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)))
            size += len(words)
            if size >= TOGETHER:
                yield from answer()
                waiting, numbers, size = [], {}, 0
        yield from answer()

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return arrow_rows(docs, [id_col, "text"], schema, rows)


def collapse(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` with every run cut down to its first period."""
    return runs(docs, id_col).selectExpr(id_col, "collapsed as text")
