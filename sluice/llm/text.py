"""Words, many texts at a time or one, bounded samples and small numeric fits."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


#: As above, but a line break stays one.
_SPLIT_LINES = _SPLIT[:10] + b"\n" + _SPLIT[11:]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes whose powers are kept: a stretch of whole words is hashed at once.
_STRETCH = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _STRETCH), _powers(_BASE_INVERSE, _STRETCH)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Tokens:
    """The lower-case words of many texts as flat arrays, without a Python object a word.

    Words are those of ``lower_words``.  ``hashes`` are 64-bit polynomial
    hashes of their bytes, taken from running sums.  Lines are numbered
    through all texts; ``line_at`` holds each line's first word and, at the
    end, the number of words.  Memory is some 40 times that of a stretch of
    64 KiB, or of the longest word, plus 50 bytes a word.
    """

    def __init__(self, texts: list[str | None]):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(encoded)
        plain = np.frombuffer(self.raw.translate(_SPLIT_LINES), np.uint8)
        edge = np.diff((plain > 32).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        #: byte positions of the words in ``raw``
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.flatnonzero(plain == 10)
        self.line_at = np.concatenate(([0], np.searchsorted(self.starts, breaks), [len(self.starts)]))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        #: where each text starts in ``raw``, and the number of its first line
        self.text_at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if texts else np.zeros(0, np.int64)
        self.first_line = np.searchsorted(breaks, self.text_at)
        self.plain = plain

    @cached_property
    def hashes(self) -> np.ndarray:
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + _STRETCH, "right")))
            n = int(self.ends[to - 1] - begin)
            up, down = (_UP, _DOWN) if n <= _STRETCH else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.plain[begin : begin + n] * up[:n], out=sums[1:])
            s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mixed(out)

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Code-point spans of the words, each counted from the start of its text."""
        starts, ends = self.starts, self.ends
        text = np.searchsorted(self.text_at, starts, "right") - 1
        base = self.text_at
        if len(self.raw) and np.frombuffer(self.raw, np.uint8).max() > 127:
            before = np.concatenate(([0], np.cumsum((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64)))
            starts, ends, base = before[starts], before[ends], before[base]
        return starts - base[text], ends - base[text]


def sequence_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each run of ``sizes`` values from ``starts`` on; runs follow one another and aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    return mixed(np.add.reduceat(values * _powers(base, int(sizes.max()))[place], starts) ^ sizes.astype(np.uint64))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 value per ``doc_id``: the majority of its rows, 1 on a tie; nulls don't count."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label"))


def first_by_hash(ids: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows, those whose ``doc_id`` hashes lowest: the same rows on every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
