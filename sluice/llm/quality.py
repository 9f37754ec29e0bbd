"""Document quality by co-training a text-content and a page-metadata classifier.

Each view has its own logistic regression.  Over a few rounds a classifier
labels the unlabelled documents it is surest of, and the other learns from
them.  At the end both are calibrated on held-out labels and their
log-odds are averaged with weights fitted on the same labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialise, tidied, without
from .text import first_by_hash, logistic, one_label, sigmoid

#: Labelled documents that the fit reads at most, and word shapes, or languages and sources, that a view keeps (its size).
LABELLED, SHAPES = 8_000, 96
#: Rounds, Newton steps of a round, share of the unlabelled rows that each round adds, and the least probability of a pseudo-label.
ROUNDS, STEPS, ADDED, SURE = 3, 2, 0.1, 0.9
#: Weight of all pseudo-labels against the labels at most, bins of log-odds and their range, and groups of tasks that sums are merged in.
PSEUDO, BINS, ODDS, GROUPS = 8.0, 2048, 32.0, 16

# Letters to their case, digits to 0, beyond ASCII to a letter: the shape of a word.
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_REPEAT = re.compile(rb"(.)\1+", re.DOTALL)
CONTENT = 9
METADATA = 8


def content_view(text: str | None) -> tuple[list[float], dict[int, float]]:
    """Measures of the wording, and the share of the words that has each shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * CONTENT, {}
    said = Counter(words)
    shaped = raw.translate(_SHAPE)
    shapes: Counter[bytes] = Counter()
    for s, c in Counter(shaped.split()).items():
        shapes[_REPEAT.sub(rb"\1", s)] += c
    letters, capitals, digits = shaped.count(b"a"), shaped.count(b"A"), shaped.count(b"0")
    solid = sum(map(len, words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    measures = [
        np.log1p(n),
        len(said) / n,
        np.log(len(said)) / np.log(n + 1),
        said.most_common(1)[0][1] / n,
        again / n,
        capitals / solid,
        digits / solid,
        (solid - letters - capitals - digits) / solid,
        solid / n,
    ]
    return [float(v) for v in measures], {xxhash.xxh64_intdigest(s): c / n for s, c in shapes.items()}


def metadata_view(text: str | None, lang: str | None, source: str | None) -> tuple[list[float], list[str]]:
    """Measures of the page's size and layout, and its language and source as keys."""
    t = text or ""
    lines = t.split("\n")
    lengths = np.array([len(x) for x in lines], float)
    measures = [
        np.log1p(len(t)),
        np.log1p(len(lines)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.max()),
        float((lengths < 40).mean()),
        t.count("|") / len(lines),
        t.count(" ") / max(len(t), 1),
        len(t.encode("utf-8", "surrogatepass")) / max(len(t), 1),
    ]
    return [float(v) for v in measures], [f"lang={lang}", f"source={source}"]


@dataclass
class View:
    """A standardised logistic regression over dense measures and keyed ones."""

    keys: dict
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: slope and offset that calibrate the log-odds
    platt: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def over(cls, dense: list, keyed: list, keep: int) -> View:
        seen = Counter(k for ks in keyed for k in ks)
        keys = {k: i for i, (k, c) in enumerate(seen.most_common(keep)) if c >= 3}
        made = cls(keys, np.zeros(0), np.ones(0))
        x = made.raw(dense, keyed)
        made.mean, made.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        return made

    def raw(self, dense: list, keyed: list) -> np.ndarray:
        x = np.zeros((len(dense), len(dense[0]) + len(self.keys)))
        x[:, : len(dense[0])] = dense
        for row, ks in enumerate(keyed):
            for k in ks:
                if (at := self.keys.get(k)) is not None:
                    x[row, len(dense[0]) + at] = ks[k] if isinstance(ks, dict) else 1.0
        return x

    def matrix(self, dense: list, keyed: list) -> np.ndarray:
        return np.clip((self.raw(dense, keyed) - self.mean) / self.scale, -8, 8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] * (x @ self.weights[:-1] + self.weights[-1]) + self.platt[1]


@dataclass
class Quality:
    content: View | None
    metadata: View | None
    #: weights of the two views' log-odds, and an offset
    mix: tuple[float, float, float] = (0.5, 0.5, 0.0)
    prior: float = 1.0

    def score(self, texts: list, langs: list, sources: list) -> np.ndarray:
        """Probability of good quality."""
        if self.content is None or not texts:
            return np.full(len(texts), self.prior)
        a = self.content.matrix(*map(list, zip(*map(content_view, texts), strict=True)))
        b = self.metadata.matrix(*map(list, zip(*map(metadata_view, texts, langs, sources), strict=True)))
        return sigmoid(self.mix[0] * self.content.log_odds(a) + self.mix[1] * self.metadata.log_odds(b) + self.mix[2])


class Pool:
    """Unlabelled rows of both views, held as matrices; ``SparkPool`` has the same two sums over tables."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.views = (a, b)

    def histograms(self, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Per view, how many rows have which log-odds."""
        return np.stack([binned(x, w) for x, w in zip(self.views, weights, strict=True)])

    def sums(self, weights, bounds) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per view, gradient and curvature over the rows that the other view is sure of, and their number."""
        return pseudo_sums(*self.views, weights, bounds)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def binned(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    at = np.clip((x @ w[:-1] + w[-1] + ODDS) * (BINS / (2 * ODDS)), 0, BINS - 1).astype(np.int64)
    return np.bincount(at, minlength=BINS)


def pseudo_sums(a: np.ndarray, b: np.ndarray, weights, bounds) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``weights`` are (pupil, teacher) of both views; a teacher's ``bounds`` are the log-odds it is sure from."""
    out = []
    for (pupil, _), (_, teacher), (low, high), own, other in ((weights[0], weights[1], bounds[1], a, b), (weights[1], weights[0], bounds[0], b, a)):
        said = other @ teacher[:-1] + teacher[-1]
        sure = (said <= low) | (said >= high)
        x, y = with_one(own[sure]), (said[sure] >= high).astype(float)
        p = sigmoid(x @ pupil)
        out.append((x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x, int(sure.sum())))
    return out


def sure_bounds(histogram: np.ndarray, share: float, part: float, sure: float) -> tuple[float, float]:
    """Log-odds up to which and from which a view labels: the surest ``part`` of all rows, in the classes' shares."""
    n, least = histogram.sum(), np.log(sure / (1 - sure))
    edges = np.linspace(-ODDS, ODDS, BINS + 1)
    below, above = np.cumsum(histogram), np.cumsum(histogram[::-1])
    k, m = np.searchsorted(below, part * (1 - share) * n, "right"), np.searchsorted(above, part * share * n, "right")
    return min(float(edges[k]), -least), max(float(edges[BINS - m]), least)


def log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w[:-1] + w[-1]))))


def co_train(
    a: np.ndarray, b: np.ndarray, y: np.ndarray, pool=None, judge=None, rounds: int = ROUNDS, added: float = ADDED, sure: float = SURE
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights of both views, and how many pseudo-labels each learnt from per round.

    ``y`` is 1 or 0, or -1 for rows that make the pool unless one is given.
    In round r each view labels, of the pool's rows that it is at least
    ``sure`` of, at most r x ``added`` in the labelled classes' proportions,
    and the other view learns from those, which together weigh at most
    ``PSEUDO`` times the labelled rows.  With ``judge``, labelled rows
    ``(a, b, y)`` that nothing was fitted on, a view keeps what it learnt in
    a round only if its loss on them doesn't rise: a weak teacher can't
    spoil a strong pupil.  The pool is only ever summed over.
    """
    known = y >= 0
    pool = pool or Pool(a[~known], b[~known])
    views, y = (a[known], b[known]), y[known]
    one, share, log = np.ones(len(y)), y.mean(), []
    weights = [logistic(x, y, one) for x in views]
    for r in range(1, rounds + 1):
        bounds = [sure_bounds(h, share, min(1.0, r * added), sure) for h in pool.histograms(tuple(weights))]
        teachers, pupils = list(weights), list(weights)
        for _ in range(STEPS):
            found = pool.sums(list(zip(pupils, teachers, strict=True)), bounds)
            for v, (gradient, curve, n) in enumerate(found):
                w, x = pupils[v], with_one(views[v])
                scale = min(0.5, PSEUDO * len(y) / max(n, 1))
                p, penalty = sigmoid(x @ w), np.append(np.ones(len(w) - 1), 1e-6)
                slope = x.T @ (p - y) + penalty * w + scale * gradient
                bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty) + scale * curve
                step = np.linalg.solve(bend, slope)
                pupils[v] = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        log.append((found[0][2], found[1][2]))
        for v, w in enumerate(pupils):
            if judge is None or log_loss(judge[v], judge[2], w) <= log_loss(judge[v], judge[2], weights[v]):
                weights[v] = w
    return weights[0], weights[1], log


class SparkPool:
    """The same sums over a table of packed views, ``(a binary, b binary)``, of as many columns each."""

    def __init__(self, rows: DataFrame, widths: tuple[int, int]):
        self.rows, self.widths = rows, widths

    def _over(self, size: int, fn) -> np.ndarray:
        """The sum of ``fn(a, b)``, a vector of ``size``, over batches of rows: per task, per group of tasks, in all."""
        widths = self.widths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += fn(*(np.frombuffer(b"".join(c.to_pylist()), "<f4").reshape(-1, w).astype(float) for c, w in zip(batch.columns, widths, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    total += np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

        parts = self.rows.mapInArrow(tidied(run), "sums binary").repartition(GROUPS).mapInArrow(tidied(merge), "sums binary")
        return np.sum([np.frombuffer(r["sums"]) for r in parts.collect()], axis=0)  # GROUPS vectors

    def histograms(self, weights) -> np.ndarray:
        return self._over(2 * BINS, lambda a, b: np.concatenate([binned(a, weights[0]), binned(b, weights[1])])).reshape(2, BINS)

    def sums(self, weights, bounds) -> list[tuple[np.ndarray, np.ndarray, int]]:
        n, m = (w + 1 for w in self.widths)

        def flat(a, b):
            (g, h, k), (i, j, o) = pseudo_sums(a, b, weights, bounds)
            return np.concatenate([g, h.ravel(), [k], i, j.ravel(), [o]])

        v = self._over(n + n * n + 1 + m + m * m + 1, flat)
        w = v[n + n * n + 1 :]
        return [(v[:n], v[n : n + n * n].reshape(n, n), int(v[n + n * n])), (w[:m], w[m : m + m * m].reshape(m, m), int(w[-1]))]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Quality:
    """Co-train on at most ``labelled`` labelled documents, chosen by hash, and on all that have no label.

    Measures of the labelled ones, not their texts, come to the driver; the
    unlabelled ones are only summed over, in Spark.  Repeated ids count as
    one row, labels without a document not at all.  Without both classes
    among the labels every document scores 1.
    """
    known = one_label(labels, "quality").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = materialise(first_by_hash(known, labelled), "chosen-labels")
    read = _columns(docs).join(F.broadcast(chosen), "doc_id")  # at most ``labelled`` ids
    # of rows that repeat an id the least counts, so that copies can't crowd others out
    read = read.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang", "source")).alias("row")).select("doc_id", "label", "row.*")

    def rows(ids, label, texts, langs, sources):
        for i, y, t, g, s in zip(ids, label, texts, langs, sources, strict=True):
            dense, shapes = content_view(t)
            layout, keys = metadata_view(t, g, s)
            yield xxhash.xxh64_intdigest(str(i)) % 5, y, dense, list(shapes), list(shapes.values()), layout, keys

    schema = "fold int, label int, dense array<double>, shapes array<decimal(20,0)>, shares array<double>, layout array<double>, keys array<string>"
    got = arrow_rows(read, ["doc_id", "label", "text", "lang", "source"], schema, rows).collect()  # at most ``labelled`` rows
    y = np.array([r["label"] for r in got], np.int64)
    fold = np.array([r["fold"] for r in got], np.int64)
    held = fold == 0
    if not all(((y == c) & ~held).any() for c in (0, 1)):
        return Quality(None, None)
    dense, layout = [r["dense"] for r in got], [r["layout"] for r in got]
    shapes = [{int(k): v for k, v in zip(r["shapes"], r["shares"], strict=True)} for r in got]
    keys = [r["keys"] for r in got]
    content, metadata = View.over(dense, shapes, SHAPES), View.over(layout, keys, SHAPES)
    a, b = content.matrix(dense, shapes), metadata.matrix(layout, keys)
    free = without(_columns(docs.where("doc_id is not null")), labels.where("quality is not null"))
    pool = materialise(_packed(free, content, metadata), "views")
    content.weights, metadata.weights, _ = co_train(
        a[~held], b[~held], y[~held], SparkPool(pool, (a.shape[1], b.shape[1])), (a[held], b[held], y[held]) if held.any() else None
    )
    discard(pool)
    model = Quality(content, metadata)
    if all(((y == c) & held).any() for c in (0, 1)):
        one = np.ones(held.sum())
        for view, x in ((content, a), (metadata, b)):
            slope, offset = logistic(view.log_odds(x[held])[:, None], y[held], one, ridge=0.1)
            view.platt = (float(max(slope, 0.0)), float(offset))
        both = np.column_stack([content.log_odds(a[held]), metadata.log_odds(b[held])])
        w = logistic(both, y[held], one, ridge=0.5)
        model.mix = (float(max(w[0], 0)), float(max(w[1], 0)), float(w[2]))
    return model


def _packed(docs: DataFrame, content: View, metadata: View) -> DataFrame:
    """``(a, b)``: both views of each row as packed 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((content, metadata))  # a few hundred numbers

    def rows(texts, langs, sources):
        one, two = shared.value
        a = one.matrix(*map(list, zip(*map(content_view, texts), strict=True))).astype("<f4")
        b = two.matrix(*map(list, zip(*map(metadata_view, texts, langs, sources), strict=True))).astype("<f4")
        return ((x.tobytes(), y.tobytes()) for x, y in zip(a, b, strict=True))

    return arrow_rows(_columns(docs), ["text", "lang", "source"], "a binary, b binary", rows)


def _columns(docs: DataFrame) -> DataFrame:
    absent = [F.lit(None).cast("string").alias(c) for c in ("lang", "source") if c not in docs.columns]
    return docs.select("doc_id", "text", *[c for c in ("lang", "source") if c in docs.columns], *absent).select("doc_id", "text", "lang", "source")


def score(docs: DataFrame, model: Quality, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, quality, keep)`` for every row of ``docs``.

    ``quality`` is the combined probability, ``keep`` whether it reaches
    ``threshold``.  Null and empty texts have zero measures and score like
    any other; a null or unseen language or source carries no weight; very
    long texts count whole; rows that repeat an id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def rows(ids, texts, langs, sources):
        p = shared.value.score(texts, langs, sources)
        return zip(ids, p.tolist(), (p >= threshold).tolist(), strict=True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(_columns(docs), ["doc_id", "text", "lang", "source"], f"doc_id {kind}, quality double, keep boolean", rows)


def keep_good(docs: DataFrame, model: Quality, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that reach ``threshold``, each judged by itself, as ``score`` does.

    Rows that repeat an id, and rows without one, are judged by their own
    text; columns stay as they are, whatever their names; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                column = lambda c: part.column(c).to_pylist() if c in names else [None] * part.num_rows  # noqa: E731, B023
                p = shared.value.score(column("text"), column("lang"), column("source"))
                yield part.filter(pa.array(p >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
