"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are grams: whole words, runs of four to six characters inside a
word or across its edge, and longer beginnings of words; these also find
words built from a telling stem.
Grades run from 0 (not toxic) upwards.  The model shares one weight vector
across ordered thresholds: P(grade > k) = sigmoid(w.x - t_k).  It gives an
expected severity, the sum of those probabilities.

Labels say toxic or not.  Toxic examples are graded by how many of their
words hold a telling gram (one much likelier in toxic examples), split at
even shares.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialise
from .text import first_by_hash, lower_words, one_label, sigmoid

#: Labelled rows that the fit reads at most, grams it keeps (the model's size), and grades above zero.
SAMPLE, FEATURES, GRADES = 10_000, 1024, 3
#: Lengths of inner grams and of beginnings, the longest whole word, and the least likelihood ratio that counts:
#: one gram in 600 reaches it by chance, which the ridge then holds down.
LENGTHS, BEGINNINGS, LONGEST, LEAST_RATIO, RIDGE = (4, 5, 6), (7, 8, 9, 10), 24, 10.0, 5e-4


def padded(text: str | None) -> tuple[str, int]:
    """Lower-case words with a space on either side of each, and their number."""
    words = lower_words(text)
    return " ".join(["", *[w.decode("utf-8", "replace") for w in words], ""]), len(words)


def grams(word: str) -> set[str]:
    edged = f" {word} "
    found = {edged[i : i + n] for n in LENGTHS for i in range(len(edged) - n + 1)}
    found |= {edged[:n] for n in BEGINNINGS if n < len(edged)}
    if len(edged) <= LONGEST + 2:
        found.add(edged)
    return found


class Finder:
    """Counts of the chosen grams in a text, by one pass of an Aho-Corasick automaton."""

    def __init__(self, chosen: list[str]):
        self.automaton = ahocorasick.Automaton()
        for k, gram in enumerate(chosen):
            self.automaton.add_word(gram, k)
        if chosen:
            self.automaton.make_automaton()
        self.any = bool(chosen)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the grams that occur, how often, and the number of words."""
        said, n = padded(text)
        found = Counter(k for _, k in self.automaton.iter(said)) if self.any else Counter()
        return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)), n


def feature_value(counts: np.ndarray, n: int) -> np.ndarray:
    """Presence, and more for a gram that is dense in its text."""
    return 1 + np.log1p(100 * counts / max(n, 1))


@dataclass
class Severity:
    """A fitted model: grams with a weight each, and thresholds in order."""

    grams: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    #: least P(grade > 0) that is called toxic
    cutoff: float = 0.5

    def margins(self, texts: list) -> np.ndarray:
        finder = Finder(self.grams)
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            which, counts, n = finder.counts(t)
            out[k] = self.weights[which] @ feature_value(counts, n)
        return out

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return sigmoid(np.asarray(margin, float)[:, None] - self.thresholds[None, :])


class Rows:
    """Sparse rows: feature numbers and values, with row starts."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        sizes = np.array([len(i) for i, _ in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], self.width)


def fit_ordinal(x: Rows, grade: np.ndarray, grades: int, ridge: float = RIDGE, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the whole sample.

    Thresholds are a first one plus positive gaps, so they stay in order.
    """
    share = [max(np.mean(grade > k), 1e-3) for k in range(grades)]
    start = np.array([np.log((1 - s) / s) for s in share])
    parameters = np.concatenate([np.zeros(x.width), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    rows = np.arange(x.n)
    for t in range(1, steps + 1):
        w, raw = parameters[: x.width], parameters[x.width :]
        gaps = np.exp(raw[1:])
        thresholds = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        above = sigmoid(x.times(w)[:, None] - thresholds[None, :])
        upper = np.column_stack([np.ones(x.n), above, np.zeros(x.n)])
        p = np.maximum(upper[rows, grade] - upper[rows, grade + 1], 1e-9)
        slope = np.column_stack([np.zeros(x.n), above * (1 - above), np.zeros(x.n)])
        low, high = slope[rows, grade] / p, slope[rows, grade + 1] / p
        by_margin = -(low - high) / x.n
        by_threshold = np.zeros(grades)
        np.add.at(by_threshold, grade[grade > 0] - 1, low[grade > 0] / x.n)
        np.add.at(by_threshold, grade[grade < grades], -high[grade < grades] / x.n)
        by_raw = np.concatenate([[by_threshold.sum()], [by_threshold[k + 1 :].sum() * gaps[k] for k in range(grades - 1)]])
        gradient = np.concatenate([x.transposed_times(by_margin) + ridge * w, by_raw])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters = parameters - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    w, raw = parameters[: x.width], parameters[x.width :]
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def likelihood_ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Dunning's statistic of the 2x2 table of a gram's documents."""
    share = (toxic + clean) / F.lit(float(n_toxic + n_clean))

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

    return 2 * (
        part(toxic, n_toxic * share) + part(clean, n_clean * share)
        + part(n_toxic - toxic, n_toxic * (1 - share)) + part(n_clean - clean, n_clean * (1 - share))
    )


def without_echoes(best: list) -> list:
    """Of grams that hold one another and occur in as many documents, the first."""
    kept: list = []
    alike: dict[tuple[int, int], list[str]] = {}
    for r in best:
        same = alike.setdefault((r["toxic"], r["clean"]), [])
        if not any(g.strip() in r["gram"] or r["gram"].strip() in g for g in same):
            same.append(r["gram"])
            kept.append(r)
    return kept


#: Parts that the cutoff is found by: each is scored by a fit on the others.
FOLDS = 2


def held_out_cutoff(table: list, grade: np.ndarray, fold: np.ndarray, width: int, grades: int, false_alarms: float = 0.002) -> float:
    """The least probability that calls at most ``false_alarms`` of held-out clean examples toxic.

    Each fold is scored by a fit on the others; kept between 0.03 and 0.5.
    """
    p = np.zeros(len(table))
    for k in np.unique(fold).tolist():
        own, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if not ((grade[other] > 0).any() and (grade[other] == 0).any()):
            return 0.5
        w, thresholds = fit_ordinal(Rows([table[k] for k in other], width), grade[other], grades)
        p[own] = sigmoid(Rows([table[k] for k in own], width).times(w) - thresholds[0])
    return float(np.clip(np.quantile(p[grade == 0], 1 - false_alarms), 0.03, 0.5))


def choose_grams(sample: DataFrame, features: int) -> tuple[list[str], list[bool]]:
    """The grams that tell the classes apart best, and which of them speak for toxicity."""

    def rows(labels, texts):
        seen = (Counter(), Counter())
        for y, t in zip(labels, texts, strict=True):
            own: set[str] = set()
            for w in set(lower_words(t)):
                own |= grams(w.decode("utf-8", "replace"))
            seen[y].update(own)
        for g in seen[0].keys() | seen[1].keys():
            yield g, seen[1][g], seen[0][g]

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return [], []
    counted = arrow_rows(sample, ["label", "text"], "gram string, toxic long, clean long", rows, rows_per_batch=512)
    counted = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.where("toxic + clean >= 3").withColumn("ratio", likelihood_ratio(F.col("toxic"), F.col("clean"), n[1], n[0]))
    best = counted.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "gram").limit(8 * features).collect()
    best = without_echoes(best)[:features]
    telling = [(r["toxic"] + 0.5) / n[1] > 4 * (r["clean"] + 0.5) / n[0] for r in best]
    return [r["gram"] for r in best], telling


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, grades: int = GRADES) -> Severity:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of their ids.

    Equal texts of the sample count once, with the majority of their labels,
    toxic on a tie.  Repeated ids are one label and one text, the least of
    theirs; labels without a document don't count.  Counts of the chosen grams, not
    texts, come to the driver.  Without both classes in the sample, or a
    gram that tells them apart, the model calls nothing toxic.
    """
    known = one_label(labels, "toxic").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = materialise(first_by_hash(known, sample), "chosen-labels")
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    read = read.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # and as many texts
    read = read.groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    read = materialise(read.select("label", "text"), "labelled")
    best, telling = choose_grams(read, features)
    if not best:
        return Severity([], np.zeros(0), np.full(grades, 30.0))

    def rows(label, texts):
        finder = Finder(best)
        for y, t in zip(label, texts, strict=True):
            which, counts, n = finder.counts(t)
            yield y, which.tolist(), counts.tolist(), n, int.from_bytes(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()[:7], "big")

    got = arrow_rows(read, ["label", "text"], "label int, which array<long>, counts array<long>, n long, digest long", rows).collect()
    got.sort(key=lambda r: r["digest"])  # neither folds nor sums follow the order of arrival
    y = np.array([r["label"] for r in got], np.int64)
    speaks = np.array(telling)
    table, density = [], np.zeros(len(got))
    for i, r in enumerate(got):
        which, counts = np.array(r["which"], np.int64), np.array(r["counts"], np.int64)
        table.append((which, feature_value(counts, r["n"])))
        density[i] = counts[speaks[which]].sum() / max(r["n"], 1)
    grade = np.zeros(len(got), np.int64)
    edges = np.quantile(density[y == 1], np.arange(1, grades) / grades)
    grade[y == 1] = 1 + np.searchsorted(edges, density[y == 1], side="right")
    w, thresholds = fit_ordinal(Rows(table, len(best)), grade, grades)
    return Severity(best, w, thresholds, held_out_cutoff(table, grade, np.array([r["digest"] for r in got], np.int64) % FOLDS, len(best), grades))


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """``(doc_id, expected_severity, p_toxic, grade, toxic)`` for every row of ``docs``.

    ``grade`` is the likeliest one, ``toxic`` whether P(grade > 0) exceeds the
    model's cutoff.  Null and empty texts have no features; the whole
    text counts, however long; rows that repeat an id are scored each.
    Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` grams and weights

    def rows(ids, texts):
        m = shared.value
        above = m.above(m.margins(texts))
        edges = np.column_stack([np.ones(len(above)), above, np.zeros(len(above))])
        grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)
        return zip(ids, above.sum(axis=1).tolist(), above[:, 0].tolist(), grade.tolist(), (above[:, 0] > m.cutoff).tolist(), strict=True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs, ["doc_id", "text"], f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean", rows)
