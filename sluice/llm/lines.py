"""Fuzzy line duplicates: SimHash and word blocks, edit similarity, one line kept per group.

Lines are normalised to their lower-case words.  Lines with equal words
are one.  Candidates come from two pigeonhole joins.  Lines whose 64-bit
SimHashes differ in at most ``RADIUS`` bits agree on all but as many of
their blocks of bits; that finds most copies, but a fifth of the words
may turn 13 bits of 64, where blocks of bits rule nothing out.  So the
blocks of the second join are made of words.  Short lines meet in pairs of
their rarest words, of which every similar line shares one.  In longer ones
they are runs of words: an edit touches at most as many of a line's runs
as these have words, and the runs left over are met through those whose
hash lies below a rate that follows from their number.
Every candidate is verified by the edit similarity of the word sequences,
and the first line of each connected group stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import connected_components, discard, materialise, membership, release, tidied, unused_name
from .simhash import links as simhash_links
from .text import Tokens, mixed, sequence_hashes

#: Least edit similarity of words, least words of a line that may go.
SIMILARITY, LEAST_WORDS = 0.8, 3
#: Bits of SimHash within which blocks of bits find every pair, and lines of an average shard.
RADIUS, SHARD = 3, 64
#: Chance at most that a pair at the least similarity meets in no run, its edits spread so as to spare as few runs as they can.
MISSED = 0.01
#: Words of a pair's longer line from which pairs meet in runs; shorter ones meet, every one of them, in pairs of rare words.
SHORT = 20
#: Words of a run at least and at most; a run grows while more than ``COMMON`` lines may be expected to hold it.
RUN, LONGEST_RUN, COMMON = 3, 6, 16.0
#: Counters of word frequencies (a power of two).
COUNTERS = 1 << 15
#: Words more or fewer of one line gone by, up to which the distances of many pairs are tried at once.
BAND = 8
#: Rows of documents that are worked on at once, and words of a pack of lines.
BATCH, PACK = 256, 1 << 17
#: Columns of a pack, and of one of sampled lines.
_PACK, _SOME = ["uids", "sizes", "words"], ["some_uids", "some_sizes", "some_words"]
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
_EDGE = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0xD1342543DE82EF95)


def simhashes(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 majority bits of each line's word hashes; no line is empty.

    Eight bits are counted at once, a byte each, over at most 255 words.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    counts = np.column_stack([np.add.reduceat(_SPREAD[octets[:, k]], at) for k in range(8)])
    counts = np.add.reduceat(counts.view(np.uint8).reshape(len(at), 64).astype(np.int64), first, axis=0)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences: Hyyrö's bit-parallel rows over the unequal middle."""
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    end = 0
    while end < n - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
    return score


def words_of(line: bytes) -> list[int]:
    return np.frombuffer(line, "<u4").tolist()


def similarity(a: bytes, b: bytes) -> float:
    """Edit similarity, in words, of two lines of packed 32-bit word hashes."""
    x, y = words_of(a), words_of(b)
    longest = max(len(x), len(y))
    return 1 - edit_distance(x, y) / longest if longest else 1.0


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether ``similarity`` is at least ``least``; most that fail do so by the words they lack."""
    edits = int(most_edits(max(len(a), len(b)) // 4, least))
    x, y = words_of(a), words_of(b)
    if abs(len(x) - len(y)) > edits:
        return False
    own, other = set(x), set(y)
    return len(own - other) <= edits and len(other - own) <= edits and edit_distance(x, y) <= edits


def edit_distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``edit_distance`` of many pairs at once: rows of ``a`` have ``n`` words, 1 to 64, those of ``b`` have ``m``."""
    order = np.argsort(-m, kind="stable")
    a, n, b, m = a[order], n[order].astype(np.uint64), b[order], m[order]
    one = np.uint64(1)
    plus, minus, score = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64), n.astype(np.int64)
    top = n - one
    for j in range(int(m.max(initial=0))):
        k = int(np.searchsorted(-m, -j))  # rows with more than j words in b stand first
        eq = np.zeros((k, 8), np.uint8)
        bits = np.packbits(a[:k] == b[:k, j : j + 1], axis=1, bitorder="little")
        eq[:, : bits.shape[1]] = bits
        eq = eq.view("<u8")[:, 0]
        p, q = plus[:k], minus[:k]
        xv = eq | q
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = q | ~(xh | p), p & xh
        score[:k] += ((ph >> top[:k]) & one).astype(np.int64) - ((mh >> top[:k]) & one).astype(np.int64)
        ph, mh = ph << one | one, mh << one
        plus[:k], minus[:k] = mh | ~(xv | ph), ph & xv
    out = np.empty(len(n), np.int64)
    out[order] = score
    return out


def within_band(x: np.ndarray, x_at: np.ndarray, n: np.ndarray, y: np.ndarray, y_at: np.ndarray, m: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether ``edits`` turn n words of ``x`` into m of ``y`` with never over ``BAND`` more or fewer of one gone by; many pairs at once.

    On each diagonal the farthest place that d edits reach, for all d.
    """
    start = np.cumsum(n + 1) - n - 1
    step = np.arange(int((n + 1).sum())) - np.repeat(start, n + 1)
    at, far = np.arange(len(step)), np.repeat(m, n + 1)
    own, other, end = x[np.minimum(np.repeat(x_at, n + 1) + step, len(x) - 1)], np.repeat(y_at, n + 1) + step, step == np.repeat(n, n + 1)
    apart = np.empty((2 * BAND + 1, len(step)), np.int64)  # the next place, on each diagonal, where the words differ
    for k in range(-BAND, BAND + 1):
        unequal = end | (step + k < 0) | (step + k >= far) | (own != y[np.clip(other + k, 0, len(y) - 1)])
        apart[k + BAND] = np.minimum.accumulate(np.where(unequal, at, len(at))[::-1])[::-1]
    out, rows, diagonal = np.zeros(len(n), bool), np.flatnonzero(np.abs(m - n) <= BAND), np.arange(2 * BAND + 1)
    none = -(1 << 40)
    reach = np.full((len(rows), 2 * BAND + 1), none)
    reach[:, BAND] = 0
    d = 0
    while len(rows):
        most = np.minimum(n[rows, None], m[rows, None] - (diagonal - BAND))
        place = np.minimum(reach, most)
        base = start[rows, None]
        place = np.where(place >= 0, apart[diagonal, base + np.maximum(place, 0)] - base, none)
        done = place[np.arange(len(rows)), m[rows] - n[rows] + BAND] >= n[rows]
        out[rows[done]] = True
        d += 1
        left = ~done & (edits[rows] >= d)
        rows, place = rows[left], place[left]
        reach = place + 1
        reach[:, 1:] = np.maximum(reach[:, 1:], place[:, :-1])
        reach[:, :-1] = np.maximum(reach[:, :-1], place[:, 1:] + 1)
    return out


def _rows(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``values`` as the rows of a matrix; what lies beyond a run is of no account."""
    place = at[:, None] + np.arange(int(size.max(initial=0)))
    return values[np.minimum(place, len(values) - 1)]


def all_similar(a: pa.Array, b: pa.Array, least: float) -> np.ndarray:
    """``similar`` of many pairs: by bounds of the distance where these decide, else by the distance.

    From above: a common number of words stands at equal places, counted
    from the beginnings up to some word and from the ends after it.  From
    below: the multisets' parities.  Distances of up to 64 words are found
    together; longer lines are tried in a band before they go one by one.
    """
    (x, n), (y, m) = blocks.unpacked(a), blocks.unpacked(b)
    longest, both = np.maximum(n, m), np.minimum(n, m)
    edits = most_edits(longest, least)
    out = longest <= edits
    rows = np.flatnonzero((longest - both <= edits) & (both > 0))
    if not len(rows):
        return out
    x_all, y_all = np.cumsum(n) - n, np.cumsum(m) - m
    size, start = both[rows], np.cumsum(both[rows]) - both[rows]
    step = np.arange(size.sum()) - np.repeat(start, size)
    front = x[np.repeat(x_all[rows], size) + step] != y[np.repeat(y_all[rows], size) + step]
    end = x[np.repeat((x_all + n)[rows] - size, size) + step] != y[np.repeat((y_all + m)[rows] - size, size) + step]
    unequal_to_end = np.add.reduceat(end, start, dtype=np.int64)
    turned = np.cumsum(front.astype(np.int64) - end)  # up to and with each word, over all pairs
    turned -= np.repeat((turned - front + end)[start], size)
    most = (longest - both)[rows] + unequal_to_end + np.minimum(np.minimum.reduceat(turned, start), 0)
    out[rows] = most <= edits[rows]
    rows = rows[most > edits[rows]]
    if len(rows):
        differ = np.bitwise_count(blocks.parities(*_some(x, x_all, n, rows), 16) ^ blocks.parities(*_some(y, y_all, m, rows), 16)).sum(axis=1, dtype=np.int64)
        rows = rows[differ <= (both - longest + 2 * edits)[rows]]
    short = rows[longest[rows] <= 64]
    if len(short):
        x_rows, y_rows = (_rows(v, at[short], k[short]) for v, at, k in ((x, x_all, n), (y, y_all, m)))
        out[short] = edit_distances(x_rows, n[short], y_rows, m[short]) <= edits[short]
    rows = rows[longest[rows] > 64]
    long = rows[longest[rows] <= 1 << 16]
    for some in np.split(long, np.flatnonzero(np.diff(np.cumsum(n[long] + 1) >> 16)) + 1) if len(long) else []:  # in some 10 MB
        out[some] = within_band(x, x_all[some], n[some], y, y_all[some], m[some], edits[some])
    for k in rows[~out[rows]].tolist():
        out[k] = similar(a[k].as_py(), b[k].as_py(), least)
    return out


def _some(values: np.ndarray, at: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``rows`` of ``values``, one after the other, and their sizes."""
    own = size[rows]
    return values[np.repeat(at[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())], own


def most_edits(longest, least_similarity: float) -> np.ndarray:
    """Edits that may part two similar lines, the longer one of ``longest`` words."""
    return np.floor((1 - least_similarity) * longest + 1e-9).astype(np.int64)


def run_keys(values: np.ndarray, sizes: np.ndarray, common: np.ndarray, least_similarity: float = SIMILARITY, missed: float = MISSED, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """``(line, key)`` of the runs by which similar lines meet, once each, where the longer one has ``short`` words or more.

    ``common`` holds, for each counter, the logarithm of a word's share of
    all words, plus one ``RUN``-th of the logarithm of the number of lines
    over ``COMMON``; a run whose words' sum is positive grows by the next
    word.  A line of n words has n runs of ``RUN`` words, with a mark at
    either end.  An edit touches at most as many as they are long.  With
    the edits allowed that leaves s of them, and each is taken at the rate
    1 - ``missed`` ** (1 / s).  n is rounded up to the lengths at which one
    more edit is allowed, so that the longer line, whose rate is lower,
    takes no run that the shorter one doesn't.
    """
    unit = 1 / (1 - least_similarity) if least_similarity < 1 else np.inf
    wide = np.zeros(len(values) + 2 * len(sizes) + LONGEST_RUN, np.uint64)
    line = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes + 2) - sizes - 2
    spot = np.arange(len(values)) + 2 * line + 1
    wide[begin], wide[begin + sizes + 1] = _EDGE, _EDGE
    wide[spot] = values
    weight = np.full(len(wide), common[-1], np.float32)
    weight[spot] = common[values & np.uint64(COUNTERS - 1)]
    at, past = spot - 1, np.repeat(begin + sizes + 2, sizes)
    key, heavy = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32)
    for k in range(RUN):
        key = key * _MIX + wide[at + k]
        heavy += weight[at + k]
    length = np.full(len(at), RUN, np.int64)
    hot = np.flatnonzero(heavy > 0)
    for k in range(RUN, LONGEST_RUN):
        hot = hot[at[hot] + k < past[hot]]
        key[hot] = key[hot] * _MIX + wide[at[hot] + k]
        length[hot] += 1
        # the constant is in RUN of the weights only: a further word adds its share alone
        heavy[hot] += weight[at[hot] + k] - common[-1]
        hot = hot[heavy[hot] > 0]
    if len(sizes):
        mean = np.add.reduceat(length, np.cumsum(sizes) - sizes) / sizes
        whole = unit * np.ceil(sizes / unit) if np.isfinite(unit) else sizes.astype(float)
        spared = np.maximum(whole * (1 - mean * (1 - least_similarity)), 1)
        rate = 1 - missed ** (1 / spared)
        rate[np.floor(sizes / least_similarity + 1e-9) < short] = 0
    else:
        rate = np.zeros(0)
    key = mixed(key + length.astype(np.uint64))
    take = np.flatnonzero((key >> np.uint64(11)).astype(np.float64) < (rate * 2.0**53)[line])
    # a second scrambling, since what is taken is small
    return _once(line[take], mixed(key[take] ^ _EDGE).view(np.int64))


def _once(line: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, line))
    key, line = key[order], line[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    return line[first], key[first]


def rare_pairs(values: np.ndarray, sizes: np.ndarray, common: np.ndarray, least_similarity: float = SIMILARITY, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """``(line, key)`` of the pairs of rare words by which all similar lines of under ``short`` words meet.

    At most e words of either line, e edits being allowed to one of its
    length, are not in the other, repeats counted.  So in any one order of
    all words, here the rare ones first, the first two common words are
    among the first e + 2 of both.
    """
    own = np.flatnonzero((sizes < short) & (most_edits(np.floor(sizes / least_similarity + 1e-9), least_similarity) > 0))
    mask = np.zeros(len(sizes), bool)
    mask[own] = True
    values, n = values[np.repeat(mask, sizes)], sizes[own]
    line = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, common[values & np.uint64(COUNTERS - 1)], line))
    values = values[order]
    place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    again = np.zeros(len(values), np.int64)
    again[1:] = np.cumsum((values[1:] == values[:-1]) & (line[1:] == line[:-1]))
    again -= np.maximum.accumulate(np.where(np.append(True, (values[1:] != values[:-1]) | (line[1:] != line[:-1]))[: len(values)], again, 0))
    word = mixed(values ^ again.astype(np.uint64) << np.uint64(40))
    last = (most_edits(n, least_similarity) + 1)[line]
    lines_, keys_ = [], []
    for d in range(1, int(last.max(initial=0)) + 1):
        i = np.flatnonzero((place + d <= last) & (place + d < n[line]))
        lines_.append(own[line[i]])
        keys_.append(mixed(word[i] * _MIX + word[i + d]).view(np.int64))
    return _once(np.concatenate(lines_), np.concatenate(keys_)) if lines_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """``(doc_id, line, uid, fp)`` of every line of at least ``least_words`` words, and packs.

    Equal words, equal ``uid``.  Packs, for ``_packs``, stand in one row in
    many: ``uids``, ``sizes`` and ``words`` have the word hashes of the
    lines that the task hasn't given already, the columns with ``some_``
    those of one line in ``blocks.SAMPLED`` once more, and ``counts`` how
    often the task gave the words of each counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        total, held = np.zeros(COUNTERS, np.int64), None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                t = Tokens(part.column(1).to_pylist())
                sizes = np.diff(t.line_at)
                chosen = np.flatnonzero(sizes >= max(least_words, 1))
                if not len(chosen):
                    continue
                hashes, sizes = t.hashes[np.repeat(sizes >= max(least_words, 1), sizes)], sizes[chosen]
                starts = np.cumsum(sizes) - sizes
                doc = np.searchsorted(t.first_line, chosen, "right") - 1
                uid = sequence_hashes(hashes, starts, sizes).view(np.int64)
                fresh = np.zeros(len(uid), bool)
                for k, u in enumerate(uid.tolist()):
                    if u not in given:
                        given.add(u)
                        fresh[k] = True
                if len(given) > 1_000_000:  # bounds memory; a line given twice costs time only
                    given.clear()
                fp = simhashes(hashes, starts, sizes)
                columns = [part.column(0).take(pa.array(doc)), pa.array((chosen - t.first_line[doc]).astype(np.int32)), pa.array(uid), pa.array(fp)]
                uid, n = uid[fresh], sizes[fresh]
                values = (hashes[np.repeat(fresh, sizes)] >> np.uint64(32)).astype("<u4")
                total += np.bincount(values & np.uint32(COUNTERS - 1), minlength=COUNTERS)
                some = mixed(uid.view(np.uint64)) % np.uint64(blocks.SAMPLED) == 0
                columns += _packed(uid, n, values, len(fresh)) + _packed(uid[some], n[some], values[np.repeat(some, n)], len(fresh))
                if held:
                    yield made(held, None)
                held = columns
        if held:
            yield made(held, total.astype("<i8").tobytes())

    def made(columns: list[pa.Array], counts: bytes | None) -> pa.RecordBatch:
        own = pa.array([counts] + [None] * (len(columns[0]) - 1), pa.binary())
        return pa.RecordBatch.from_arrays([*columns, own], names=["doc_id", "line", "uid", "fp", *_PACK, *_SOME, "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where("doc_id is not null").select("doc_id", "text")
    packs = ", ".join(f"{c} binary" for c in [*_PACK, *_SOME, "counts"])
    return known.mapInArrow(tidied(run), f"doc_id {kind}, line int, uid long, fp long, {packs}")


def _packed(uid: np.ndarray, sizes: np.ndarray, words: np.ndarray, rows: int) -> list[pa.Array]:
    """Packs of some ``PACK`` words, a line at least, in the first of ``rows`` rows."""
    ends = np.cumsum(sizes)
    begin = ends - sizes
    cut = np.concatenate(([0], np.flatnonzero(np.diff(begin // PACK)) + 1, [len(uid)])).astype(np.int64).tolist()
    parts = [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if a < b]
    values = (
        [uid[a:b].astype("<i8").tobytes() for a, b in parts],
        [sizes[a:b].astype("<i4").tobytes() for a, b in parts],
        [words[begin[a] : ends[b - 1]].tobytes() for a, b in parts],
    )
    return [pa.array(v + [None] * (rows - len(parts)), pa.binary()) for v in values]


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lines' uids, sizes and words in each pack."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            uid, sizes, words = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, ("<i8", "<i4", "<u4"), strict=True))
            yield uid, sizes.astype(np.int64), words


def common_words(seen: DataFrame) -> tuple[np.ndarray, int, int]:
    """What ``run_keys`` asks for, over all lines given in packs of ``seen``, and the numbers of lines and words."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lines = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for own, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines += n // 8
                if own is not None:
                    total += np.frombuffer(own, "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], lines))], names=["counter", "n"])

    given = seen.where("uids is not null or counts is not null").select("counts", F.coalesce(F.octet_length("uids"), F.lit(0)))
    found = given.mapInArrow(tidied(counts), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect()  # a row a counter
    by = {r["counter"]: r["n"] for r in found}
    lines, words = by.pop(-1, 0), sum(by.values())
    share = np.zeros(COUNTERS)
    share[list(by)] = list(by.values())
    constant = np.log(max(lines, 1) / COMMON) / RUN
    with np.errstate(divide="ignore"):
        out = np.log(share / max(words, 1)) + constant
    return np.append(out, constant).astype(np.float32), lines, words


@cache
def _edits(least_similarity: float) -> np.ndarray:
    """``most_edits`` of all sizes up to ``blocks.HUGE``."""
    return most_edits(np.arange(blocks.HUGE + 1), least_similarity)


def _apart(least_similarity: float):
    """The most members by which the word multisets of similar lines of given lengths differ, the longer one last; below 0 for none."""

    def bound(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
        table = _edits(least_similarity)
        edits = table[longer] if longer.max(initial=0) < len(table) else most_edits(longer, least_similarity)
        return np.where(longer - shorter > edits, -1, shorter - longer + 2 * edits)

    return bound


def _runs(seen: DataFrame, least_similarity: float) -> DataFrame:
    """Candidates, as ``blocks.candidates`` gives them, among the lines in the packs of ``seen``."""
    said = seen.where("uids is not null").select(*_PACK)
    sampled = seen.where("some_uids is not null").select(*_SOME)
    some, lines, words = common_words(seen)
    common = said.sparkSession.sparkContext.broadcast(some)  # COUNTERS numbers

    def keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for uid, n, values in _packs([batch]):
            wide = values.astype(np.uint64)
            line, key = map(np.concatenate, zip(*(make(wide, n, common.value, least_similarity) for make in (rare_pairs, run_keys)), strict=True))
            yield key, blocks.units(uid[line], blocks.parities(values, n)[line], n[line])

    return blocks.candidates(said, sampled, keys, _apart(least_similarity), 12 * lines)


def _said(packs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(uid, said)``, each once, of the lines whose ``uid`` is in ``ids(id)``."""
    maybe = membership(ids)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, n, values in _packs(batches):
            own = maybe(uid)
            yield pa.RecordBatch.from_arrays([pa.array(uid[own]), blocks.packed_slices(values[np.repeat(own, n)], n[own])], names=["uid", "said"])

    found = packs.mapInArrow(tidied(keep), "uid long, said binary")
    return found.join(ids.withColumnRenamed("id", "uid"), "uid", "left_semi").dropDuplicates(["uid"])


def groups(docs: DataFrame, least_similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, line, first_doc_id, first_line, kept)`` for each line of enough words.

    ``first_*`` name the group's first line by document id, then number,
    which is the one kept.  Shorter lines are never grouped.  Null and empty
    texts have no lines; very long ones are read whole; rows without an id
    are left alone; rows that repeat an id and a line repeat its answer.
    Line numbers start at 0.  Other columns aren't read.
    """
    seen = materialise(_lines(docs, least_words), "lines", compression="zstd")
    place = F.struct("doc_id", "line")
    distinct = materialise(seen.groupBy("uid").agg(F.min(place).alias("first"), F.max("fp").alias("fp")), "distinct-lines")

    by_fp = materialise(distinct.groupBy("fp").agg(F.min("uid").alias("head"), F.count("*").alias("n")), "line-fingerprints")
    near = simhash_links(by_fp, RADIUS, most=SHARD, name="head").select(F.col("a").alias("x"), F.col("b").alias("y"))
    same = distinct.join(by_fp.where("n > 1"), "fp").where("uid <> head").select(F.col("head").alias("x"), F.col("uid").alias("y"))
    bits = near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    release(docs.sparkSession)
    runs = materialise(_runs(seen, least_similarity), "line-runs")
    release(docs.sparkSession)
    pairs = materialise(runs.where("a < b").select("a", "b").unionByName(bits).distinct(), "line-pairs")
    together = runs.where("a = b").select("bucket", F.col("a").alias("uid"))
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(together.select("uid")).distinct()
    asked = materialise(asked, "asked-lines")
    words = materialise(_said(seen.where("uids is not null").select(*_PACK), asked), "line-words")
    places = materialise(seen.select("doc_id", "line", "uid"), "line-places")
    discard(seen, by_fp)  # the packs and the shuffles so far, before words are shuffled again
    found = blocks.verified(pairs, together, words, lambda x, y: all_similar(x, y, least_similarity), _apart(least_similarity))
    members = connected_components(found).withColumnRenamed("node", "uid")

    # only lines of a group need its first one; the others are their own
    named = distinct.select("uid", "first").join(members, "uid")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    heads = materialise(named.join(heads, "component").select("uid", "head"), "line-groups")
    discard(runs, pairs, asked, words)
    by_uid = distinct.select("uid", "first").join(heads, "uid", "left").select("uid", F.coalesce("head", "first").alias("head"))
    return places.join(by_uid, "uid").select(
        "doc_id", "line", F.col("head.doc_id").alias("first_doc_id"), F.col("head.line").alias("first_line"), (place == F.col("head")).alias("kept")
    )


def drop_repeats(docs: DataFrame, least_similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; columns unchanged.

    A document that loses lines and has no words left goes.  ``n_chars``,
    where there is one, follows the new text.  Rows that repeat an id lose
    the same lines.
    """
    name = unused_name(docs.columns, "gone")
    repeats = groups(docs, least_similarity, least_words).where("not kept")
    gone = repeats.groupBy("doc_id").agg(F.collect_set("line").alias(name))  # at most a document's own lines
    joined = docs.join(gone, "doc_id", "left")
    names, count = joined.columns, "n_chars" in docs.columns
    where = names.index(name)

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, columns = batch.column(where).to_pylist(), {c: batch.column(k) for k, c in enumerate(names) if k != where}
            if any(g is not None for g in lost):
                texts = columns["text"].to_pylist()
                for k, g in enumerate(lost):
                    if g is not None:
                        without = set(g)
                        texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in without)
                keep = pa.array([g is None or bool(_SAYS.search(t)) for g, t in zip(lost, texts, strict=True)])
                columns["text"] = pa.array(texts, type=columns["text"].type)
                if count:
                    sizes = [n if g is None else len(t) for n, g, t in zip(columns["n_chars"].to_pylist(), lost, texts, strict=True)]
                    columns["n_chars"] = pa.array(sizes, type=columns["n_chars"].type)
                columns = {c: v.filter(keep) for c, v in columns.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(tidied(shortened), docs.schema)


#: A character of a word.
_SAYS = re.compile("[0-9A-Za-z\x80-\U0010ffff]")
