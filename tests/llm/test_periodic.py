import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sluice.llm import periodic, queries
from sluice.llm.common import table


def brute(words):
    """Runs by looking at every period: stretches where words q apart agree."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def numbered(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def test_z_function_is_the_common_prefix():
    rng = random.Random(0)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s) == want


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        texts = []
        for _ in range(rng.randint(1, 12)):
            n, k = rng.choice([0, 3, 6, 7, rng.randint(0, 160)]), rng.choice([1, 2, 2, 3, 6])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 8 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(w, np.int64))
        for t, got in zip(texts, periodic.runs_of(texts), strict=True):
            assert got == brute(t.tolist()), t.tolist()


def test_a_false_hash_costs_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "mixed", lambda x: x * np.uint64(0))  # all hashes agree
    rng = random.Random(4)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(rng.randint(0, 80))]
        assert periodic.runs_of([np.array(w, np.int64)]) == [brute(w)]


def test_long_texts_take_about_linear_time():
    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert periodic.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0] + 0.5


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_rows_without_words_repeats_and_other_columns(spark):
    t = "a b c\tla la la la la la la\nd e d e d e d e d f"
    docs = spark.createDataFrame([(1, t, 5), (1, t, 5), (2, None, 6), (3, "", 7), (4, " \n\x0b ", 8), (None, t, 9)], "doc_id long, text string, runs int")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.runs(docs).collect()}
    runs = ((2, 7, 1), (9, 9, 2))
    short = "a b c la d e f"
    assert got == {(1, 19, runs, short), (None, 19, runs, short), (2, 0, (), ""), (3, 0, (), ""), (4, 0, (), "")}
    assert periodic.runs(docs).count() == 6
    assert periodic.runs(docs.limit(0)).count() == 0
    assert [r.text for r in periodic.collapse(docs.where("doc_id = 1")).collect()] == [short, short]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, sf):
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        words = periodic.WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(numbered(words).tolist()) if n < 2500 else [tuple(x) for x in periodic.runs_of([numbered(words)])[0]]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (
            len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept(words, runs))),
        )
    got = queries.op12_periodic(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 5
