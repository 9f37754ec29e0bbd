import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sluice.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def folded(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(rows, top):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = folded(text)
        counts[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = []
    for lang, seen in documents.items():
        kept = [t for t, c in seen.items() if c >= 3]
        sources = [s for k, s in counts if k == lang]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        weigh = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = sorted((-sum(weigh(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            ahead = sorted((-weigh(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(ahead[:top])]
    return sorted(out)


def some_rows():
    rng = random.Random(5)
    words = "the The of and é über Öl a1b x-y don't 日本 naïve K\x00z".split(" ") + [f"w{i}z{'abcdefgh'[i % 8]}" for i in range(40)]
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))
    rows = [(text(), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(120)]
    return [*rows, *rows[:3], ("", "fr", "z"), (None, "fr", "y"), ("unique", "it", "q"), ("a " * 5000 + "b", "en", "long")]


@pytest.mark.parametrize(("top", "small"), [(200, False), (3, False), (200, True), (3, True)])
def test_equals_brute_force(spark, monkeypatch, top, small):
    if small:  # many stretches, blocks and pieces
        for name, n in (("CELLS", 8), ("BLOCK", 16), ("PIECE", 64)):
            monkeypatch.setattr(divergence, name, n)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int").repartition(3)
    got = divergence.audit(docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, top)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    text = b"ab cd ab cd ef a b a longer ab"
    raw = np.frombuffer(text, np.uint8)
    low, first, last, row = divergence.term_slices(np.array([0, len(raw)]), raw)
    number, terms = divergence.group_slices(low, first, last)
    assert [terms[k] for k in number.tolist()] == text.split()
    assert len(set(number.tolist())) == len(set(text.split()))


def test_terms_end_with_their_row():
    texts = ["", "ab", "cd é", "", "é", "1", "XY1z"]
    raw = [t.encode() for t in texts]
    low, first, last, row = divergence.term_slices(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    data = low.tobytes()
    assert [(r, data[a:b].decode()) for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)] == [(k, w) for k, t in enumerate(texts) for w in folded(t)]


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randrange(1, 2**48)
        count = rng.randrange(0, total)
        assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op13_divergence(spark, sf)
    order = con.sql(queries.ORACLES["op13_divergence"])
    assert sorted(map(tuple, got.select(*order.columns).collect())) == sorted(order.fetchall())
