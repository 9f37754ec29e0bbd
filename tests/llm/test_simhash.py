import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import simhash


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def words(rng, n):
    return " ".join(rng.choice("Alpha beta gämma delta\tEPS zeta eta\ntheta iota kappa".split(" ")) for _ in range(n))


def test_fingerprint_matches_definition_and_spark_hash(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "a b c", "a b c d", "\x85 nbsp\xa0x"] + [words(rng, rng.randint(1, 90)) for _ in range(60)]
    texts += ["w " * 70000 + "end"]
    for t in texts:
        assert simhash.fingerprint(t) == naive_fingerprint(t)
    one = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert one % 2**64 == simhash.fingerprint("A b c")


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    base = [words(rng, 60) for _ in range(12)]
    for i in range(260):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["new", "other", "more"])
        rows.append((i, " ".join(w), 1))
    rows += [(300, None, 1), (301, "", 1), (302, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    roots = naive_components([naive_fingerprint(t) for _, t, _ in rows])
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def clustered(rng, n, centres=6, bits=14):
    """Fingerprints around a few centres, so that distances spread from 0 to 64."""
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, bits)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def joined(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_tree_goes_down_several_levels_and_misses_nothing():
    rng = random.Random(11)
    for n, bits in ((400, 6), (700, 14), (300, 3)):
        fps = np.array(clustered(rng, n, bits=bits), np.uint64)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
        edges, depth = simhash.tree_links(fps, 4, leaf=4)
        assert depth >= 4 and all(near[a, b] for a, b in edges) and len(edges) < n
        assert joined(n, edges) == joined(n, np.argwhere(near).tolist())
        cut = n // 3
        edges, depth = simhash.tree_links(fps[:cut], 4, fps[cut:], leaf=4)
        across = [(a, b) for a, b in np.argwhere(near).tolist() if (a < cut) != (b < cut)]
        assert depth >= 4 and all((a < cut) != (b < cut) and near[a, b] for a, b in edges)
        assert joined(n, edges) == joined(n, across)
    same = np.array([7] * 50, np.uint64) ^ np.uint64(1) * np.arange(50, dtype=np.uint64)
    assert len(set(joined(50, simhash.tree_links(same, 4, leaf=2)[0]))) == 1


def test_blocks_follow_the_number_of_fingerprints():
    assert simhash.shard_blocks(10, 4) == 5 and simhash.shard_blocks(10_000_000, 4) == 6 and simhash.shard_blocks(10**12, 4) == 8
    for n in range(5, 11):
        assert all(1 <= 64 * (b + 1) // n - 64 * b // n <= -(-64 // n) for b in range(n))


@pytest.mark.parametrize("most", [1, 256])
def test_links_of_every_width_are_those_of_brute_force(spark, most):
    fps = clustered(random.Random(12), 500, bits=9)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    place = {s[0]: k for k, s in enumerate(signed)}
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), block=64, most=most).collect()
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 4
    assert joined(len(fps), [(place[e.a], place[e.b]) for e in edges]) == joined(len(fps), np.argwhere(near).tolist())


def test_large_shard_is_dealt_out_in_blocks(spark):
    rng = random.Random(7)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 300:
        x = center
        for _ in range(rng.randint(1, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), block=32).collect()
    up = {s[0]: s[0] for s in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in edges:
        up[root(e.a)] = root(e.b)
        assert bin((e.a ^ e.b) % 2**64).count("1") <= 4
    want = naive_components(fps)
    groups = {}
    for (s,), w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(root(s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(4, "a b"), (4, "a b"), (2, "A  b"), (None, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(0, 2), (2, 2), (4, 2), (4, 2)]
    assert {r.doc_id for r in simhash.keep_one(twice).collect()} == {2, None}


def test_one_of_each_group_stays_whatever_the_columns_are_called(spark):
    rows = [(3, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (7, "quite another text than that one", 3, None), (7, "quite another text than that one", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head int, rows string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7]
