import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from sluice.llm import blocks, lines, text
from sluice.llm.text import lower_words


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        assert lines.edit_distance(a, b) == slow_distance(a, b)


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(rng.randint(12, 30))] for _ in range(12)]
    rows = []
    for d in range(60):
        said = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(15)]
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = word()
            said.append(" ".join(w).capitalize() + rng.choice(["", ".", "!"]))
        rows.append((d, "\n".join([*said, "ok", ""]), "x", 1))
    rows += [(70, None, "x", 0), (71, "", "x", 0), (None, rows[0][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string, n_chars long")
    units = [(d, k, lower_words(t)) for d, text, *_ in rows if d is not None and text for k, t in enumerate(text.split("\n"))]
    units = [u for u in units if len(u[2]) >= 3]
    up = list(range(len(units)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(units)):
        for j in range(i):
            if 1 - slow_distance(units[i][2], units[j][2]) / max(len(units[i][2]), len(units[j][2])) >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    want = {units[i][:2]: units[root(i)][:2] for i in range(len(units))}
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in lines.groups(docs).collect()}
    assert got.keys() == want.keys()
    assert got == want
    out = lines.drop_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[70] is None and texts[71] == "" and texts[None] == rows[0][1]
    for d, text, *_ in rows[:60]:
        keep = [t for k, t in enumerate(text.split("\n")) if got.get((d, k), (d, k)) == (d, k)]
        assert texts.get(d, "gone") == ("\n".join(keep) if any(lower_words(t) for t in keep) else "gone") or len(keep) == len(text.split("\n"))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.groups(empty).count() == 0 and lines.drop_repeats(empty).count() == 0


def test_similar_lines_far_apart_in_simhash_are_joined(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for k in range(40):  # one of 10 words differs and outweighs the others in the SimHash
        w = [word(4) for _ in range(9)]
        rows += [(2 * k, " ".join([*w, word(14)])), (2 * k + 1, " ".join([*w[:4], word(14), *w[4:]]))]
    for k in range(40):  # three of 15 words differ: the bound itself
        w = [word(rng.randint(2, 14)) for _ in range(15)]
        v = list(w)
        v[1], v[7] = word(14), word(14)
        rows += [(100 + 2 * k, " ".join(w)), (101 + 2 * k, " ".join([*v[:10], *v[11:]]))]
    got = {r.doc_id: r.first_doc_id for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_a_failed_edge_of_the_tree_does_not_split_a_group(spark):
    w = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()
    rows = []
    for k in range(30):
        a = [f"{x}{k}" for x in w]
        rows += [(3 * k, " ".join(a[::-1])), (3 * k + 1, " ".join(a)), (3 * k + 2, " ".join(["x", *a[1:]]))]
    got = {r.doc_id: r.first_doc_id for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - (d % 3 == 2) for d, _ in rows}


def altered(rng, line, edits, word):
    """``line`` after ``edits`` substitutions, insertions or removals at different places."""
    out = [[w] for w in line]
    for at in rng.sample(range(len(line)), edits):
        out[at] = rng.choice([[word()], [word()], [word(), line[at]], []])
    return [w for x in out for w in x]


def keys_of(lines_, common, least=0.8):
    flat = np.array([xxhash.xxh32_intdigest(w) for x in lines_ for w in x], np.uint64)
    sizes = np.array([len(x) for x in lines_])
    line, key = map(np.concatenate, zip(lines.rare_pairs(flat, sizes, common, least), lines.run_keys(flat, sizes, common, least), strict=True))
    return [set(key[line == k].tolist()) for k in range(len(lines_))]


def test_pairs_meet_in_a_run_of_words():
    rng = random.Random(6)
    rare = np.append(np.full(lines.COUNTERS, -20.0), np.log(1e6 / lines.COMMON) / lines.RUN).astype(np.float32)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 10))).encode()
    for n in (4, 5, 6, 9, 10, 14, 15, 20, 25, 40, 57, 100, 400):
        for least in (0.8, 0.85, 0.9):
            edits = int((1 - least) * n + 1e-9)
            met = similar = 0
            for _ in range(400 if n < 100 else 100):
                a = [word() for _ in range(n)]
                b = altered(rng, a, max(edits, 1), word)
                if 1 - slow_distance(a, b) / max(n, len(b)) < 0.8:
                    continue
                x, y = keys_of([a, b], rare)
                similar += 1
                met += bool(x & y)
            assert similar == 0 or met / similar >= (0.98 if n > 19 else 1), (n, least, met, similar)


def test_runs_of_common_words_grow_and_still_meet():
    rng = random.Random(7)
    common = np.append(np.full(lines.COUNTERS, -1.0), 0.5).astype(np.float32)
    common[: lines.COUNTERS // 2] = 0.3  # half of the words are in most lines
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6)).encode()
    met = 0
    for _ in range(300):
        a = [word() for _ in range(40)]
        x, y = keys_of([a, altered(rng, a, 6, word)], common)
        met += bool(x & y)
    assert met >= 294


def test_parities_never_exceed_the_difference():
    rng = random.Random(8)
    for _ in range(500):
        a = [rng.randrange(2**32) for _ in range(rng.randint(0, 60))]
        b = altered(rng, a, rng.randint(0, len(a) // 3), lambda: rng.randrange(2**32))
        differ = sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
        bits = blocks.parities(np.array(a + b, np.uint32), np.array([len(a), len(b)]))
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= differ
        longest = max(len(a), len(b))
        if longest and lines.similar(np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes(), 0.8):
            assert differ <= lines._apart(0.8)(np.array([len(a)]), np.array([len(b)]))[0]


def test_many_pairs_are_similar_as_each_is():
    rng = random.Random(12)
    one, two = [], []
    for _ in range(800):
        a = [rng.randrange(40) for _ in range(rng.randint(0, 40))]
        b = rng.choice([altered(rng, a, rng.randint(0, len(a) // 3), lambda: rng.randrange(40)), a[:5] + a, a[::-1], a[1:] + a[:1]])
        one.append(np.array(a, "<u4").tobytes())
        two.append(np.array(b, "<u4").tobytes())
    for least in (0.8, 0.9, 0.5):
        got = lines.all_similar(pa.array(one, pa.binary()), pa.array(two, pa.binary()), least)
        assert got.tolist() == [slow_distance(np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()) <= int(lines.most_edits(max(len(x), len(y)) // 4, least)) for x, y in zip(one, two, strict=True)]


def test_simhash_is_the_majority_and_long_lines_count_whole():
    rng = np.random.default_rng(9)
    sizes = np.array([1, 2, 3, 255, 256, 700, 1])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    got = lines.simhashes(hashes, np.cumsum(sizes) - sizes, sizes).view(np.uint64)
    for k, (end, n) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
        own = hashes[end - n : end]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > n)


def test_words_of_many_texts_are_those_of_one():
    rng = random.Random(10)
    texts = [None, "", "\n", "Ab cd\nef", "\u00fcn\u00cf x, y\n\nzz \U0001f600q", "a" * 200_000 + " b", " ".join("word%d" % rng.randrange(50) for _ in range(30_000))]
    t = text.Tokens(texts)
    want = [w for x in texts for w in text.lower_words(x)]
    lower = t.raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    assert [lower[s:e] for s, e in zip(t.starts, t.ends, strict=True)] == want
    assert len(set(zip(want, t.hashes.tolist(), strict=True))) == len(set(want)) == len(set(t.hashes.tolist()))
    assert t.first_line.tolist() == [0, 1, 2, 4, 6, 9, 10] and len(t.line_at) == 12
    starts, ends = t.points()
    spans = [texts[k][s:e] for k, s, e in zip(np.searchsorted(t.text_at, t.starts, "right") - 1, starts, ends, strict=True)]
    assert [bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode()) for w in spans] == want


def test_a_line_shared_by_many_and_hot_runs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL", 4)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(30)], []
    for d in range(120):  # copies that differ in up to two words each, among others that share a third of the words only
        w = list(base)
        for at in rng.sample(range(30), 2):
            w[at] = word()
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(base[:10] + [word() for _ in range(20)])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in lines.groups(docs).collect()}
    assert all(got[d] == 0 for d in range(120)) and all(got[d] == d for d in range(1000, 1060))


def test_clashing_names_and_very_long_lines(spark):
    long = " ".join("w%d" % k for k in range(60_000))
    rows = [(1, long, 1), (2, long + " x", 2), (3, "a b c d\n" + long, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    out = {r.doc_id: (r.text, r.gone) for r in lines.drop_repeats(docs).collect()}
    assert out == {1: (long, 1), 3: ("a b c d", 3)}


def test_a_text_of_very_many_repeated_lines_is_cut_in_linear_time(spark):
    import time

    line = "one line of more than enough words to be looked at again"
    rows = [(1, line, 5, "x"), (2, "\n".join([line] * 60_000 + ["", "the end of it"]), 5, "x"), (3, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, gone string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.drop_repeats(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].text == line and got[1].n_chars == 5 and got[2].text == "\nthe end of it" and got[2].n_chars == 14
    assert got[3].text is None and got[3].gone == "x"


def test_long_lines_are_compared_together(monkeypatch):
    rng = random.Random(8)
    pairs = []
    for n in [70, 150, 300] * 40:
        a = [rng.randrange(10**6) for _ in range(n)]
        b = list(a)
        for at in (n // 5, n // 3, n // 2):  # a word goes, one comes, one changes: no two of them on one diagonal
            b.pop(at)
            b.insert(at + 7, rng.randrange(10**6))
            b[at + 11] = rng.randrange(10**6)
        pairs.append((np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()))
    monkeypatch.setattr(lines, "edit_distance", None)  # not one by one
    a, b = (pa.array(x, pa.binary()) for x in zip(*pairs, strict=True))
    assert lines.all_similar(a, b, 0.8).all()


def test_edit_distances_and_bands_are_those_of_each_pair():
    rng = random.Random(9)
    for n in (1, 5, 30, 64):
        a = [[rng.randrange(4) for _ in range(n)] for _ in range(40)]
        b = [x[: rng.randint(0, n)] + [rng.randrange(4) for _ in range(rng.randint(0, 3))] for x in a]
        want = np.array([slow_distance(x, y) for x, y in zip(a, b, strict=True)])
        m = np.array([len(y) for y in b])
        wide = np.zeros((40, max(1, m.max())), np.uint32)
        for k, y in enumerate(b):
            wide[k, : len(y)] = y
        sizes = np.full(40, n)
        assert (lines.edit_distances(np.array(a, np.uint32), sizes, wide, m) == want).all()
        x, y = np.concatenate(a).astype(np.uint32), np.array([w for v in b for w in v] or [0], np.uint32)
        args = x, np.cumsum(sizes) - n, sizes, y, np.cumsum(m) - m, m
        near = want <= lines.BAND  # no way of so few edits leaves the band
        assert (lines.within_band(*args, want)[near]).all()
        assert not lines.within_band(*args, want - 1)[want > 0].any()


def test_bucket_rows_are_shuffled_in_packs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 1 << 30)
    units = spark.range(20_000).repartition(2)
    keys = lambda batch: [((batch.column(0).to_numpy() // 2), blocks.units(batch.column(0).to_numpy(), np.zeros((batch.num_rows, blocks.PARITIES)), np.full(batch.num_rows, 5)))]
    packs, row = blocks.met(units, units.limit(0), keys, blocks.UNIT, 20_000, blocks.BLOCK)
    assert packs.count() <= 2 * packs.rdd.getNumPartitions()
    got = np.concatenate([np.frombuffer(r["rows"], row) for r in packs.collect()])
    assert sorted(got["unit"]["uid"].tolist()) == list(range(20_000))
    assert (got["bucket"] == got["unit"]["uid"] // 2).all()


def test_rows_alone_in_their_bucket_are_left_out():
    for bucket, want in (([], []), ([7], []), ([7, 3], []), ([7, 3, 7, 5, 3], [1, 4, 0, 2])):
        assert sorted(blocks.by_bucket(np.array(bucket, np.int64)).tolist()) == sorted(want)


def test_near_copies_of_hot_buckets_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL", 4)
    tried = spark.sparkContext.accumulator(0)
    alike = lines.all_similar

    def counted(a, b, least):
        tried.add(len(a))
        return alike(a, b, least)

    monkeypatch.setattr(lines, "all_similar", counted)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for d in range(300):
        w = list(base)
        w[rng.randrange(60)] = word()
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.first_doc_id for r in lines.groups(docs).collect()} == {0}
    assert tried.value < 11 * 300  # 13 a line without the first pairs


def test_packs_are_cut_and_hold_each_line_whole(monkeypatch):
    monkeypatch.setattr(lines, "PACK", 10)
    sizes = np.array([3, 4, 50, 1, 9, 2])
    uid, words = np.arange(6) - 3, np.arange(sizes.sum(), dtype=np.uint32)
    batch = pa.RecordBatch.from_arrays(lines._packed(uid, sizes, words, 9), names=lines._PACK)
    assert batch.num_rows == 9 and 1 < batch.num_rows - batch.column(0).null_count < 6
    got = list(lines._packs([batch.filter(batch.column(0).is_valid())]))
    assert all((np.concatenate(x) == want).all() for x, want in zip(zip(*got, strict=True), (uid, sizes, words), strict=True))
    assert lines._packed(uid[:0], sizes[:0], words[:0], 2)[0].null_count == 2
