import random
import re

from pyspark.sql import functions as F

from sluice.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, k=10):
    w = plain_words(text)
    hit, found = set(), set()
    for item, said in items:
        v = plain_words(said)
        n = min(k, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "c9", "é", "d", "Ee"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([2, 5, 9, 10, 11, 14, 30]))) for i in range(14)] + [(90, None), (91, ""), (92, "!!"), (93, say(12)), (94, "the quick brown fox")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, items[5][1]), (4, "x " + items[3][1] + " y The QUICK, brown-fox"), (5, "a " * 4000)]
    for i in range(6, 60):
        t = say(rng.randint(1, 60))
        docs.append((i, t + rng.choice(["", " zz "]) + rng.choice(items)[1] if rng.random() < 0.5 and items[0][1] and (p := rng.choice(items)[1]) else t))
    return [(d, t) for d, t in docs], items


def test_report_matches_brute_force_in_one_and_several_passes(spark):
    docs, items = corpus(2)
    items[0] = (None, items[0][1])
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    I = spark.createDataFrame(items, "item_id long, text string")
    want = {d: brute(t, [x for x in items if x[0] is not None] + [(None, items[0][1])]) for d, t in docs}
    for limit in (dc.ITEM_WORDS, 60):
        hit = F.aggregate("word_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
        got = {r.doc_id: (r.n_words, r.hit, r["items"]) for r in dc.match(D, I, item_words=limit).withColumn("hit", hit).collect()}
        assert got == {d: (a, b, [x for x in c if x != "None"]) for d, (a, b, c) in want.items()}


def test_char_spans_and_cut():
    text = "Ünder—the 'quick' BROWN fox"
    assert plain_words(text) == [w.decode() for w in dc.words(text)]
    spans = dc.char_spans(text, [(1, 3)])
    assert [text[a:b] for a, b in spans] == ["quick' BROWN"]
    assert dc.cut(text, [(1, 2)], 10, span_limit=0) == "Ünder—the '' BROWN fox"
    assert dc.cut(text, [(1, 2)], 10) == dc.cut(text, [(0, 4)], 5) == text
    assert dc.cut(text, [(0, 4)], 5, span_limit=3) is None and dc.cut(text, [(0, 4)], 5, span_limit=4) == text
    assert dc.cut(text, [], 5) == text


def test_clean_leaves_other_documents_alone(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "clean text here", "s", 15), (2, "before " * 40 + item + " after", "s", 1), (3, item, "s", 1), (4, None, "s", 0), (5, "", "s", 0)]
    D = spark.createDataFrame(rows, "doc_id long, text string, n_words string, n_chars long")
    out = dc.clean(D, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == [c for c in D.columns]
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == "clean text here"
    assert got[2].text == "before " * 40 + " after" and got[2].n_chars == len(got[2].text)
    assert got[2].n_words == "s" and got[4].text is None
    assert dc.clean(D.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_common_short_phrases_stay_and_names_may_clash(spark):
    items = spark.createDataFrame([(1, "of the"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, "Of the", "a", 1), (2, "of the cat one two three four five six seven eight nine ten and more words here than that was", "b", 2), (None, None, None, None)]
    D = spark.createDataFrame(rows, "doc_id long, text string, word_runs string, ITEMS int")
    got = {r.doc_id: tuple(r) for r in dc.clean(D, items).collect()}
    assert got[1] == rows[0] and got[None] == rows[2]
    assert got[2] == (2, "of the cat  and more words here than that was", "b", 2)


def test_long_items_are_cut_and_no_window_is_lost(spark):
    long = [f"w{i}" for i in range(5000)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "a b c d e f g h i j k"), (3, "x y")], "item_id long, text string")
    docs = [(k, "before " + " ".join(long[at : at + 10]) + " after") for k, at in enumerate(range(0, 4990, 97))] + [(900, "a b c d e f g h i j"), (901, " ".join(long[4990:])), (902, "x y"), (903, " ".join(long[7:16]))]
    D = spark.createDataFrame(docs, "doc_id long, text string")
    sized, turns = dc._sized(items, 400, 10)
    assert turns > 10
    assert max(sum(len(r.text.split()) for r in sized.where(f"turn = {t}").collect()) for t in range(0, turns, 9)) <= 400
    found = dc.match(D, items, item_words=400)
    got = {r.doc_id: (r["items"], [tuple(x) for x in r.word_runs]) for r in found.collect()}
    assert all(got[k] == (["1"], [(1, 11)]) for k in range(len(docs) - 4))
    assert got[900] == (["2"], [(0, 10)]) and got[901] == (["1"], [(0, 10)]) and got[902] == (["3"], [(0, 2)]) and got[903] == ([], [])
