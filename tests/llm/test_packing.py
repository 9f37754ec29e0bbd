import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer_on_whole_texts():
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    bits = ["a", "The", "it's", "'ll", " ", "  ", "   ", "\n", "\t", "\r\n", ",", "!!", "12", "é", " ", " ", "\x1c", "\x85", "<|endoftext|>", "日本", "🙂", "_x", "​"]
    encoder = packing.Encoder(PATH)
    texts = ["", " ", "x ", " x", "<|endoftext|> b", "a <|endoftext|>", "w" * 300 + " b"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        want = plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want, repr(t)


@pytest.mark.parametrize("c", [" ", "\n", "a", "7", "!", "\u00e9", "ab "])
def test_very_long_stretches(c):
    plain, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for n in (1999, 2001, 19_990, 200_000):
        t = "x " + c * n + "y z"
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_knapsack_and_plan_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        prices = rng.random(7)
        value, pattern = packing.best_pattern(prices)
        best = max(
            sum(p * k for p, k in zip(prices, c, strict=True))
            for c in itertools.product(*(range(7 // (i + 1) + 1) for i in range(7)))
            if sum((i + 1) * k for i, k in enumerate(c)) <= 7
        )
        assert abs(value - best) < 1e-9 and abs(pattern @ prices - best) < 1e-9
        assert pattern @ np.arange(1, 8) <= 7
    demand = rng.integers(0, 5000, 64)
    plan = packing.cutting_stock(demand)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all(p @ np.arange(1, 65) <= 64 for p, _ in plan)
    bound = (demand @ np.arange(1, 65)) / 64
    assert sum(t for _, t in plan) <= bound * 1.06 + 64
    assert packing.cutting_stock(np.zeros(4, int)) == []


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "x9"]) for _ in range(rng.choice([1, 5, 40, 300, 2500])))) for i in range(160)]
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as length", "text as rank")
    got = packing.pack(docs, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    seen, filled = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    copies = defaultdict(int)
    for d, _ in rows:
        copies[d] += 1
    for d, v in seen.items():
        assert sorted(i for s, n in v for i in range(s, s + n)) == sorted(list(range(len(ids[d]))) * copies[d])
    assert set(seen) == set(ids)
    for v in filled.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(ids[d]) for d, _ in rows)
    assert len(filled) * 2048 < total * 1.1 + 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
