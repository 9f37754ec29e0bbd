import hashlib

from pyspark.sql import functions as F

from sluice.llm import chat

TRICKY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "a\n<|nl|>\\n", "", None, "é🙂" * 3, "\\\\<|im_end|>\n<|im_start|>", "x" * 50000]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY if t is not None], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_round_trip_mask_and_order(spark):
    roles = ["user", "assistant", "system", None, "assistant\n<|x|>", "assistant"]
    rows = [(c, t, roles[(c + t) % 6], TRICKY[(3 * c + t) % len(TRICKY)], "clash") for c in range(9) for t in range(11)]
    rows += [(50, 1, "assistant", "b", "x"), (50, 1, "assistant", "a", "x"), (50, None, "user", "first", "x"), (None, 0, "assistant", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string")
    chats = chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))
    whole = {r.conv_id: r for r in chats.collect()}
    read = {}
    for r in chat.read_chat(chats).collect():
        read.setdefault(r.conv_id, []).append(r)
    for c in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        got = sorted(read[c], key=lambda r: r.k)
        assert [(r.role, r.text) for r in got] == [(w[2] or "", w[3] or "") for w in want]
        assert [r.loss_text for r in got] == [(w[3] or "") if w[2] == "assistant" else None for w in want]
        f = whole[c].formatted
        masked = "".join(f[m.start : m.start + m.length] for m in whole[c].loss_mask if m)
        assert masked == "".join((w[3] or "").replace("\\", "\\\\").replace("<|", "<\\|") for w in want if w[2] == "assistant")


def test_parts_become_placeholders_in_order(spark):
    part = f"array<{chat.PART}>"
    rows = [
        (1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "s/1.png", 57, 28, None, None), ("text", "and", None, None, None, None, None), ("audio", None, "s/2.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 3), ("hologram", None, "h", None, None, None, None), (None, "lost", None, None, None, None, None)]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert "see <\\|image|><|image|>and<|audio|>" in got[1].formatted
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, 1, "image", "s/1.png", 3), (0, 3, "audio", "s/2.wav", 38), (1, 0, "document", "d.pdf", 3072), (1, 1, "hologram", "h", 0), (1, 2, None, None, 0)]
    assert got[1].attachment_tokens == 3 + 38 + 3072
    assert got[2].formatted == "<|im_start|>user\n<|im_end|>\n" and got[2].loss_mask == [None]


def test_plan_has_no_python_and_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.read_chat(chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text")))))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
