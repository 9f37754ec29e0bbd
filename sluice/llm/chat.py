"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns each content part into text: text parts are escaped,
attachments become a control string that stands for them, in order.  The
attachments' references and the tokens they expand to are recorded beside
the text.  One row comes out per conversation, which is the unit a
training job reads; a conversation is gathered in one task, since it is
one value of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(part: Column) -> Column:
    """Text of one part: escaped text, or the control string of an attachment."""
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), escape(F.coalesce(part["type"], F.lit("unknown"))), F.lit("|>"))
    )


def expanded(part: Column) -> Column:
    """Tokens an attachment expands to: image patches, audio frames, document pages; others none."""
    return F.coalesce(
        F.when(part["type"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS),
        F.lit(0).cast("long"),
    )


def text_parts(text: Column) -> Column:
    """A message's plain text as its only content part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *none))


def format_chat(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation from ``(conv_id, turn, role, parts array<PART>)``.

    Returns ``conv_id, formatted, loss_mask, attachments, attachment_tokens``.
    ``loss_mask`` has an entry per turn: null, or the start (from 0) and
    length, in code points of ``formatted``, of a trained message's content.
    ``attachments`` lists ``(turn, part, type, ref, tokens)`` in order.

    Turns with equal numbers go by role, then content; a null turn comes
    first, a null role or part list is empty, a null ``conv_id`` is a
    conversation of its own.  Repeated rows are repeated turns.
    """
    role = escape(F.coalesce("role", F.lit("")))
    turns = messages.select(
        "conv_id",
        "turn",
        F.replace(role, F.lit("\n"), F.lit(NEWLINE)).alias("head"),
        F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit), "").alias("body"),
        F.col("role").eqNullSafe(trained).alias("trained"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"),
    ).withColumn("said", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    before = F.coalesce(
        F.sum(F.char_length("said").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
    )
    placed = turns.withColumns({"k": F.row_number().over(order), "at": before})
    span = F.when(
        F.col("trained"),
        F.struct(
            (F.col("at") + len(START) + F.char_length("head") + 1).alias("start"),
            F.char_length("body").cast("long").alias("length"),
        ),
    )
    numbered = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.struct(
                F.col("turn").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")
            ),
        ),
        lambda p: ~p["type"].eqNullSafe("text"),
    )
    item = F.struct("k", "said", span.alias("span"), numbered.alias("attached"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = whole.select(
        "conv_id",
        F.array_join(F.transform("items", lambda x: x["said"]), "").alias("formatted"),
        F.transform("items", lambda x: x["span"]).alias("loss_mask"),
        F.flatten(F.transform("items", lambda x: x["attached"])).alias("attachments"),
    )
    return out.withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    )


def read_chat(chats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Turns read back from ``format_chat``'s text and mask: ``(conv_id, k, role, text, loss_text)``.

    ``loss_text`` is null outside the mask.  Attachments stand in the text
    as their control strings.  Columns of ``chats`` named in ``keep`` go along.
    """
    said = F.split("formatted", START.replace("|", r"\|"))
    turns = chats.select(
        "conv_id",
        *keep,
        F.posexplode(F.arrays_zip(F.slice(said, F.lit(2), F.greatest(F.size(said) - 1, F.lit(0))).alias("said"), F.col("loss_mask").alias("span"))).alias("k", "x"),
    ).select("conv_id", *keep, "k", "x.said", "x.span")
    order = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("said").cast("long") + len(START)).over(order), F.lit(0).cast("long"))
    head = F.substring_index("said", "\n", 1)
    turns = turns.withColumns({"at": at + len(START), "head": head})
    tail = F.char_length("said") - F.char_length("head") - 1 - len(END) - 1
    inside = F.substr("said", (F.col("span.start") - F.col("at") + 1).cast("int"), F.col("span.length").cast("int"))
    return turns.select(
        "conv_id",
        *keep,
        "k",
        unescape(F.replace("head", F.lit(NEWLINE), F.lit("\n"))).alias("role"),
        unescape(F.substr("said", F.char_length("head") + 2, tail)).alias("text"),
        F.when(F.col("span").isNotNull(), unescape(inside)).alias("loss_text"),
    )
