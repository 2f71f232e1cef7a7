"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where adjacent
turns have one role, and concatenated:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n...

``<|im_sep|>`` stands between the texts of merged turns. Control strings inside
texts (these three, any other ``<|name|>``, and the marks of other templates)
get a backslash after their first character, one more if they already have
some, so that no text can imitate a mark and reading removes exactly what
writing added. Roles are URL-encoded. The loss mask covers the texts of the
role ``assistant``, without marks, as character spans of the formatted text.

Order: by turn, nulls last; equal turns by role, then text. Repeated rows are
turns of their own. Null text and null role count as empty. A null conv_id is a
conversation of its own. One conversation is one row, so its formatted text
must fit in 2 GB, or 500 million characters where the mask is read; offsets are
summed in blocks of 512 turns, in linear time and memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows the first character of a control string (fixed values).
CONTROL = r"\|[A-Za-z0-9_]*\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
BLOCK = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans (array of start, chars; from 0) of every conversation."""
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNull().alias("unknown"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        ).alias("t"),
    )
    sorted_turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # merge: a turn opens a block unless the one before has its role
    pieces = sorted_turns.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.when(i == 0, F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")))
                .when(F.element_at("ts", F.greatest(i, F.lit(1)))["role"] == t["role"], F.lit(SEP))
                .otherwise(F.concat(F.lit(END + START), F.url_encode(t["role"]), F.lit("\n")))
                .alias("mark"),
                escape(t["text"]).alias("body"),
                (t["role"] == loss_role).alias("loss"),
            ),
        ).alias("ps"),
    )
    lengths = pieces.withColumn("ls", F.transform("ps", lambda p: (F.length(p["mark"]) + F.length(p["body"])).cast("long")))
    bases = lengths.withColumn(
        "bs",
        F.expr(
            f"aggregate(sequence(0, (size(ls) - 1) div {BLOCK}), struct(0L as s, cast(array() as array<bigint>) as a), (x, c) -> struct(x.s + aggregate(slice(ls, int(c * {BLOCK} + 1), {BLOCK}), 0L, (y, l) -> y + l) as s, concat(x.a, array(x.s)) as a), x -> x.a)"
        ),
    )
    starts = bases.withColumn(
        "at",
        F.expr(f"flatten(transform(bs, (b, c) -> aggregate(slice(ls, int(c * {BLOCK} + 1), {BLOCK}), struct(b as s, cast(array() as array<bigint>) as a), (x, l) -> struct(x.s + l as s, concat(x.a, array(x.s)) as a), x -> x.a)))"),
    )
    return starts.select(
        "conv_id",
        F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.filter(F.transform("ps", lambda p, i: F.when(p["loss"], F.struct((F.element_at("at", i + 1) + F.length(p["mark"])).alias("start"), F.length(p["body"]).cast("long").alias("chars")))), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text; parsed from ``formatted`` alone) and loss_text (all unescaped text under ``loss_spans``)."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            F.url_decode(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            F.transform(F.split(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2), r"<\|im_sep\|>", -1), unescape).alias("texts"),
        ),
    )
    return chats.select("conv_id", "formatted", masked_text().alias("loss_text"), parsed.alias("bs")).select(
        "conv_id",
        "formatted",
        F.flatten(F.transform("bs", lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), x.alias("text"))))).alias("turns"),
        "loss_text",
    )


def masked_text() -> Column:
    """The unescaped text of ``formatted`` under ``loss_spans``.

    Cut from four bytes a character, where a place is found at once however
    long the text; the mark before each piece keeps the decoder from taking a
    piece's own first character for one.
    """
    mark = F.lit(b"\x00\x00\xfe\xff")

    def pieces(wide: Column) -> Column:
        return F.transform("loss_spans", lambda s: unescape(F.decode(F.concat(mark, F.substring(wide, (s["start"] * 4 + 1).cast("int"), (s["chars"] * 4).cast("int"))), "UTF-32")))

    return F.element_at(F.transform(F.array(F.encode("formatted", "UTF-32")), lambda wide: F.array_join(pieces(wide), "")), 1)
