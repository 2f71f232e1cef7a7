"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opfold.llm import chat, copies, language, mixing, neighbours, phrases, quality, simhash, tokens, toxicity, warc
from opfold.llm.common import kept_by_score

DOCS = "doc_id long, text string, lang string, source string, fp long, n long, label int, mix_slot string, __id long"


def documents(spark, rows=None):
    long = "wörd and other words " * 20_000
    rows = rows if rows is not None else [(1, "the cat sat on the mat today", "en", "a"), (1, "the cat sat on the mat today", "en", "a"), (2, None, None, None), (None, "no id here at all", "en", "a"), (3, "", "en", "b"), (4, long, "en", "a"), (5, "\x00\n\t  ", "xx", ""), (6, long, None, "a")]
    return spark.createDataFrame([(*r, 9, 9, 1, "taken", 5) for r in rows], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 0), (4, 1, 0))):
    return spark.createDataFrame(list(rows), LABELS)


@pytest.mark.parametrize("rows", [None, []])
def test_every_document_operator_takes_odd_rows(spark, rows):
    docs, n = documents(spark, rows), 8 if rows is None else 0
    items = spark.createDataFrame([(1, "cat sat on the mat"), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    import public_tokenizers

    assert simhash.near_duplicates(docs).count() == n
    assert phrases.contamination(docs, items).count() == n
    assert phrases.contamination(docs, items.limit(0)).count() == n
    assert tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == n
    for found in (toxicity.toxicity(docs, labels(spark)), quality.quality(docs, labels(spark)), quality.quality(docs, labels(spark, []))):
        got = found.collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    got = language.languages(docs).collect()
    assert len(got) == n and all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 5))
    mixed = mixing.mix(docs)
    assert mixed.count() == n and sorted(mixed.columns) == sorted(set(mixed.columns))


def test_filters_keep_columns_and_rows(spark):
    docs = documents(spark)
    assert kept_by_score(docs, lambda texts: np.ones(len(texts)), lambda s: s > 0).count() == 8
    assert copies.drop_near_copies(docs.limit(0)).count() == 0
    kept = copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    # 2, 3 and 5 have no words but 5 has one; 4 and 6 are copies; 1 is there twice
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 2, 4, 5] and kept.filter("doc_id is null").count() == 1
    items = spark.createDataFrame([(1, "cat sat on the mat"), (2, "the cat sat on the mat today")], "item_id long, text string")
    clean = phrases.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.select("doc_id").collect()) == [0, 2, 3, 4, 5, 6]


def test_near_copies_are_rows_by_id_and_text(spark):
    """Different texts under one id, copies without an id, and rows that differ in another column only."""
    a, b, c = "one two three four five six seven", "quite another text than that one is", "a third text that nobody else has"
    rows = [(1, a, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (None, b, "en", "x"), (None, c, "en", "x"), (None, c, "en", "x"), (7, a, "en", "x"), (7, None, "en", "x"), (8, "", "en", "x"), (1, a, "de", "x")]
    kept = copies.drop_near_copies(documents(spark, rows)).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept), key=str) == sorted([(1, a), (5, b), (0, c), (7, None)], key=str)
    again = copies.drop_near_copies(documents(spark, rows[::-1])).collect()
    assert sorted(kept, key=str) == sorted(again, key=str)


def test_pages(spark):
    rows = [(1, "http://a.example/x y", None), (None, None, "z" * 200), (3, "http://www.a.example:80/é?q=1", "z" * 200), (2, "bad://[", "z" * 200), (2, "bad://[", "z" * 200), (4, "", "short"), (5, "http://b.example", "short")]
    pages = spark.createDataFrame([(*r, "d", 7) for r in rows], "page_id long, url string, html string, digest string, first long")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (0, 200, "revisit", 2), (3, 200, "revisit", 2), (2, 200, "response", None), (2, 200, "response", None), (4, 5, "response", None), (5, 5, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rep long")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in neighbours.nearest(df).collect()}
    assert [got[0, k] for k in range(1, 5)] == [(1, 1.0), (2, 1.0), (3, 0.707107), (50, 0.0)] and (0, 5) not in got
    assert [got[50, k][0] for k in range(1, 5)] == [3, 0, 1, 2]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_chats(spark):
    rows = [(1, 2, "assistant", "x<|im_end|>y\\<|im_sep|>"), (1, 1, "user", "</s>[INST] a<<SYS>>"), (1, 3, "assistant", None), (1, 3, "assistant", ""), (1, None, "tool\n<|im_start|>", "last\n"), (None, 1, None, "<\\\\|im_end|>"), (2, 1, "assistant", "<" * 3 + "|im_start|>")]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted int, ts string")
    chats = chat.format_chats(turns).cache()
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_chats(chats).collect()}
    assert back == {1: [("user", "</s>[INST] a<<SYS>>"), ("assistant", "x<|im_end|>y\\<|im_sep|>"), ("assistant", ""), ("assistant", ""), ("tool\n<|im_start|>", "last\n")], None: [("", "<\\\\|im_end|>")], 2: [("assistant", "<<<|im_start|>")]}
    masked = {r.conv_id: r.loss_text for r in chat.read_chats(chats).collect()}
    assert masked == {1: "x<|im_end|>y\\<|im_sep|>", None: "", 2: "<<<|im_start|>"}
    shifted = chats.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["chars"].alias("chars"))))
    assert {r.conv_id: r.loss_text for r in chat.read_chats(shifted).collect()} != masked  # the mask decides, not the roles
    assert chats.filter("conv_id = 1").first().formatted.count("<|im_start|>assistant") == 1
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_conversation_offsets(spark):
    turns = spark.range(1300).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    chats = chat.format_chats(turns).cache()
    assert chats.select(chat.masked_text()).first()[0] == "".join(f"t{k}" for k in range(1300) if k % 3)
    assert len(chat.read_chats(chats).first().turns) == 1300
