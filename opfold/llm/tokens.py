"""Token counts by a map-side two-tier lookup.

A byte-level BPE tokenizer splits a text into pre-tokens and merges inside each
one alone, so a text's token count is the sum over its pre-tokens. Tier one is
a compact table of the lengths of frequent pre-tokens, broadcast once; tier two
is a cache of bounded size in every Python worker, filled by encoding the
misses with the tokenizer library (it holds ``cache_bytes`` of pre-tokens of up
to 256 characters; longer ones are encoded each time). No pre-token is ever shuffled, and the
counts do not depend on what the table or a cache holds.

The table's entries come from a bounded sample of whole documents (parameter
``sample_docs``), which only decides how fast a lookup is.

Added tokens (such as ``<|endoftext|>``) inside a text count as one token each,
the library's default; texts with code points on which the two pattern engines'
Unicode tables may differ are encoded whole by the library. A null text counts
as empty: 0 bytes, 0 tokens. Every row gives one row, repeated rows too.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern, as the tokenizer's family defines it (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same on the code points of PLAIN, where the standard library's classes agree.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-՗]*")
TABLE_ENTRIES, SAMPLE_DOCS, CACHE_BYTES, LONG_PIECE, TEXTS_AT_ONCE = 1 << 15, 4000, 64 << 20, 256, 64


def pieces_of(text: str) -> list[str] | None:
    """The pre-tokens of a text; None: only the library may split it."""
    if PLAIN.fullmatch(text):
        return FAST.findall(text)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        return None
    return PATTERN.findall(text)


class Counts:
    """Token counts of texts by table, cache and library."""

    def __init__(self, tokenizer_json: str, frequent: tuple[str, bytes] = ("", b""), cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        added = [x["content"] for x in json.loads(tokenizer_json)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.frequent = dict(zip(frequent[0].split("\0"), frequent[1], strict=True)) if frequent[1] else {}
        self.known = dict(self.frequent)
        self.most, self.held = cache_bytes, 0

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        totals, split, whole = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.added and self.added.search(text):
                parts = self.added.split(text)
                totals[k] += len(parts) - 1
            for part in parts:
                (split if (own := pieces_of(part)) is not None else whole).append((k, own if own is not None else part))
        missing = list(set().union(*(own for _, own in split)).difference(self.known))
        size = sum(map(len, missing))
        if self.held + size > self.most:
            self.known, self.held = dict(self.frequent), 0
            missing = list(set().union(*(own for _, own in split)).difference(self.known))
            size = sum(map(len, missing))
        self.known.update(zip(missing, self.encode(missing), strict=True))
        self.held += size
        look = self.known.__getitem__
        for k, own in split:
            totals[k] += sum(map(look, own))
        for piece in [p for p in missing if len(p) > LONG_PIECE]:
            self.held -= len(piece)
            del self.known[piece]
        for (k, _), n in zip(whole, self.encode([part for _, part in whole]), strict=True):
            totals[k] += n
        return totals


_worker: dict[int, Counts] = {}


def frequent_lengths(docs: DataFrame, tokenizer_json: str, entries: int = TABLE_ENTRIES, sample_docs: int = SAMPLE_DOCS) -> tuple[str, bytes]:
    """The commonest pre-tokens of a bounded sample, NUL-joined, and their token counts, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(pieces_of(text.as_py()) or ())
        top = found.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    stride = max(1, -(-docs.count() // sample_docs))
    sample = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(stride)) == 0)).select(F.col("text").cast("string")).limit(2 * sample_docs)
    total: Counter[str] = Counter()
    for row in sample.repartition(4).mapInArrow(run, "piece string, n long").toLocalIterator():
        total[row.piece] += row.n
    top = [p for p, n in total.most_common(entries) if n > 1 and "\0" not in p]
    lengths = Counts(tokenizer_json).encode(top)
    kept = [(p, n) for p, n in zip(top, lengths, strict=True) if n < 256]
    return "\0".join(p for p, _ in kept), bytes(n for _, n in kept)


def token_counts(docs: DataFrame, tokenizer_path: str, table_entries: int = TABLE_ENTRIES, sample_docs: int = SAMPLE_DOCS, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, by the tokenizer file at ``tokenizer_path``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, frequent_lengths(docs, tokenizer_json, table_entries, sample_docs)))
    key = hash((tokenizer_path, shared.id if hasattr(shared, "id") else id(shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker.get(key)
        if counter is None:  # the cache lives as long as the worker, over its tasks
            _worker.clear()
            counter = _worker[key] = Counts(*shared.value, cache_bytes)
        for batch in batches:
            totals: list[int] = []
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                totals += counter.count(batch.column(2).slice(at, TEXTS_AT_ONCE).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(totals, np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
