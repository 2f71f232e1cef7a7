"""Benchmark decontamination over a positional inverted index.

The index is partitioned by document, as search engines do it: a segment holds
the documents of one Arrow batch (or part of it) laid out on one axis of
positions, and for each term the ascending positions of its tokens. Segments
are rows of a table in the shared folder, so a lost executor costs a re-read,
no posting is ever shuffled, and a term that a third of all tokens share is
spread over all segments.

A search takes the phrases of one block of test items (of bounded bytes) to
every segment. Phrases are found by one of their terms, the least common among
the phrases, so a segment looks only at those whose term it has. For each of
them it starts from the rarest term's postings, shifts them by the term's
offset and intersects them with the offset-adjusted postings of the next rarer
terms until none is left. ``proximity`` finds terms within a span in any order,
over the same stored index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lowered. A null text has no words. Items without words, or without an id, have
no windows; rows with the same item_id are one item. Every document row gives
one row of results, repeated rows too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opfold.llm.common import ASCII_LOWER, written

WINDOW, MIN_ITEMS = 8, 2
#: Words at which a segment is closed, and bytes of test items in a block.
SEGMENT_WORDS, BLOCK_BYTES = 1 << 20, 4 << 20
#: Bytes that end a word become spaces.
WORD_BYTES = bytes(ASCII_LOWER[b] if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 32 for b in range(256))
INDEX = "docs array<long>, hashes array<long>, starts array<int>, words array<int>, terms array<binary>, ends array<int>, postings array<int>"
HITS = "doc_id long, text_hash long, segment long, at int, n_words long, items array<string>, spans array<struct<first:int,last:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Segment:
    """Postings of some documents; documents are apart by ``gap`` positions."""

    def __init__(self, terms: list[bytes], ends: np.ndarray, postings: np.ndarray, starts: np.ndarray, words: np.ndarray):
        self.at = {t: i for i, t in enumerate(terms)}
        self.ends, self.all, self.starts, self.words = ends, postings, starts, words

    def postings(self, term: bytes) -> np.ndarray:
        i = self.at.get(term)
        return self.all[:0] if i is None else self.all[self.ends[i - 1] if i else 0 : self.ends[i]]

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the terms follow each other."""
        lists = sorted(((self.postings(t), k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for own, k in lists[1:]:
            if not len(found):
                break
            i = np.searchsorted(own, found + k)
            found = found[own[np.minimum(i, len(own) - 1)] == found + k]
        return found

    def near(self, terms: tuple[bytes, ...], span: int) -> list[tuple[int, int]]:
        """Least intervals of at most ``span`` positions that hold all the terms, in any order."""
        need = sorted({t: self.postings(t) for t in terms}.items(), key=lambda x: len(x[1]))
        if not need or not len(need[0][1]):
            return []
        marks = []
        rare = need[0][1]
        for k, (_, own) in enumerate(need):  # only what lies near the rarest term can take part
            i = np.searchsorted(rare, own - span)
            close = own[rare[np.minimum(i, len(rare) - 1)] <= own + span] if k else own
            marks += [(int(p), k) for p in close]
        marks.sort()
        out, last, left = [], dict[int, int](), 0
        for p, k in marks:
            last[k] = p
            if len(last) == len(need) and p - (low := min(last.values())) < span and low != left - 1:
                out.append((low, p))
                left = low + 1
        return out

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, gap: int = 64) -> DataFrame:
    """The segments, a row each. ``vocabulary``: only these terms' postings are kept.

    ``gap`` positions part two documents; phrases and spans up to it never
    reach over.
    """
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def segment(ids: list, hashes: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        terms = {t: i for i, t in enumerate(sorted(kept.value))} if kept else {}
        lengths = np.array([len(w) for w in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]])
        look = terms.get if kept else (lambda w: terms.setdefault(w, len(terms)))
        codes = np.fromiter((-1 if (c := look(w)) is None else c for text in texts for w in text), np.int32, int(lengths.sum()))
        places = (np.arange(len(codes)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)).astype(np.int32)
        own = np.flatnonzero(codes >= 0)
        own = own[np.argsort(codes[own], kind="stable")]
        counts = np.bincount(codes[own], minlength=len(terms))
        there = np.flatnonzero(counts)
        names = list(terms)
        columns = [ids, hashes, starts.astype(np.int32), lengths.astype(np.int32), [names[i] for i in there], np.cumsum(counts[there]).astype(np.int32), places[own]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 2]

        def lists(values, kind):
            flat = pa.array(values, kind.value_type)
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat).cast(kind)

        return pa.RecordBatch.from_arrays([lists(c, k) for c, k in zip(columns, kinds, strict=True)], names=["docs", "hashes", "starts", "words", "terms", "ends", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts, n = [], [], [], 0
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.cast(batch.column(2), pa.binary()), strict=True):
                ids.append(doc_id)
                hashes.append(text_hash)
                texts.append(words_of(text.as_py()))
                n += len(texts[-1]) + gap
                if n >= SEGMENT_WORDS:
                    yield segment(ids, hashes, texts)
                    ids, hashes, texts, n = [], [], [], 0
            if ids:
                yield segment(ids, hashes, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


def stored_index(docs: DataFrame, vocabulary: set[bytes] | None = None, gap: int = 64) -> DataFrame:
    """The index in the shared folder; every segment has a number that stays."""
    return written(build_index(docs, vocabulary, gap).withColumn("segment", F.monotonically_increasing_id()), "postings")


def windows_of(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def by_rarest(phrases: list[tuple[bytes, ...]]) -> dict[bytes, list[int]]:
    """The phrases' numbers by their term that the fewest phrases hold."""
    held = Counter(t for p in phrases for t in set(p))
    out: dict[bytes, list[int]] = {}
    for k, p in enumerate(phrases):
        out.setdefault(min(p, key=lambda t: (held[t], t)), []).append(k)
    return out


def segment_of(batch: pa.RecordBatch, row: int) -> tuple[Segment, list[pa.Array], int]:
    """A row of the stored index: the segment, its documents' ids and text hashes, its number."""
    c = [batch.column(k)[row].values for k in range(7)]
    return Segment(c[4].to_pylist(), c[5].to_numpy(), c[6].to_numpy(), c[2].to_numpy(), c[3].to_numpy()), c[:2], batch.column(7)[row].as_py()


def search(index: DataFrame, phrases: dict[tuple[bytes, ...], list[str]]) -> DataFrame:
    """For every document of the index the names of the phrases in it and the merged spans of their words."""
    own = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = list(own.value)
        terms = by_rarest(listed)
        for batch in batches:
            for row in range(batch.num_rows):
                part, c, segment = segment_of(batch, row)
                starts, words = part.starts, part.words
                where, ends, which = [], [], []
                for k in sorted(k for t in (terms if len(terms) < len(part.at) else part.at) if t in part.at and t in terms for k in terms[t]):
                    phrase = listed[k]
                    if len(found := part.phrase(phrase)):
                        where.append(found)
                        ends.append(found + len(phrase) - 1)
                        which.append(np.full(len(found), k))
                items: list[list[str]] = [[] for _ in words]
                spans: list[list[dict[str, int]]] = [[] for _ in words]
                if where:
                    names = list(own.value.values())
                    first, last, kind = np.concatenate(where), np.concatenate(ends), np.concatenate(which)
                    doc = part.document(first)
                    both = np.unique(np.stack([doc, kind]), axis=1)
                    got: dict[int, set[str]] = {}
                    for d, k in both.T.tolist():
                        got.setdefault(d, set()).update(names[k])
                    for d, x in got.items():
                        items[d] = sorted(x)
                    order = np.lexsort((last, first))
                    first, last, doc = first[order], np.maximum.accumulate(last[order]), doc[order]
                    new = np.concatenate([[True], (first[1:] > last[:-1] + 1) | (doc[1:] != doc[:-1])])
                    at = np.flatnonzero(new)
                    for d, a, b in zip(doc[at].tolist(), first[at].tolist(), last[np.append(at[1:] - 1, len(last) - 1)].tolist(), strict=True):
                        spans[d].append({"first": a - int(starts[d]), "last": b - int(starts[d])})
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [c[0], c[1], pa.array(np.full(n, segment, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(words.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                    names=["doc_id", "text_hash", "segment", "at", "n_words", "items", "spans"],
                )

    return index.mapInArrow(run, HITS)


def proximity(index: DataFrame, asked: dict[str, tuple[bytes, ...]], span: int) -> DataFrame:
    """doc_id, text_hash, segment, at, name, first, last: the least intervals of at most ``span`` words that hold all terms of a named set, in any order.

    ``index``: all terms' postings, its gap at least ``span``. Only hits are
    written. Names without terms find nothing; a term given twice counts once.
    """
    own = index.sparkSession.sparkContext.broadcast({name: terms for name, terms in asked.items() if terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, (ids, hashes), segment = segment_of(batch, row)
                found = [(name, a, b) for name, terms in own.value.items() if all(t in part.at for t in terms) for a, b in part.near(terms, span)]
                first = np.array([a for _, a, _ in found], np.int64)
                doc = part.document(first)
                base = part.starts[doc] if len(found) else first
                columns = [ids.take(pa.array(doc)), hashes.take(pa.array(doc)), pa.array(np.full(len(found), segment, np.int64)), pa.array(doc.astype(np.int32)), pa.array([n for n, _, _ in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((first - base).astype(np.int32)), pa.array((np.array([b for _, _, b in found], np.int64) - base).astype(np.int32))], names=["doc_id", "text_hash", "segment", "at", "name", "first", "last"])

    return index.mapInArrow(run, "doc_id long, text_hash long, segment long, at int, name string, first int, last int")


def item_blocks(items: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, dict[tuple[bytes, ...], list[str]]]]:
    """(number of blocks, phrases of one block): at most about ``block_bytes`` of items each are on the driver."""
    own = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        phrases: dict[tuple[bytes, ...], dict[str, None]] = {}
        for row in own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator():
            for w in windows_of(words_of(row.text.encode()), n):
                phrases.setdefault(w, {})[row.item_id] = None
        yield blocks, {w: list(x) for w, x in phrases.items()}


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, n_items, items, spans, contaminated.

    Items of one block need only their own terms' postings; more blocks than
    one share a full index, and the hits, of hit documents only, are merged.
    """
    index, found, blocks = None, None, 1
    for blocks, phrases in item_blocks(items, n, block_bytes):
        if index is None:
            vocabulary = {t for p in phrases for t in p} if blocks == 1 else None
            index = stored_index(docs, vocabulary, max(64, n))
        hits = search(index, phrases)
        if blocks > 1:  # only the documents that a block hits; a block's hits are written before the next block's phrases come
            hits = written(hits.filter(F.size("items") > 0), "hits")
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        joined = found.groupBy("segment", "at").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        rows = index.select("segment", F.posexplode(F.arrays_zip("docs", "hashes", "words")).alias("at", "d")).select("segment", "at", F.col("d.docs").alias("doc_id"), F.col("d.hashes").alias("text_hash"), F.col("d.words").cast("long").alias("n_words"))
        none = [F.coalesce(F.col(c), F.array().cast(dict(joined.dtypes)[c])).alias(c) for c in ("items", "spans")]
        found = rows.join(joined, ["segment", "at"], "left").select("doc_id", "text_hash", "segment", "at", "n_words", *none)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["last"], s["last"]).alias("last"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["last"] + 1, s["first"]) + 1).cast("long")).alias("n")),
        lambda a: a["n"],
    )
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), n_items.alias("n_items"), F.array_sort("items").alias("items"), "spans", (n_items >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """The documents that are not contaminated, with the columns they had.

    Rows are found again by id and text, nulls included.
    """
    bad = written(contamination(docs, items, n, min_items).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["__id"]) & (F.xxhash64(docs.text) == bad["__hash"]), "left_anti")
