"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits, one for each bit position of the XXH64
hashes of its word shingles: the majority value. Two fingerprints link when at
most four bits differ.

Candidates. The fingerprint is cut in three segments of 22, 21 and 21 bits,
each padded to the 23 bits of the perfect binary Golay code. Four errors over
three segments leave some two segments with at most two errors between them
(pigeonhole). A segment is decoded to the codeword within three bits and, when
that one is exactly three bits away, also to the five codewords four bits
away; the blocks in which those six codewords differ from the segment
partition its 23 positions, hence two segments at most two bits apart always
share a codeword. The pair of codeword indices of two segments (24 bits, at
most 36 combinations, about 28 on average, for each of three pairs) are the
keys. Rows that share a key are compared exactly.

Scale. Exact copies have one fingerprint and are folded before any key is
made. In a bucket no pairs are emitted: a breadth-first search over the
popcount matrix, in blocks, yields at most (members - 1) links, the spanning
forest of the bucket's true links, so that the links written are bounded by
the keys and connected components lose nothing. Buckets stream in key order
out of Spark's external sort. A bucket that a sample shows to be large is dealt
out in slices, every two of which meet in a task of their own, so no link is
lost and no task holds more than two slices. Components come from alternating
large-star and small-star rounds on written tables; nodes with more than a
thousandth of all edges (fewer than a thousand nodes) are looked up by
broadcast, so that no task gets a hub's edges.

Null texts have no words; no words give fingerprint zero, linked like any
other. A null doc_id keeps its row and takes no part in the minimum. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opfold.llm.common import LOWER_AND_SPACES, written

SEED, WORDS, MAX_BITS = 42, 4, 4
#: Segments (first bit, bits) and the pairs of them that make keys.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the Golay code.
GENERATOR = 0b110001110101
#: Hashes counted at a time, so that a very long text needs little memory.
HASHES_AT_ONCE = 1 << 16
#: Members at which a bucket is dealt out in slices, one in how many are counted for that, and edges at which a node may be looked up by broadcast.
SLICE_ROWS, COUNTED, HUB_EDGES = 1 << 16, 64, 1000


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[list[int]]:
    """XXH64 of the word shingles of a text, in lists of bounded length."""
    parts = text.translate(LOWER_AND_SPACES).split()
    if not parts:
        return
    whole = b" ".join(parts)
    if len(parts) < words:
        yield [xxhash.xxh64_intdigest(whole, SEED)]
        return
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES_AT_ONCE):
        yield [digest(whole[a:b], SEED) for a, b in zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE], strict=True)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64 bits, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or b"", words):
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text hash and fingerprint (a signed long with the same bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(2), pa.binary())
            bits = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


@cache
def golay_patterns() -> np.ndarray:
    """For each of the 2048 syndromes up to six error patterns (-1: none).

    The first leads to the codeword within three bits; when it has weight
    three, the others are the patterns of weight four in the same coset.
    """

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    unit = np.array([syndrome(1 << i) for i in range(23)])
    out = np.full((2048, 6), -1, np.int64)
    out[0, 0] = 0
    filled = np.zeros(2048, int)
    filled[0] = 1
    weight = np.zeros(2048, int)

    def combos(k: int, first: int = 0, mask: int = 0, synd: int = 0) -> Iterator[tuple[int, int]]:
        if k == 0:
            yield mask, synd
            return
        for i in range(first, 23):
            yield from combos(k - 1, i + 1, mask | 1 << i, synd ^ int(unit[i]))

    for k in (1, 2, 3, 4):
        for mask, synd in combos(k):
            if k < 4 or weight[synd] == 3:
                out[synd, filled[synd]] = mask
                filled[synd] += 1
                if k < 4:
                    weight[synd] = k
    return out


@cache
def syndromes() -> np.ndarray:
    """The syndrome of every 23-bit word, as a table over its upper 12 and lower 11 bits."""
    table = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        table ^= np.where(table >> bit & 1, GENERATOR << (bit - 11), 0).astype(np.int32)
    return table.astype(np.int16)


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords near each 23-bit segment, and which of the six are there."""
    patterns = golay_patterns()[syndromes()[segment]]
    return (segment[:, None] ^ np.maximum(patterns, 0)) >> 11, patterns >= 0


def keys_of(fps: np.ndarray, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every unsigned fingerprint, or of those keys that one pair of segments makes."""
    near = [codewords((fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)) for first, bits in SEGMENTS]
    rows, keys = [], []
    for k, (a, b) in enumerate(PAIRS):
        if only not in (None, k):
            continue
        (ia, oka), (ib, okb) = near[a], near[b]
        key = (k << 24 | ia[:, :, None] << 12 | ib[:, None, :]).reshape(len(fps), -1)
        row, col = np.nonzero((oka[:, :, None] & okb[:, None, :]).reshape(len(fps), -1))
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS, cells: int = 1 << 22) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct unsigned fingerprints.

    Each member is compared with those not reached yet, in blocks of at most
    ``cells`` comparisons; nothing quadratic is kept.
    """
    links: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            step = max(1, cells // len(rest))
            block, frontier = frontier[:step], frontier[step:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= max_bits
            reached = near.any(axis=0)
            if reached.any():
                links += zip(block[near.argmax(axis=0)[reached]].tolist(), rest[reached].tolist(), strict=True)
                frontier = np.concatenate([frontier, rest[reached]])
                rest = rest[~reached]
    return links


def sliced(rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, large: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) with the keys in ``large`` (key: slices) replaced by keys of two slices each; a row goes to all that hold its slice.

    The new keys are hashes: if one meets another bucket, both are compared together.
    """
    if not large:
        return rows, keys
    names = np.array(sorted(large))
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    hit = names[at] == keys
    out_rows, out_keys = [rows[~hit]], [keys[~hit]]
    mix = np.int64(0x9E3779B1)
    for key in np.unique(keys[hit]).tolist():
        own = rows[keys == key]
        n = large[key]
        part = (ids[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
        for other in range(n):
            to = own[part != other] if n > 1 else own
            pair = np.minimum(part[part != other], other) * n + np.maximum(part[part != other], other)
            out_rows.append(to)
            out_keys.append(((key * mix ^ (pair + 1) * np.int64(0x85EBCA6B)) & np.int64(0x7FFFFFFF)))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def large_buckets(distinct: DataFrame, column: str, lanes: list[str], slice_rows: int, counted: int = COUNTED) -> dict[str, dict[int, int]]:
    """For each column of fingerprints the large buckets and in how many slices to deal them out, by the keys of one row in ``counted``.

    At most 100 000 buckets in all are named: where more are large, the threshold rises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(lanes)):
                fps = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fps), 4096):
                    keys, n = np.unique(keys_of(fps[at : at + 4096])[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int32)), pa.array(n)], names=["lane", "key", "n"])

    sample = distinct.filter(F.pmod(F.xxhash64(column, F.lit("counted")), F.lit(counted)) == 0)
    found = sample.select(*lanes).mapInArrow(run, "lane int, key int, n long").groupBy("lane", "key").agg(F.sum("n").alias("n")).filter(F.col("n") * counted > slice_rows)
    out: dict[str, dict[int, int]] = {c: {} for c in lanes}
    for r in found.orderBy(F.desc("n"), "lane", "key").limit(100_000).collect():
        out[lanes[r.lane]][r.key] = max(2, -(-r.n * counted // slice_rows))
    return out


def links_between(distinct: DataFrame, max_bits: int = MAX_BITS, slice_rows: int = SLICE_ROWS, counted: int = COUNTED) -> DataFrame:
    """Links (a, b) among the distinct values of column fp, enough to connect all that link."""
    if max_bits > MAX_BITS:
        raise ValueError("the segments guarantee candidates up to four differing bits")
    large = distinct.sparkSession.sparkContext.broadcast(large_buckets(distinct, "fp", ["fp"], slice_rows, counted)["fp"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, keys = sliced(*keys_of(part), part, large.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows].view(np.int64))], names=["key", "fp"])

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            """Links of whole buckets in key order."""
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            hit = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits if len(two) else np.zeros(0, bool)
            a, b = fps[two][hit].tolist(), fps[two + 1][hit].tolist()
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for x, y in spanning_links(fps[s : s + n], max_bits):
                    a.append(x)
                    b.append(y)
            pair = np.array([a, b], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pair.min(axis=0).view(np.int64) if len(a) else np.zeros(0, np.int64)), pa.array(pair.max(axis=0).view(np.int64) if len(a) else np.zeros(0, np.int64))], names=["a", "b"])

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if pending and keys[-1] == pending[0][0][0]:  # one bucket goes on over the whole batch
                pending.append((keys, fps))
                continue
            if pending:
                keys, fps = np.concatenate([p[0] for p in pending] + [keys]), np.concatenate([p[1] for p in pending] + [fps])
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            yield solve(keys[:cut], fps[:cut])
            pending = [(keys[cut:], fps[cut:])]
        if pending:
            yield solve(np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]))

    keyed = distinct.select("fp").mapInArrow(emit, "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(in_bucket, "a long, b long").distinct()


def star(edges: DataFrame, by: str, hub_edges: int) -> DataFrame:
    """One round over edges (u, v), u > v: hung on their least neighbours are the larger neighbours of each v (by "v"), or the smaller ones of each u (by "u").

    A node's edges meet its least neighbour in a join by node, but for hubs:
    nodes of more than ``hub_edges`` edges, and a thousandth of all, are few,
    and known to every task.
    """
    spark = edges.sparkSession
    other = "u" if by == "v" else "v"
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    degree = edges.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(hub_edges, edges.count() // 1000))).select(by)
    hubs = degree.join(low, degree[by] == low["u"], "left").select(degree[by].alias("x"), F.coalesce(low["m"], degree[by]).alias("m")).collect()
    if hubs:
        known = F.broadcast(spark.createDataFrame([(r.x, r.m) for r in hubs], "x long, m long"))
        near = edges.join(known, edges[by] == known.x)
        rest = edges.join(known, edges[by] == known.x, "left_anti")
    else:
        near, rest = None, edges
    least = low.select(F.col("u").alias("x"), "m")
    joined = rest.join(least, rest[by] == least.x, "left").select(other, F.coalesce("m", by).alias("m"))
    if near is not None:
        joined = joined.union(near.select(other, "m"))
    hung = joined.select(F.col(other).alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return hung.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, rounds: int = 60, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the component's least node.

    Alternating star rounds: each node's larger neighbours, then each node's
    smaller neighbours, are hung on its least one. Converges in a number of
    rounds that grows with the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    total = None
    for _ in range(rounds):
        edges = written(star(edges, "v", hub_edges), "edges")
        edges = written(star(edges, "u", hub_edges), "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if now[0] == now[2] and now == total:
            break
        total = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, text_hash, fp (signed) and component_id.

    component_id is the smallest doc_id reachable over links, itself included.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = written(components(links_between(distinct, max_bits)), "roots")
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "least", "root")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    of_fp = written(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return marked.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "component_id")
