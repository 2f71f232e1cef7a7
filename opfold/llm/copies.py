"""Near copies by a similarity of their word shingles: SimHash with wider sketches.

The 64-bit fingerprints of ``simhash`` link at four bits, which near copies
with a few edits in a hundred words miss: at a Jaccard similarity of 0.8 about
one bit in seven differs. Here every text gets a sketch of 256 majority bits
(two 128-bit hashes of each shingle); two texts are near copies when their sets
of shingles, compared exactly, have the given similarity.

Candidates share a Golay key of one of ``KEYED`` of the sketch's four words and
differ in no more bits than ``margin``: three standard deviations over what is
expected of sets of equal size with that similarity. A pair at a similarity of
0.8 misses one word's keys in about one of five cases (README), all three
words' in one of a hundred. The keys of one pair of segments of one word are
made, and their shuffle is left behind, at a time: nine rounds.

Sketches travel with their keys, so that a bucket is judged where it lies. It
yields each member's ``NEAREST`` candidates, never its pairs; where members have
more, it says which and adds a spanning forest of the bucket's candidates. The
nearest of all are compared exactly and join groups; then what else was yielded
between groups is. Between two members that both have more than was yielded
there may be pairs not seen yet. Both are in one component of the forests, a
family: these members alone meet by family, once each, with their shingles and
with sketches of 1024 bits; all pairs of different groups within the margin of
the latter (0.06 in similarity) are compared exactly where they lie, and of the
links one is written for every two groups that it joins. So no link is lost to
the choice of the nearest, and no pairs are written. A large family is dealt out
in slices, every two of which meet. After the rounds ``TOLD`` the rows carry
their family so far and whether they have more: two such members of one family
will meet there (both only grow), so later rounds leave them out, and edges
between families take the place of edges between members.

Of a component one row stays: that with the least id (rows without one come
last), then the least text hash. Rows are told apart by id and text, so
different texts under one id are judged each by itself. Null and empty texts
have the sketch zero and are copies of each other: one of them stays. Of rows
with one id and one text one stays, the least by the hash of its columns.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opfold.llm.common import LOWER_AND_SPACES, written
from opfold.llm.simhash import COUNTED, PAIRS, components, keys_of, large_buckets, shingle_hashes, sliced

WORDS, SIMILARITY, LANES, KEYED, NEAREST, FIRST, LONG = 5, 0.8, 4, 3, 2, 2, 16
#: Members of a bucket in the copies' search beyond which it (or a family, or one of so many shingles) is dealt out in slices, and up to which it is judged together with others.
SLICE_ROWS, SLICE_ITEMS, FEW = 1 << 14, 8 << 20, 48
SKETCH = [f"s{k}" for k in range(LANES)]
#: Rounds of the candidates' search after which open members and families are told to its rows.
TOLD = (0, 2)
#: Links up to which their components are found in the driver (1 MB).
FEW_LINKS = 1 << 16
HASHES_AT_ONCE = 1 << 15


def bits_apart(similarity: float) -> int:
    """Differing bits expected of two sets of equal size with that Jaccard similarity."""
    return math.ceil(64 * LANES * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def margin(similarity: float, lanes: int = LANES) -> int:
    """Differing bits that a pair of that similarity stays within, but for one in several hundred."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * lanes * p + 3 * math.sqrt(64 * lanes * p * (1 - p)))


def sketch(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The majority bits, as unsigned words."""
    parts = (text or b"").translate(LOWER_AND_SPACES).split()
    if not parts:
        return np.zeros(LANES, np.uint64)
    whole = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[words - 1 :].tolist() if len(parts) >= words else [len(whole)]
    counts = np.zeros(64 * LANES, np.int64)
    digest = xxhash.xxh3_128_digest
    for at in range(0, n, HASHES_AT_ONCE):
        shingles = [whole[a:b] for a, b in zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE], strict=True)]
        for half in (0, 1):
            octets = np.frombuffer(b"".join([digest(s, half) for s in shingles]), np.uint8).reshape(-1, 16)
            counts[half * 128 : half * 128 + 128] += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text hash and sketch words (signed longs with the same bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([sketch(t.as_py(), words) for t in pc.cast(batch.column(2), pa.binary())], np.uint64).reshape(-1, LANES).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(LANES))], names=["doc_id", "text_hash", *SKETCH])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in SKETCH))


def bits_between(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64)


def blocks_of(rows: np.ndarray, some: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the rows, in blocks, and their differing bits to all rows."""
    step = max(1, cells // max(1, len(rows)))
    for at in range(0, len(some), step):
        block = some[at : at + step]
        apart = np.zeros((len(block), len(rows)), np.uint16)
        for k in range(rows.shape[1]):
            apart += np.bitwise_count(rows[block, k][:, None] ^ rows[:, k][None, :])
        yield block, apart


def apart_families(open_: np.ndarray, families: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two places are not both open in one family, where they are compared anyway."""
    return ~(open_[x] & open_[y] & (families[x] == families[y]))


def nearest_in(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, open_: np.ndarray, families: np.ndarray, most: int, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of buckets in key order: pairs (x, y) of places that hold one of the ``nearest`` candidates of x in its bucket, and the places that have more."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    xs, ys, bs = [], [], []
    small = np.repeat(sizes <= FEW, sizes)
    for d in range(1, int(sizes[sizes <= FEW].max(initial=1))):
        x = np.flatnonzero((keys[:-d] == keys[d:]) & small[:-d])
        bits = bits_between(rows, x, x + d)
        x, bits = x[bits <= most], bits[bits <= most]
        new = apart_families(open_, families, x, x + d)
        x, bits = x[new], bits[new]
        xs += [x, x + d]
        ys += [x + d, x]
        bs += [bits, bits]
    more = []
    for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        for block, apart in blocks_of(rows[s : s + n], np.arange(n)):
            apart[np.arange(len(block)), block] = most + 1
            x, y = np.nonzero(apart <= most)
            new = apart_families(open_, families, s + block[x], s + y)
            x, y = x[new], y[new]
            bits = apart[x, y].astype(np.int64)
            order = np.lexsort((ids[s + y], bits, x))
            x, y, bits = x[order], y[order], bits[order]
            place = np.arange(len(x)) - np.searchsorted(x, x, "left")
            more.append(s + block[np.unique(x[place >= nearest])])
            xs.append(s + block[x[place < nearest]])
            ys.append(s + y[place < nearest])
            bs.append(bits[place < nearest])
    x, y, bits = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (xs, ys, bs))
    order = np.lexsort((ids[y], bits, x))
    x, y = x[order], y[order]
    place = np.arange(len(x)) - np.searchsorted(x, x, "left")
    return x[place < nearest], y[place < nearest], np.unique(np.concatenate([x[place >= nearest], *more]))


def forest_in(keys: np.ndarray, rows: np.ndarray, families: np.ndarray, most: int, more: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of families that candidates join in the buckets which hold one of the places ``more``: of each bucket a spanning forest, searched by breadth."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.unique(np.searchsorted(keys, keys[more], "left"))
    for s, e in zip(starts.tolist(), np.searchsorted(keys, keys[starts], "right").tolist(), strict=True):
        rest = np.arange(s, e)
        while len(rest) > 1:
            frontier, rest = rest[:1], rest[1:]
            while len(frontier) and len(rest):
                step = max(1, cells // len(rest))
                block, frontier = frontier[:step], frontier[step:]
                near = np.bitwise_count(rows[block][:, None, :] ^ rows[rest][None, :, :]).sum(axis=2, dtype=np.uint16) <= most
                reached = near.any(axis=0)
                if reached.any():
                    xs.append(families[block[near.argmax(axis=0)[reached]]])
                    ys.append(families[rest[reached]])
                    frontier, rest = np.concatenate([frontier, rest[reached]]), rest[~reached]
    x, y = np.concatenate(xs), np.concatenate(ys)
    return x[x != y], y[x != y]


def joins_in(ids: np.ndarray, groups: np.ndarray, rows: np.ndarray, sets: np.ndarray, most: int, similarity: float) -> list[tuple[int, int]]:
    """Links of that similarity that join all groups which any do; only candidates by their sketches are compared."""
    _, of = np.unique(groups, return_inverse=True)
    sizes, links = np.array([len(x) for x in sets]), []
    # within the largest group there is nothing to find
    for block, apart in blocks_of(rows, np.flatnonzero(of != np.bincount(of).argmax())):
        for x, bits in zip(block.tolist(), apart, strict=True):
            y = np.flatnonzero((bits <= most) & (of != of[x]) & (sizes > 0))
            if not len(y) or not sizes[x]:
                continue
            flat, own = np.concatenate(sets[y]), sets[x]
            there = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(there, np.concatenate([[0], np.cumsum(sizes[y])[:-1]]), dtype=np.int64)
            for z in y[both >= similarity * (sizes[x] + sizes[y] - both) - 1e-9].tolist():
                if of[z] != of[x]:
                    links.append((int(ids[x]), int(ids[z])))
                    of[of == of[z]] = of[x]
    return links


def whole_buckets(batches: Iterator[pa.RecordBatch], arrays) -> Iterator[list[np.ndarray]]:
    """Arrays (the first: keys) of whole buckets, out of batches in key order; a bucket that goes on waits for its end."""
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = arrays(batch)
        if waiting and own[0][-1] == waiting[0][0][0]:
            waiting.append(own)
            continue
        if waiting:
            own = [np.concatenate(c) for c in zip(*waiting, own, strict=True)]
        cut = int(np.searchsorted(own[0], own[0][-1], "left"))
        yield [c[:cut] for c in own]
        waiting = [[c[cut:] for c in own]]
    if waiting:
        yield [np.concatenate(c) for c in zip(*waiting, strict=True)]


def ids_of(rows: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of the sketch words."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return x << np.uint64(bits) | x >> np.uint64(64 - bits)

    out = np.full(len(rows), 42, np.uint64)
    for k in range(rows.shape[1]):
        out = turned((out + p5 + np.uint64(8)) ^ turned(rows[:, k] * p2, 31) * p1, 27) * p1 + p4
        out = (out ^ out >> np.uint64(33)) * p2
        out = (out ^ out >> np.uint64(29)) * p3
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def keyed(rows: DataFrame, lane: int, pair: int, large: dict[int, int]) -> DataFrame:
    """Rows (sketch words, family, open) beside each of the Golay keys that one pair of segments of one sketch word makes, in buckets; the last bit of ``key`` says whether the row is open.

    Rows move without their id, which the sketch gives, and most without a family: the sketch is nearly all that they weigh.
    """
    slices = rows.sparkSession.sparkContext.broadcast(large)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words = np.stack([part.column(k).to_numpy() for k in range(LANES)], axis=1).view(np.uint64)
                own, keys = sliced(*keys_of(np.ascontiguousarray(words[:, lane]), pair), ids_of(words), slices.value)
                take = pa.array(own)
                keys = keys.astype(np.int64) << 1 | part.column(LANES + 1).to_numpy(zero_copy_only=False)[own]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(c).take(take) for c in range(LANES + 1))], names=["key", *SKETCH, "family"])

    made = rows.select(*SKETCH, "family", "open").mapInArrow(emit, "key long, " + ", ".join(f"{c} long" for c in [*SKETCH, "family"]))
    return made.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")


def pairs_of(x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller first."""
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), bits]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs], names=["a", "b", "bits"])


def freed(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when its plan is collected: else those of several steps lie on the disk together."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def roots_of(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``components`` of the links (a, b), written; of no more than ``few`` links without the rounds, each of which takes several jobs and tables."""
    spark = links.sparkSession
    if links.count() > few:
        return written(components(links), "roots")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(*(c.to_pylist() for c in links.select("a", "b").toArrow().columns), strict=True):
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    nodes = list(parent)
    return written(spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())}), "node long, root long"), "roots")


def candidates(distinct: DataFrame, most: int, large: dict[str, dict[int, int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Among rows (id, sketch words): candidates (a, b, bits) by each member's nearest in every bucket, the members (id) that have more, and their families (id, family).

    The keys of one pair of segments of one sketch word at a time. What is open
    and its family are told to the rows after the rounds ``TOLD``: two open
    members of one family are no candidates in later rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
            rows = np.stack([batch.column(1 + k).to_numpy() for k in range(LANES)], axis=1).view(np.uint64)
            ids, family, key = ids_of(rows), batch.column(1 + LANES), batch.column(0).to_numpy()
            named = family.is_valid().to_numpy(zero_copy_only=False)
            return [key >> 1, ids, rows, key & 1 == 1, np.where(named, family.fill_null(0).to_numpy(), ids)]

        for keys, ids, rows, open_, families in whole_buckets(batches, arrays):
            x, y, more = nearest_in(keys, ids, rows, open_, families, most)
            p, q = forest_in(keys, rows, families, most, more)
            bits = np.concatenate([bits_between(rows, x, y), np.full(len(more), -1), np.full(len(p), -2)])
            yield pairs_of(np.concatenate([ids[x], ids[more], p]), np.concatenate([ids[y], ids[more], q]), bits)

    spark, found, families = distinct.sparkSession, None, None
    rows = distinct.select("id", *SKETCH, F.lit(None).cast("long").alias("family"), F.lit(False).alias("open"))
    rounds = [(lane, pair) for lane in range(KEYED) for pair in range(len(PAIRS))]
    for n, (lane, pair) in enumerate(rounds):
        one = written(keyed(rows, lane, pair, large[SKETCH[lane]]).mapInArrow(run, "a long, b long, bits long").distinct(), "candidates")
        found = one if found is None else found.unionByName(one)
        freed(spark)
        if n not in TOLD and n + 1 < len(rounds):
            continue
        # an edge joins two families as they were told; a family's name is an id of its members
        more, joins = found.filter("bits = -1").select(F.col("a").alias("id")).distinct(), found.filter("bits = -2").select("a", "b")
        families = roots_of(joins).select(F.col("node").alias("id"), F.col("root").alias("family"))
        freed(spark)
        if n + 1 < len(rounds):
            told = families.join(more.withColumn("open", F.lit(True)), "id", "left").select("id", "family", F.coalesce("open", F.lit(False)).alias("open"))
            rows = written(distinct.select("id", *SKETCH).join(told, "id", "left").select("id", *SKETCH, "family", F.coalesce("open", F.lit(False)).alias("open")), "told")
            freed(spark)
    pairs = written(found.filter("bits >= 0").distinct(), "pairs")
    return pairs, written(more, "more"), families


def links_apart(rows: DataFrame, most: int, similarity: float, slice_rows: int = SLICE_ROWS, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """Links (a, b) that join groups within a family, among rows (id, family, group, long, shingles)."""
    slices = F.ceil(F.greatest(F.count("*") / slice_rows, F.sum(F.size("shingles")) / slice_items)).cast("int")
    large = rows.groupBy("family").agg(slices.alias("slices")).filter("slices > 1")
    dealt = rows.join(large, "family", "left")
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    # a row goes wherever its slice meets another; two slices are one cell anyway
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: k != own)
    cells = F.when(F.col("slices") > 2, F.transform(others, lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    moved = dealt.withColumn("cell", F.explode(cells)).select(F.xxhash64("family", "cell").alias("key"), "id", "group", "long", "shingles")

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        sets = np.empty(batch.num_rows, object)
        for k, x in enumerate(batch.column(4)):
            sets[k] = x.values.to_numpy()
        return [*(batch.column(k).to_numpy() for k in range(3)), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, LONG), sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, groups, sketches_, sets in whole_buckets(batches, arrays):
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist() if len(keys) else []
            for s, e in pairwise(edges):
                links = joins_in(ids[s:e], groups[s:e], sketches_[s:e], sets[s:e], most, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

    return moved.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def long_sketch(shingles: np.ndarray) -> bytes:
    """1024 majority bits of a set of hashes: of each hash, mixed sixteen times."""
    counts, n = np.zeros(64 * LONG, np.int64), len(shingles)
    for at in range(0, n, 4096):
        state = shingles[at : at + 4096, None] + np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        state = (state ^ state >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        state = (state ^ state >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        state ^= state >> np.uint64(31)
        counts += np.unpackbits(state.view(np.uint8).reshape(len(state), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """id, shingles (distinct hashes, of 32 bits: they move with every pair) and long sketch of the nodes (id, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pc.cast(part.column(1), pa.binary())
                sets = [np.unique(np.array([h for hashes in shingle_hashes(t.as_py() or b"", words) for h in hashes], np.uint64)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(x.astype(np.uint32).view(np.int32)) for x in sets], pa.list_(pa.int32())), pa.array([long_sketch(x) for x in sets], pa.binary())], names=["id", "shingles", "long"])

    own = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"), F.col("text").cast("string").alias("text"))
    found = own.join(nodes, F.col("__id").eqNullSafe(nodes.doc_id) & (F.col("__hash") == nodes.text_hash))
    return found.select("id", "text").mapInArrow(run, "id long, shingles array<int>, long binary").dropDuplicates(["id"])


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose texts have that similarity; texts without a word are alike."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return links.select("a", "b").join(left, "a").join(right, "b").filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Every row's doc_id, text_hash, and kept_id and kept_hash of the row that stays of its component."""
    most = margin(similarity)
    marked = written(sketches(docs, words), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("least")
    distinct = written(marked.groupBy(*SKETCH).agg(least).select(F.xxhash64(*SKETCH).alias("id"), *SKETCH, "least", "least.doc_id", "least.text_hash"), "distinct")
    large = large_buckets(distinct, "id", SKETCH[:KEYED], SLICE_ROWS, COUNTED)
    pairs, more, families = candidates(distinct, most, large)
    linked = written(distinct.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), "linked")
    sets = written(shingle_sets(docs, linked.select("id", "doc_id", "text_hash"), words), "sets")
    freed(docs.sparkSession)
    both = pairs.select("a", "b", "bits", F.explode(F.array("a", "b")).alias("x"))
    ranked = both.withColumn("__n", F.row_number().over(Window.partitionBy("x").orderBy("bits", "a", "b")))
    first = written(ranked.filter(F.col("__n") <= FIRST).select("a", "b").distinct(), "first")
    sure = written(verified(first, sets, similarity), "sure")
    freed(docs.sparkSession)
    groups = roots_of(sure)
    grouped = written(linked.join(groups, linked.id == groups.node, "left").select("id", F.coalesce("root", "id").alias("group")), "groups")
    of_a, of_b = (grouped.select(F.col("id").alias(c), F.col("group").alias(f"of_{c}")) for c in "ab")
    open_rows = grouped.join(more, "id", "left_semi").join(families, "id")
    mixed = open_rows.groupBy("family").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x != y").select("family")
    open_rows = written(open_rows.join(mixed, "family", "left_semi").join(sets, "id"), "open")
    # pairs within a family are compared there
    family_a, family_b = (open_rows.select(F.col("id").alias(c), F.col("family").alias(f"family_{c}")) for c in "ab")
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of_a, "a").join(of_b, "b").filter("of_a != of_b")
    rest = rest.join(family_a, "a", "left").join(family_b, "b", "left").filter(~F.coalesce(F.col("family_a") == F.col("family_b"), F.lit(False))).select("a", "b")
    joined = verified(written(rest, "rest"), sets, similarity).union(links_apart(open_rows, margin(similarity, LONG), similarity))
    links = written(sure.unionByName(joined), "links")
    freed(docs.sparkSession)
    roots = roots_of(links)
    freed(docs.sparkSession)
    # only what links has a root: a row each of the linked sketches meets them, the rest is its own component
    named = written(linked.join(roots, linked.id == roots.node).select(*SKETCH, "least", "root"), "named")
    kept = named.groupBy("root").agg(F.min("least").alias("kept"))
    of_sketch = written(distinct.join(named.join(kept, "root").select(*SKETCH, "kept"), SKETCH, "left").select(*SKETCH, F.coalesce("kept", "least").alias("kept")), "components")
    return marked.join(of_sketch, SKETCH).select("doc_id", "text_hash", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """What a row is found again by: its id, null or not, and the hash of its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), text_hash.cast("string"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, one of each component, with the columns they had.

    The texts move once, by id and text hash, at every size: the rows to drop
    grow with the input, so they are never broadcast, and repeated rows are
    dropped in the same pass.
    """
    found = near_copies(docs, words, similarity).filter(~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))))
    gone = written(found.select(row_key(F.col("doc_id"), F.col("text_hash")).alias("__gone")).distinct(), "gone")
    freed(docs.sparkSession)
    own = docs.select(row_key(docs.doc_id, F.xxhash64(docs.text)).alias("__key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    kept = own.join(gone.hint("merge"), own["__key"] == gone["__gone"], "left_anti")
    order = F.xxhash64(*(F.col(f"row.`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()))
    return kept.groupBy("__key").agg(F.min_by("row", order).alias("row")).select("row.*")
