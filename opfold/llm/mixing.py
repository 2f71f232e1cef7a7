"""Mixing sources to target weights by Pfair scheduling.

Every source is cut in blocks of ``block_docs`` documents, in an order given by
a hash. The k-th block of a source of weight w is released at slot
floor((k - 1) / w) and due at slot ceil(k / w); the schedule takes, at each
slot, the released block with the earliest deadline. Weights that sum to one
make this feasible, so that after every slot each source is less than one block
away from its share.

Weights are taken as exact fractions, so the distance from the target doesn't
grow with the input. When a source runs out, the others' weights are scaled up
and a new phase begins: as many phases as there are sources, whatever the
number of documents. Nothing is dropped or repeated.

Scale. Ranks within a source come from counts of (source, bucket) and a window
within a bucket, so that a source with a third of all rows is spread over 1024
tasks. The driver holds the sources' counts and deals out the blocks, one
document in ``block_docs``, which it writes to the shared folder in chunks of
bounded size; they meet the rows by (source, bucket), as the ranks do.

A null source is a source of its own. Repeated rows are documents of their own.
An empty table gives no rows. Columns named like this operator's own are
replaced by them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import batched
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opfold.llm.common import shared_path

BLOCK_DOCS, BUCKETS, MAX_SOURCES, CHUNK_BLOCKS = 32, 1024, 512, 1 << 18
OUTPUT = ("mix_slot", "mix_block", "mix_index", "mix_phase", "mix_release", "mix_deadline")


def quotas(weights: dict[int, float], period: int) -> dict[int, int]:
    """Slots of a period for each source: at least one, in proportion, in total the period."""
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def exact_shares(weights: dict[int, float]) -> dict[int, int]:
    """Integers in exactly the proportion of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * scale) for s, x in parts.items()}


def slots(blocks: dict[int, int], weights: dict[int, float], shares: Callable[[dict[int, float]], dict[int, int]] = exact_shares) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(slot, source, block, phase, release, deadline) of every slot: earliest deadline first among released blocks."""
    start, phase = 0, 0
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    while left:
        share = shares({s: weights[s] for s in left})
        total = sum(share.values())
        waiting = [(0, -(-total // q), s, 1) for s, q in sorted(share.items())]
        ready: list[tuple[int, int, int, int, int]] = []
        heapq.heapify(waiting)
        taken, slot = dict.fromkeys(left, 0), 0
        while True:
            while waiting and waiting[0][0] <= slot:
                _, due, s, k = heapq.heappop(waiting)
                # among equal deadlines the one whose window overlaps its next one first, then the heavier
                heapq.heappush(ready, (due, 0 if k * total % share[s] else 1, -share[s], s, k))
            due, _, _, s, k = heapq.heappop(ready)
            if due <= slot:
                raise RuntimeError("a deadline was missed")
            yield start + slot, s, done[s] + k - 1, phase, start + (k - 1) * total // share[s], start + due
            slot, taken[s] = slot + 1, k
            if k == left[s]:
                break
            heapq.heappush(waiting, (k * total // share[s], -(-(k + 1) * total // share[s]), s, k + 1))
        for s, n in taken.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start, phase = start + slot, phase + 1


def schedule(blocks: dict[int, int], weights: dict[int, float], period: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """With weights on a grid of ``period`` slots: phases (source, phase, first block, end block, first slot, quota) and places (source, phase, k in the period, slot in the period)."""
    used: list[dict[int, int]] = []

    def grid(own: dict[int, float]) -> dict[int, int]:
        used.append(quotas(own, period))
        return used[-1]

    begins: dict[int, int] = {}
    runs: dict[tuple[int, int], list[int]] = {}
    places = []
    for slot, s, block, phase, _, _ in slots(blocks, weights, grid):
        begins.setdefault(phase, slot)
        run = runs.setdefault((s, phase), [block, block])
        if run[1] - run[0] < used[phase][s]:
            places.append((s, phase, run[1] - run[0], slot - begins[phase]))
        run[1] += 1
    return [(s, p, a, b, begins[p], used[p][s]) for (s, p), (a, b) in runs.items()], places


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> DataFrame:
    """All documents and their columns, with mix_slot (place of the block in the mixture), mix_block (its number in the source), mix_index (place in the block), mix_phase, mix_release and mix_deadline.

    ``weights``: target weight by source, positive; without it a source's
    weight is its number of documents to the power ``power``.
    """
    spark = docs.sparkSession
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(buckets)).cast("int")
    order = F.struct(F.xxhash64("doc_id").alias("a"), F.col("doc_id").alias("b"), (F.xxhash64("text") if "text" in docs.columns else F.lit(0)).alias("c"))
    # the row travels as one struct, so no column of it can clash with those here
    own = docs.select(F.struct(*[c for c in docs.columns if c not in OUTPUT]).alias("row"), F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")).alias("source"), spread.alias("bucket"), order.alias("o"))
    counts = own.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in counts.groupBy("source").agg(F.sum("n")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    names = sorted(sizes)
    given = {("null" if s is None else f"s:{s}"): w for s, w in weights.items()} if weights is not None else {s: n**power for s, n in sizes.items()}
    if bad := [s for s in names if not given.get(s, 0) > 0]:
        raise ValueError(f"no positive weight for {bad}")
    path = shared_path(spark, "slots")
    kinds = pa.schema([("slot", pa.int64()), ("source", pa.string()), ("block", pa.int64()), ("phase", pa.int32()), ("release", pa.int64()), ("deadline", pa.int64())])
    dealt = slots({k: -(-sizes[s] // block_docs) for k, s in enumerate(names)}, {k: float(given[s]) for k, s in enumerate(names)})
    for chunk in batched(dealt, CHUNK_BLOCKS):
        slot, source, *rest = zip(*chunk, strict=True)
        columns = [slot, [names[k] for k in source], *rest]
        spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)).write.mode("append").parquet(path)
    if not names:
        spark.createDataFrame(kinds.empty_table()).write.parquet(path)
    places = spark.read.schema("slot long, source string, block long, phase int, release long, deadline long").parquet(path)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a bucket's blocks, the first and the last shared with its neighbours, lie in one array beside its rows
    spans = before.withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / block_docs), F.floor((F.col("before") + F.col("n") - 1) / block_docs))))
    place = F.struct("block", "slot", "phase", "release", "deadline")
    before = spans.join(places, ["source", "block"]).groupBy("source", "bucket", "before").agg(F.array_sort(F.collect_list(place)).alias("places"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("o")) - 1)
    numbered = ranked.join(before, ["source", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    blocked = numbered.withColumn("block", F.floor(F.col("rank") / block_docs)).withColumn("place", F.element_at("places", (F.col("block") - F.floor(F.col("before") / block_docs) + 1).cast("int")))
    return blocked.select(
        "row.*",
        F.col("place.slot").alias("mix_slot"),
        F.col("block").cast("long").alias("mix_block"),
        (F.col("rank") % block_docs).cast("int").alias("mix_index"),
        F.col("place.phase").alias("mix_phase"),
        F.col("place.release").alias("mix_release"),
        F.col("place.deadline").alias("mix_deadline"),
    )
