"""The operation log: append, cursors, vectors, gaps, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("src_node", "src_seq")
#: Numbers in a bitmap of Spark's.
BITS = 32_768


def arrivals() -> Column:
    """Arrivals in pieces (hours) that follow each other: no task has to put more than one in order."""
    return F.unix_micros(F.date_trunc("hour", F.col("created").cast("timestamp")))


def running(rows: DataFrame, by: list[str], block: Column, order: list[str], of: Column, name: str) -> DataFrame:
    """The running sum of ``of`` (itself included) within ``by`` in that order, as ``name``; null groups are groups.

    ``block`` never falls along the order. Blocks are summed first, and of a
    group only these sums, a row a block, are put in order in one task; rows
    are put in order within their block.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    own = rows.withColumns({"__b": block, "__of": of, **{k: F.col(c) for k, c in zip(keys, by, strict=True)}})
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*keys, "__b").agg(F.sum("__of").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).drop("__s").alias("s")
    met = own.alias("o").join(sums, [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__b"]])
    within = Window.partitionBy(*(F.col(f"o.{k}") for k in [*keys, "__b"])).orderBy(*(F.col(f"o.{c}") for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("s.__before") + F.sum("o.__of").over(within)).cast("long")
    return met.select(*(F.col(f"o.{c}") for c in rows.columns if c != name), total.alias(name))


def admit(ops: DataFrame, self_node: str) -> DataFrame:
    """What may enter the log: named source, positive sequence, not our own echo."""
    return ops.filter((F.col("src_node") != "") & (F.col("src_seq") > 0) & (F.col("src_node") != self_node))


def first_arrivals(ops: DataFrame) -> DataFrame:
    """At-least-once delivery made idempotent: the first arrival of each (source, sequence)."""
    order = Window.partitionBy(*KEY).orderBy("created", "event_id")
    return ops.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == 1).drop("__n")


def append(log: DataFrame, ops: DataFrame, self_node: str) -> DataFrame:
    """The log with the admissible operations that it lacks."""
    return log.unionByName(first_arrivals(admit(ops, self_node)).join(log.select(*KEY), list(KEY), "left_anti"))


def after_cursor(ops: DataFrame, created: str, event_id: int, limit: int) -> DataFrame:
    """The next operations in order of arrival."""
    at = F.struct(F.lit(created).cast("timestamp_ntz").alias("created"), F.lit(event_id).cast("long").alias("event_id"))
    return ops.filter((F.col("created") >= F.lit(created).cast("timestamp_ntz")) & (F.struct("created", "event_id") > at)).orderBy("created", "event_id").limit(limit)


def head(ops: DataFrame) -> DataFrame:
    """The last arrival; one row, nulls for an empty log."""
    return ops.agg(F.max(F.struct("created", "event_id")).alias("h")).select(F.col("h.created").alias("created"), F.col("h.event_id").alias("event_id"))


def sources(ops: DataFrame, horizon: DataFrame) -> DataFrame:
    """Every source known from the log or from compaction."""
    return ops.select("src_node").union(horizon.select("src_node")).distinct()


def page_after_vector(ops: DataFrame, vector: DataFrame, horizon: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """A pull page, sources ascending under one limit, and whether a snapshot is needed.

    A source whose horizon lies beyond the vector gives nothing and asks for a
    snapshot, unless the limit is used up before it. Only counts by source are
    needed to decide that; the page itself is a top-k.
    """
    wanted = ops.join(F.broadcast(vector.withColumnRenamed("seq", "__seen")), "src_node", "left").filter(F.col("src_seq") > F.coalesce("__seen", F.lit(0))).drop("__seen")
    status = (
        sources(ops, horizon)
        .join(horizon, "src_node", "left")
        .join(vector, "src_node", "left")
        .select("src_node", (F.coalesce("seq", F.lit(0)) < F.coalesce("min_seq", F.lit(0))).alias("blocked"))
    )
    open_ops = wanted.join(F.broadcast(status.filter("blocked").select("src_node")), "src_node", "left_anti")
    page = open_ops.orderBy(*KEY).limit(limit)
    counts = open_ops.groupBy("src_node").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("src_node").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    reached = status.join(counts, "src_node", "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0)))
    needed = reached.agg(F.coalesce(F.bool_or(F.col("blocked") & (F.col("before") < limit)), F.lit(False)).alias("snapshot_required"))
    return page, needed


def contiguous(ops: DataFrame, vector: DataFrame, block: int = BITS) -> DataFrame:
    """How far each source's sequence goes on from the vector without a hole; also its maximum.

    One pass and one shuffle, of a bitmap for every ``block`` numbers of a
    source (32 768 at most); the first that is not full says where the hole is.
    """
    start = F.coalesce("seq", F.lit(0))
    ahead = ops.select(*KEY).join(F.broadcast(vector), "src_node", "left").filter(F.col("src_seq") > start).withColumn("__at", F.col("src_seq") - start - 1)
    block = min(block, BITS)
    bits = F.bitmap_construct_agg(F.col("__at") % block)
    maps = ahead.groupBy("src_node", F.expr(f"__at div {block} + 1").alias("__b")).agg(bits.alias("__bits"), F.max("src_seq").alias("__top"))
    # what the first bytes that are all ones, and the byte after them, begin with
    digits = F.hex("__bits")
    whole = F.floor((F.length(digits) - F.length(F.ltrim(digits, F.lit("F")))) / 2).cast("int")
    byte = F.lpad(F.conv(F.substring(digits, whole * 2 + 1, F.lit(2)), 16, 2), 8, "0")
    ones = F.length(byte) - F.length(F.rtrim(byte, F.lit("1")))
    marked = maps.select("src_node", "__b", "__top", F.bitmap_count("__bits").alias("__n"), (whole * 8 + F.coalesce(ones, F.lit(0))).alias("__lead"))
    ordered = marked.withColumn("__rn", F.row_number().over(Window.partitionBy("src_node").orderBy("__b")))  # a row a bitmap
    broken = (F.col("__b") != F.col("__rn")) | (F.col("__n") < block)
    first = F.min(F.when(broken, F.struct("__rn", F.when(F.col("__b") == F.col("__rn"), F.col("__lead")).otherwise(0).alias("lead"))))
    runs = ordered.groupBy("src_node").agg(first.alias("__f"), F.count("*").alias("__all"), F.max("__top").alias("top"))
    done = F.coalesce((F.col("__f.__rn") - 1) * block + F.col("__f.lead"), F.col("__all") * block, F.lit(0)).cast("long")
    both = vector.select("src_node", "seq").join(runs, "src_node", "full_outer")
    # a source without rows ahead can only be one that the vector names
    return both.select("src_node", (start + done).alias("seq"), F.coalesce("top", "seq", F.lit(0)).alias("top"))


def gaps(ops: DataFrame, vector: DataFrame) -> DataFrame:
    """Sources with operations beyond a hole."""
    return contiguous(ops, vector).filter("top > seq")


def current_vector(vector: DataFrame, self_node: str, local_seq: int) -> DataFrame:
    """The vector with this node's own sequence."""
    own = vector.sparkSession.range(1).select(F.lit(self_node).alias("src_node"), F.lit(local_seq).cast("long").alias("seq"))
    return vector.select("src_node", "seq").union(own).groupBy("src_node").agg(F.max("seq").alias("seq"))


def adopt(vector: DataFrame, other: DataFrame, self_node: str) -> DataFrame:
    """Element-wise maximum; never for this node itself."""
    return vector.select("src_node", "seq").union(other.filter(F.col("src_node") != self_node).select("src_node", "seq")).groupBy("src_node").agg(F.max("seq").alias("seq"))


def load_vector(state: DataFrame) -> DataFrame:
    """The vector kept as ``vector.<node>`` keys; unreadable numbers count as 0."""
    return state.filter(F.col("key").startswith("vector.")).select(F.substring("key", 8, 1 << 30).alias("src_node"), F.coalesce(F.col("value").try_cast("long"), F.lit(0)).alias("seq"))


def peer_lag(nodes: DataFrame, peer_vectors: DataFrame, self_node: str, local_seq: int) -> DataFrame:
    """How many of this node's operations each peer lacks; -1: unknown."""
    own = peer_vectors.filter(F.col("src_node") == self_node).select("peer", F.col("seq").alias("__acked"))
    known = peer_vectors.select("peer").distinct().withColumn("__known", F.lit(True))
    lag = F.when(F.col("__known").isNull(), -1).otherwise(F.greatest(F.lit(0), F.lit(local_seq) - F.coalesce("__acked", F.lit(0))))
    return nodes.join(known, "peer", "left").join(own, "peer", "left").select("peer", lag.cast("long").alias("lag"))


def lag_summary(lags: DataFrame) -> DataFrame:
    known = lags.filter("lag >= 0")
    return known.agg(F.count("*").alias("peers"), F.coalesce(F.max("lag"), F.lit(0)).cast("long").alias("worst"), F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("total"))


def push_pages(ops: DataFrame, cursors: DataFrame, batch: int) -> DataFrame:
    """What each peer is to be sent next: the first ``batch`` arrivals after its cursor, but not its own.

    cursors: peer, created, event_id; a row for each peer of the cluster.
    """
    at = cursors.select("peer", F.struct("created", "event_id").alias("__at"), arrivals().alias("__from"))
    blocks = ops.groupBy(arrivals().alias("__b"), "src_node").agg(F.count("*").alias("__n"))
    met = blocks.join(F.broadcast(at), F.col("__b") >= F.col("__from"))
    # what lies surely beyond the cursor: whole later blocks without the peer's own
    sure = F.sum(F.when((F.col("__b") > F.col("__from")) & (F.col("src_node") != F.col("peer")), F.col("__n")).otherwise(0))
    earlier = Window.partitionBy("peer").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    reached = met.groupBy("peer", "__b").agg(sure.alias("__sure"), F.first("__at").alias("__at")).withColumn("__before", F.coalesce(F.sum("__sure").over(earlier), F.lit(0)))
    wanted = reached.filter(F.col("__before") < batch).select("peer", "__b", "__at")
    due = ops.withColumn("__b", arrivals()).join(wanted, "__b").filter((F.struct("created", "event_id") > F.col("__at")) & (F.col("src_node") != F.col("peer")))
    order = Window.partitionBy("peer").orderBy("created", "event_id")
    return due.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= batch).drop("__n", "__at", "__b")


def pull_round(log: DataFrame, vector: DataFrame, peer_ops: DataFrame, peer_vector: DataFrame, horizon: DataFrame, limit: int, self_node: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One answered pull: the log and the vector after it, and whether a snapshot is needed.

    The page goes into the log and the vector moves on over what is contiguous.
    After a page that is not full, all of the peer's log has been seen, and its
    vector is adopted too, which passes the holes that compaction left. If a
    snapshot is needed the page is thrown away and nothing moves.
    """
    page, needed = page_after_vector(peer_ops, vector, horizon, limit)
    flag = F.broadcast(needed)  # one row
    after = append(log, page.join(flag, ~F.col("snapshot_required")).drop("snapshot_required"), self_node)
    size = page.agg((F.count("*") < limit).alias("__short"))
    moved = contiguous(after, vector).select("src_node", "seq")
    told = adopt(moved, peer_vector, self_node).select("src_node", F.col("seq").alias("__told"))
    kept = vector.select("src_node", F.col("seq").alias("__kept"))
    both = told.join(moved, "src_node", "left").join(kept, "src_node", "left").join(flag).join(F.broadcast(size))  # two single rows
    seq = F.when(F.col("snapshot_required"), F.col("__kept")).when(F.col("__short"), F.col("__told")).otherwise(F.col("seq"))
    return after, both.select("src_node", seq.alias("seq")).filter("seq is not null"), needed


def next_sequences(ops: DataFrame, local_seq: int, order: list[str], block: Column | None = None) -> DataFrame:
    """New operations of each source with the sequence numbers that follow ``local_seq``; ``block`` (the hour of arrival unless given) never falls along the order."""
    return running(ops, ["src_node"], arrivals() if block is None else block, order, F.lit(1), "__k").withColumn("src_seq", F.lit(local_seq) + F.col("__k")).drop("__k")


def counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("col_id").agg(F.count("*").alias("ops"), F.count_if(F.col("op_type") == "delete").alias("deletes"), F.count_distinct("src_node").alias("sources"))
