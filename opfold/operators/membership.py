"""Members, health, leadership, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def healthy(now: str, self_node: str, sync_interval: int) -> Column:
    """Removed beats self; self is healthy; else seen less than three intervals ago; an unknown time is not."""
    seen = F.col("last_seen") > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(3 * sync_interval).cast("decimal(18,6)"))
    return F.when(F.col("removed"), False).when(F.col("node_id") == self_node, True).otherwise(F.coalesce(seen, F.lit(False)))


def newest(rows: DataFrame) -> DataFrame:
    """A row a member, of several the last seen; of these one that is removed, then the greatest URL."""
    fields = ("url", "reachable", "joined_at", "last_seen", "removed")
    return rows.groupBy("node_id").agg(F.max_by(F.struct(*fields), F.struct("last_seen", "removed", "url", "joined_at")).alias("r")).select("node_id", *(f"r.{c}" for c in fields))


def merge(members: DataFrame, gossip: DataFrame, self_node: str) -> DataFrame:
    """Members after gossip: strictly newer rows win, on a tie only a removal does; joined_at stays, self is never told. Of several senders' rows of a member the newest counts."""
    g = newest(gossip.filter(F.col("node_id") != self_node)).select(F.col("node_id"), *(F.col(c).alias(f"g_{c}") for c in ("url", "reachable", "joined_at", "last_seen", "removed")))
    both = members.join(g, "node_id", "full_outer")
    take = F.col("last_seen").isNull() | (F.col("g_last_seen") > F.col("last_seen")) | ((F.col("g_last_seen") == F.col("last_seen")) & F.col("g_removed") & ~F.col("removed"))
    take = F.coalesce(take & F.col("g_last_seen").isNotNull(), F.lit(False))
    return both.select("node_id", *(F.when(take, F.col(f"g_{c}")).otherwise(F.col(c)).alias(c) for c in ("url", "reachable")), F.coalesce("joined_at", "g_joined_at").alias("joined_at"), *(F.when(take, F.col(f"g_{c}")).otherwise(F.col(c)).alias(c) for c in ("last_seen", "removed")))


def upsert(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows put over members; a member's joined_at stays."""
    r = newest(rows).select("node_id", *(F.col(c).alias(f"r_{c}") for c in ("url", "reachable", "joined_at", "last_seen", "removed")))
    both = members.join(r, "node_id", "full_outer")
    return both.select("node_id", *(F.coalesce(f"r_{c}", c).alias(c) for c in ("url", "reachable")), F.coalesce("joined_at", "r_joined_at").alias("joined_at"), *(F.coalesce(f"r_{c}", c).alias(c) for c in ("last_seen", "removed")))


def touch(members: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Members heard from: seen now, and no longer removed."""
    s = seen.select("node_id").distinct().withColumn("__s", F.lit(True))
    return members.join(s, "node_id", "left").withColumns({"last_seen": F.when(F.col("__s"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_seen")), "removed": F.col("removed") & F.col("__s").isNull()}).drop("__s")


def leader(members: DataFrame, now: str, self_node: str, sync_interval: int) -> DataFrame:
    """The least id among the healthy and this node."""
    ids = members.filter(~F.col("removed") & healthy(now, self_node, sync_interval)).select("node_id")
    own = members.sparkSession.range(1).select(F.lit(self_node).alias("node_id"))
    return ids.union(own).agg(F.min("node_id").alias("leader")).withColumn("is_self", F.col("leader") == self_node)


def push_targets(members: DataFrame, self_node: str) -> DataFrame:
    return members.filter((F.col("node_id") != self_node) & (F.col("url") != "") & ~F.col("removed"))


def peer_urls(members: DataFrame, overrides: DataFrame, self_node: str) -> DataFrame:
    """Where each other member is reached: an override, else its own URL."""
    o = overrides.select("node_id", F.col("url").alias("__o"))
    own = members.filter(~F.col("removed") & (F.col("node_id") != self_node)).join(o, "node_id", "left")
    return own.select("node_id", F.rtrim(F.coalesce(F.nullif("__o", F.lit("")), "url"), F.lit("/")).alias("url")).filter("url <> ''")


def health_changes(checks: DataFrame) -> DataFrame:
    """Rows (peer, t, healthy) that differ from a known state before."""
    before = F.lag("healthy").over(Window.partitionBy("peer").orderBy("t"))
    return checks.withColumn("__b", before).filter(F.col("__b").isNotNull() & (F.col("healthy") != F.col("__b"))).drop("__b")


def error_slots(results: DataFrame) -> DataFrame:
    """Rows (peer, t, error or null): the first failure of each run is reported, a success clears the slot."""
    before = F.lag("error").over(Window.partitionBy("peer").orderBy("t"))
    marked = results.withColumn("__b", before)
    return marked.select("peer", "t", F.when(F.col("error").isNotNull() & F.col("__b").isNull(), "report").when(F.col("error").isNull() & F.col("__b").isNotNull(), "clear").alias("action")).filter("action is not null")


def global_error(results: DataFrame) -> DataFrame:
    """The error that a node shows (node, error; "" for none) after results (node, peer, t, error or null).

    The first failure of a peer's run is shown in place of what was; the
    peer's next success takes it back, if it is still the one shown.
    """
    before = F.lag("error").over(Window.partitionBy("node", "peer").orderBy("t"))
    shown = results.withColumn("__b", before).filter(F.col("error").isNotNull() & F.col("__b").isNull())
    last = shown.groupBy("node").agg(F.max(F.struct("t", "peer", "error")).alias("__e"))
    healed = results.filter("error is null").groupBy("node", "peer").agg(F.max("t").alias("__ok"))
    nodes = results.select("node").distinct().join(last, "node", "left").withColumn("peer", F.col("__e.peer"))
    gone = F.col("__e").isNull() | (F.col("__ok") > F.col("__e.t"))
    return nodes.join(healed, ["node", "peer"], "left").select("node", F.when(F.coalesce(gone, F.lit(False)), "").otherwise(F.col("__e.error")).alias("error"))


def listed(members: DataFrame) -> DataFrame:
    """Members in order of their ids; removed ones too."""
    return members.orderBy("node_id")


def blob_sources(members: DataFrame, preferred: str, self_node: str) -> DataFrame:
    """Peers to ask for a file: the preferred one, then the others by id."""
    order = F.row_number().over(Window.orderBy(F.when(F.col("node_id") == preferred, 0).otherwise(1), "node_id"))  # a row for each member
    return push_targets(members, self_node).select("node_id", order.cast("long").alias("place"))


def status(members: DataFrame, vector: DataFrame, lags: DataFrame, errors: DataFrame, now: str, self_node: str, sync_interval: int) -> DataFrame:
    """A row for each member: health, how far we have it, how far it has us, its last error."""
    return (
        members.withColumn("healthy", healthy(now, self_node, sync_interval))
        .join(vector.select(F.col("src_node").alias("node_id"), "seq"), "node_id", "left")
        .join(lags.select(F.col("peer").alias("node_id"), "lag"), "node_id", "left")
        .join(errors.select(F.col("peer").alias("node_id"), "error"), "node_id", "left")
        .select("node_id", "url", "removed", "healthy", F.coalesce("seq", F.lit(0)).alias("seq"), F.when(F.col("node_id") == self_node, 0).otherwise(F.coalesce("lag", F.lit(-1))).cast("long").alias("lag"), F.coalesce("error", F.lit("")).alias("error"))
    )
