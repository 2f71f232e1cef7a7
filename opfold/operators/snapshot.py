"""Snapshots, reconciliation, rescue of unacknowledged operations, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opfold.functions.lww import stamp, supersedes
from opfold.operators.fold import RECORD, winners
from opfold.operators.log import running
from opfold.schemas import FLOOR_HLC

#: Tables that a node keeps for itself: clients, their paths, and rows seen of a snapshot.
NODE_LOCAL = ("clients", "client_paths", "sync_seen")
#: Sequence numbers in pieces that a task puts in order.
BLOCK = "src_seq div 65536"


def page(records: DataFrame, versions: DataFrame, col_id: str, after: str, limit: int, peer: str) -> DataFrame:
    """A keyset page of one collection with each row's version; rows without one get the floor."""
    rows = records.filter((F.col("col_id") == col_id) & (F.col("record_id") > after)).orderBy("record_id").limit(limit)
    v = versions.filter(F.col("col_id") == col_id).select("record_id", F.col("hlc").alias("__h"), F.col("src_node").alias("__s"))
    return rows.join(v, "record_id", "left").select("col_id", "record_id", "payload", F.coalesce("__h", F.lit(FLOOR_HLC)).alias("hlc"), F.coalesce("__s", F.lit(peer)).alias("src_node"))


def meta(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """Row counts of every collection, empty ones too."""
    counts = records.groupBy("col_id").agg(F.count("*").alias("n"))
    return catalog.join(counts, catalog.id == counts.col_id, "left").select(F.col("id").alias("col_id"), "name", F.coalesce("n", F.lit(0)).alias("rows"))


def merge(local: DataFrame, snapshot: DataFrame, self_node: str) -> DataFrame:
    """Local state and a peer's snapshot through the same fold; rows that came from this node are not taken back."""
    return winners(local.unionByName(snapshot.filter(F.col("src_node") != self_node)))


def reconcile(local: DataFrame, seen: DataFrame, versions: DataFrame, horizon_hlc: str) -> DataFrame:
    """Local records to delete: absent on the peer, and without a version at or after the horizon.

    Records are known by collection and id; without ``col_id`` in ``local`` all
    rows are of one collection. Rows repeated in ``seen`` or ``versions`` count
    once (the latest version).
    """
    key = [c for c in RECORD if c in local.columns]
    v = versions.groupBy(*key).agg(F.max("hlc").alias("__h"))
    gone = local.join(seen.select(*key).distinct(), key, "left_anti").join(v, key, "left")
    return gone.filter(F.col("__h").isNull() | (F.col("__h") < horizon_hlc) if horizon_hlc else F.lit(True)).select(*key, F.lit("snapshot-reconcile").alias("src_node"))


def unacknowledged(ops: DataFrame, self_node: str, acked: int) -> DataFrame:
    return ops.filter((F.col("src_node") == self_node) & (F.col("src_seq") > acked))


def replay(rescued: DataFrame, state: DataFrame, node: str, local_seq: int) -> DataFrame:
    """Rescued operations that still win, under fresh sequence numbers and their own clock values.

    Of several on one record each that beats the state and all rescued before it counts.
    """
    at = state.select(*RECORD, F.col("hlc").alias("__h"), F.col("src_node").alias("__s"))
    before = Window.partitionBy(*RECORD).orderBy("src_seq").rowsBetween(Window.unboundedPreceding, -1)
    judged = rescued.join(at, list(RECORD), "left").withColumn("__best", F.max(stamp()).over(before))
    won = judged.filter(supersedes(F.col("hlc"), F.col("src_node"), F.col("__h"), F.col("__s")) & (F.col("__best").isNull() | (stamp() > F.col("__best"))))
    return running(won, ["src_node"], F.expr(BLOCK), ["src_seq"], F.lit(1), "__k").select(F.lit(node).alias("src_node"), (F.lit(local_seq) + F.col("__k")).alias("src_seq"), "hlc", "op_type", *RECORD, "payload")


def reissue(ops: DataFrame, old: str, new: str, acked: int) -> DataFrame:
    """A node that gives up a shared id sends its unacknowledged operations as 1..n under the new one.

    ``acked`` is held between 0 and the node's last sequence.
    """
    own = ops.filter(F.col("src_node") == old)
    return running(own.filter(F.col("src_seq") > max(0, acked)), ["src_node"], F.expr(BLOCK), ["src_seq"], F.lit(1), "__k").select(F.lit(new).alias("src_node"), F.col("__k").alias("src_seq"), "hlc", "op_type", *RECORD, "payload", F.col("src_seq").alias("old_seq"))


def move_versions(versions: DataFrame, reissued: DataFrame, old: str, new: str) -> DataFrame:
    """Versions that a re-sent operation wrote move to the new id; those that others overwrote don't."""
    moved = reissued.select(*RECORD, "hlc", F.lit(True).alias("__moved")).distinct()
    return versions.join(moved, [*RECORD, "hlc"], "left").withColumn("src_node", F.when((F.col("src_node") == old) & F.col("__moved"), new).otherwise(F.col("src_node"))).drop("__moved")


def duplicate_ids(joins: DataFrame) -> DataFrame:
    """Node ids that more than one running instance uses."""
    return joins.groupBy("node_id").agg(F.count_distinct("instance_id").alias("instances")).filter("instances > 1")


def sanitized_state(state: DataFrame, manifest: DataFrame, self_node: str, rescued_seq: int) -> DataFrame:
    """Key-value state after adopting a peer's copy: own id, the manifest's vector without this node, the highest of the known own sequences."""
    spark = state.sparkSession
    kept = state.filter(~F.col("key").startswith("vector.") & ~F.col("key").isin("node_id", "local_seq"))
    vector = manifest.filter(F.col("src_node") != self_node).select(F.concat(F.lit("vector."), "src_node").alias("key"), F.col("seq").cast("string").alias("value"))
    acked = manifest.filter(F.col("src_node") == self_node).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("a"))
    seq = acked.select(F.lit("local_seq").alias("key"), F.greatest("a", F.lit(rescued_seq)).cast("string").alias("value"))
    own = spark.range(1).select(F.lit("node_id").alias("key"), F.lit(self_node).alias("value"))
    return kept.select("key", "value").union(vector).union(seq).union(own)


def copy_strategy(has_data: bool, resync_pending: bool, has_seed: bool) -> str:
    """How a node starts: from a peer's copy, by a new one over what it has, or as it is."""
    if resync_pending and has_seed:
        return "resync"
    return "fresh" if has_seed and not has_data else "none"


def purge_copied(tables: dict[str, DataFrame], excluded: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of an adopted copy: what a node keeps for itself and the excluded collections are empty, their schemas stay."""
    return {name: rows.filter(F.lit(False)) if name in (*NODE_LOCAL, *excluded) else rows for name, rows in tables.items()}
