"""Compaction: what may be forgotten, and what that costs late peers.

The steps must run in this order: superseded operations go first, so that a
deletion overwritten later does not raise the horizon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opfold.functions.lww import stamp
from opfold.schemas import RECORD_OPS, SCHEMA_OPS


def _not_superseded(ops: DataFrame, key: tuple[str, ...], grace: str) -> DataFrame:
    """All but the old rows with a later one on their key; ties stay. The later row may be of any age.

    The latest stamps are aggregated before they move; old rows meet them on
    key and stamp together, which is unique to an operation, so that a record
    with any share of the log is spread over all tasks.
    """
    old = F.col("created") < F.lit(grace).cast("timestamp_ntz")
    best = ops.groupBy(*key).agg(F.max(stamp()).alias("b")).select(*key, "b.hlc", "b.src_node")
    return ops.filter(~old).unionByName(ops.filter(old).join(best, [*key, "hlc", "src_node"], "left_semi").select(*ops.columns))


def drop_superseded(ops: DataFrame, grace: str) -> DataFrame:
    """Record operations by (collection, record), schema operations by record; neither touches the other."""
    records = _not_superseded(ops.filter(F.col("op_type").isin(*RECORD_OPS)), ("col_id", "record_id"), grace)
    schemas = _not_superseded(ops.filter(F.col("op_type").isin(*SCHEMA_OPS)), ("record_id",), grace)
    return records.unionByName(schemas)


def horizon(ops: DataFrame, old: DataFrame, expiry: str) -> DataFrame:
    """Per source the highest expired deletion; it never falls."""
    new = ops.filter((F.col("op_type") == "delete") & (F.col("created") < F.lit(expiry).cast("timestamp_ntz"))).groupBy("src_node").agg(F.max("src_seq").alias("min_seq"))
    return old.select("src_node", "min_seq").union(new).groupBy("src_node").agg(F.max("min_seq").alias("min_seq"))


def drop_tombstones(ops: DataFrame, expiry: str) -> DataFrame:
    return ops.filter(~((F.col("op_type") == "delete") & (F.col("created") < F.lit(expiry).cast("timestamp_ntz"))))


def compact(ops: DataFrame, old_horizon: DataFrame, grace: str, expiry: str) -> tuple[DataFrame, DataFrame]:
    """(log, horizon) after one pass."""
    rest = drop_superseded(ops, grace)
    return drop_tombstones(rest, expiry), horizon(rest, old_horizon, expiry)


def purge_versions(versions: DataFrame, expiry: str) -> DataFrame:
    """Deleted versions not updated since go; live ones never."""
    return versions.filter(~(F.col("deleted") & (F.col("updated") < F.lit(expiry).cast("timestamp_ntz"))))


def flag_members(members: DataFrame, self_node: str, flag: str, purge: str) -> DataFrame:
    """Members not seen since ``flag`` are removed, flagged ones not seen since ``purge`` are gone; this node stays.

    Flagging comes first, so one pass can do both to a very old member.
    """
    other = F.col("node_id") != self_node
    flagged = members.withColumn("removed", F.col("removed") | (other & (F.col("last_seen") < F.lit(flag).cast("timestamp_ntz"))))
    return flagged.filter(~(other & F.col("removed") & (F.col("last_seen") < F.lit(purge).cast("timestamp_ntz"))))
