"""Last write wins: the order of operations on a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(hlc: str | Column = "hlc", src_node: str | Column = "src_node") -> Column:
    """What two writes are compared by."""
    return F.struct(F.col(hlc).alias("hlc") if isinstance(hlc, str) else hlc.alias("hlc"), F.col(src_node).alias("src_node") if isinstance(src_node, str) else src_node.alias("src_node"))


def supersedes(hlc: Column, node: Column, other_hlc: Column, other_node: Column) -> Column:
    """Strictly later; nothing there always loses; equal stamps don't supersede."""
    return other_hlc.isNull() | (stamp(hlc, node) > stamp(other_hlc, other_node))
