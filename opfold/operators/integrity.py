"""Referential integrity and file inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(records: DataFrame, fields: dict[str, str], id_col: str = "id") -> DataFrame:
    """(record_id, field, target_col, target_id) of every non-empty reference; array fields are exploded."""
    out = None
    kinds = dict(records.dtypes)
    for field, target in fields.items():
        value = F.col(field).cast("array<string>") if kinds[field].startswith("array") else F.array(F.col(field).cast("string"))
        rows = records.select(F.col(id_col).cast("string").alias("record_id"), F.lit(field).alias("field"), F.lit(target).alias("target_col"), F.explode(value).alias("target_id"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.col("target_id").isNotNull() & (F.col("target_id") != ""))


def dangling(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References to nothing; a target collection that is not there leaves all its references dangling."""
    return refs.join(targets.select("target_col", "target_id"), ["target_col", "target_id"], "left_anti")


def report(records: DataFrame, refs: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """One row: records scanned, distinct targets checked, dangling references, listed ones, and whether all is well."""
    scanned = records.agg(F.count("*").alias("scanned"))
    checked = refs.agg(F.count_distinct("field", "target_id").alias("checked_refs"))
    total = found.agg(F.count("*").alias("dangling"))
    return scanned.crossJoin(checked).crossJoin(total).select(  # three single rows
        "scanned", "checked_refs", "dangling", F.least("dangling", F.lit(most)).alias("listed"), F.when(F.col("dangling") > most, F.col("dangling")).otherwise(0).cast("long").alias("truncated_at"), (F.col("dangling") == 0).alias("converged")
    )


def listed(found: DataFrame, most: int) -> DataFrame:
    """The dangling references that a report shows."""
    return found.orderBy("field", "record_id", "target_id").limit(most)


def missing_files(records: DataFrame, stored: DataFrame) -> DataFrame:
    """(record_id, name) of every file that a record names and storage lacks. ``files``: map of field to names."""
    named = records.select("record_id", F.explode(F.flatten(F.map_values("files"))).alias("name")).filter("name <> ''")
    return named.join(stored.select("record_id", "name"), ["record_id", "name"], "left_anti")
