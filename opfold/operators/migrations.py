"""Set algebra of schema migrations over a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_applied(peers: DataFrame) -> DataFrame:
    """Every file that some peer has applied; a peer that cannot say has no part."""
    return peers.select(F.explode("applied").alias("file")).distinct()


def reachable(peers: DataFrame) -> DataFrame:
    """Peers that answered with a list, empty ones too."""
    return peers.agg(F.count_if(F.col("applied").isNotNull()).alias("reachable"), F.count("*").alias("peers"))


def to_import(deferred: DataFrame, applied: DataFrame, peers: DataFrame) -> DataFrame:
    """Deferred files that the cluster has applied already: recorded, not run."""
    return deferred.join(cluster_applied(peers), "file", "left_semi").join(applied, "file", "left_anti")


def to_run(deferred: DataFrame, applied: DataFrame, peers: DataFrame) -> DataFrame:
    """Deferred files that nobody has applied."""
    return deferred.join(cluster_applied(peers), "file", "left_anti").join(applied, "file", "left_anti")


def unapplied(deferred: DataFrame, applied: DataFrame) -> DataFrame:
    return deferred.subtract(applied).agg(F.count("*").alias("unapplied"))


def listed(files: DataFrame) -> DataFrame:
    """Applied files in order of their names, each once."""
    return files.select("file").distinct().orderBy("file")
