"""Client counters, retention, search and map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(requests: DataFrame, path_bytes: int) -> DataFrame:
    """Requests with an address and a path, the path cut to so many bytes (a character cut in two goes whole)."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode("path", "UTF-8"), 1, path_bytes).cast("string")), "\uFFFD+$", "")
    return requests.filter((F.col("ip") != "") & (F.col("path") != "")).withColumn("path", F.when(F.octet_length("path") > path_bytes, cut).otherwise(F.col("path")))


def clients(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip").agg(F.count("*").alias("requests"), F.count_if("blocked").alias("blocked"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def paths(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip", "method", "path").agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))


def path_flush(requests: DataFrame) -> DataFrame:
    """What a flush adds to the counters by address, method and path."""
    return requests.groupBy("ip", "method", "path").agg(F.count("*").alias("hits"), F.count_if("blocked").alias("blocked"), F.max("ts").alias("last_seen"))


def add(total: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters after a flush: sums add, times widen."""
    return total.unionByName(delta).groupBy("ip").agg(F.sum("requests").alias("requests"), F.sum("blocked").alias("blocked"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def add_paths(total: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters by address, method and path after a flush: sums add, the last time stays."""
    return total.unionByName(delta).groupBy("ip", "method", "path").agg(F.sum("hits").alias("hits"), F.sum("blocked").alias("blocked"), F.max("last_seen").alias("last_seen"))


def top_clients(found: DataFrame, most: int) -> DataFrame:
    """The latest seen; equal times by address."""
    return found.orderBy(F.desc("last_seen"), "ip").limit(most)


def top_paths(found: DataFrame, most: int) -> DataFrame:
    """Each address's most used paths; ties at the edge stay."""
    rank = F.rank().over(Window.partitionBy("ip").orderBy(F.desc("hits")))
    return found.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def collect_garbage(found: DataFrame, used: DataFrame, oldest: str, most: int, most_paths: int) -> tuple[DataFrame, DataFrame]:
    """(clients, paths) after retention, the cap, orphans, and the cap by address, in this order."""
    kept = top_clients(found.filter(F.col("last_seen") >= F.lit(oldest).cast("timestamp_ntz")), most)
    return kept, top_paths(used.join(kept.select("ip"), "ip", "left_semi"), most_paths)


def search(found: DataFrame, text: str) -> DataFrame:
    """Clients whose address or place holds the text, in any case."""
    hay = F.lower(F.concat_ws(" ", "ip", "country", "region", "city"))
    return found.filter(hay.contains(text.lower()))


def cards(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("clients"), F.count_if(F.col("geo_status") == "ok").alias("located"), F.count_if(F.col("blocked") > 0).alias("blocked_ips"), F.count_distinct("region").alias("regions"), F.array_join(F.sort_array(F.collect_set("country")), ",").alias("countries"))


def dots(found: DataFrame, width: int = 960, height: int = 480) -> DataFrame:
    """Equirectangular map positions of what has a place."""
    return found.filter((F.col("lat") != 0) | (F.col("lon") != 0)).select("ip", ((F.col("lon") + 180) / 360 * width).alias("x"), ((90 - F.col("lat")) / 180 * height).alias("y"))
