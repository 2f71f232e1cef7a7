"""Readers, and the inputs that the queries derive from the driver's tables.

The derivations stand in for a cluster's own tables; every operator takes plain
DataFrames and knows nothing of them. ``created`` and ``event_id`` give the
order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opfold.functions import clock
from opfold.schemas import OP

NOW = "2024-02-01 00:00:00"
SELF = "node00003"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ops_json(spark: SparkSession, path: str) -> DataFrame:
    """Operations from JSON lines, malformed lines as rows of nulls in ``_corrupt``."""
    return spark.read.schema(OP + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def stream_ops_json(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(OP).option("maxFilesPerTrigger", files_per_batch).json(path)


def day_ms(ts):
    """Epoch milliseconds of a timestamp's day, whatever the session's zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of five nodes: out of order by up to a day, many clock ties between nodes."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props", (F.col("user_id") % 5).alias("n"), day_ms(F.col("ts")).alias("day"))
    numbered = e.withColumn("src_seq", F.row_number().over(Window.partitionBy("n").orderBy("event_id")).cast("long")).withColumn("lg", F.row_number().over(Window.partitionBy("n", "day").orderBy("event_id")).cast("long") - 1)
    gone = F.col("event_type") == "error"
    return numbered.select(
        F.concat(F.lit("node"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("src_node"),
        "src_seq",
        clock.encode(F.col("day"), F.col("lg")).alias("hlc"),
        F.when(gone, "delete").otherwise("upsert").alias("op_type"),
        F.concat(F.lit("col"), (F.col("lg") % 3).cast("string")).alias("col_id"),
        F.concat(F.lit("rec"), F.lpad((F.col("lg") % 40).cast("string"), 5, "0")).alias("record_id"),
        F.when(gone, "").otherwise(F.col("props")).alias("payload"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 7919 % 86400).cast("decimal(18,6)"))).alias("created"),
        "event_id",
    )


def oplog_with_holes(spark: SparkSession, sf_dir: str, after: int = 20) -> DataFrame:
    return oplog(spark, sf_dir).filter(~((F.col("src_seq") > after) & (F.col("event_id") % 97 == 0)))


def oplog_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows delivered again an hour later."""
    first = oplog(spark, sf_dir)
    return first.unionByName(first.filter("event_id % 10 = 0").withColumn("created", F.col("created") + F.make_dt_interval(hours=F.lit(1))))


def oplog_poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("event_id") % 501 == 7) & (F.col("op_type") == "upsert")
    return oplog(spark, sf_dir).withColumn("payload", F.when(bad, '{"k":').otherwise(F.col("payload")))


def oplog_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_schema = F.col("event_id") % 211 == 3
    own = oplog(spark, sf_dir)
    text = F.concat(F.lit('{"name":"'), F.col("col_id"), F.lit('","version":'), (F.col("event_id") % 4).cast("string"), F.lit("}"))
    return own.withColumns({"op_type": F.when(is_schema, "col_upsert").otherwise(F.col("op_type")), "record_id": F.when(is_schema, F.col("col_id")).otherwise(F.col("record_id")), "payload": F.when(is_schema, text).otherwise(F.col("payload"))})


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("node"), F.lpad(k.cast("string"), 5, "0")).alias("node_id"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("http://n"), k.cast("string"))).alias("url"),
        (k % 5 != 0).alias("reachable"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("joined_at"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(secs=(k * k % 61).cast("decimal(18,6)"))).alias("last_seen"),
        (k % 11 == 0).alias("removed"),
    )


def gossip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("node"), F.lpad(k.cast("string"), 5, "0")).alias("node_id"),
        F.concat(F.lit("http://g"), k.cast("string")).alias("url"),
        (k % 3 != 0).alias("reachable"),
        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("joined_at"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(secs=(k * 7 % 61).cast("decimal(18,6)"))).alias("last_seen"),
        (k % 7 == 0).alias("removed"),
    )


def old_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members last seen up to a hundred days ago."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("node"), F.lpad(k.cast("string"), 5, "0")).alias("node_id"), (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(days=(k * 13 % 101).cast("int"))).alias("last_seen"), (k % 11 == 0).alias("removed")
    )


def vector_of(ops: DataFrame, behind: int = 37) -> DataFrame:
    """A peer's vector over all sources but the last: a bit behind each."""
    return ops.groupBy("src_node").agg((F.max("src_seq") - behind).alias("seq")).filter("src_node <> 'node04'")


def peer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = oplog(spark, sf_dir).groupBy("src_node").agg(F.max("src_seq").alias("top"))
    peers = spark.range(1, 5).select(F.col("id").alias("p"))
    return own.crossJoin(F.broadcast(peers)).select(F.concat(F.lit("peer0"), F.col("p").cast("string")).alias("peer"), "src_node", (F.col("top") - F.col("p") * 13 % 50).alias("seq"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    ip = F.when(u % 10 == 0, F.concat(F.lit("192.168.0."), (u % 256).cast("string"))).otherwise(F.concat_ws(".", (20 + u % 3).cast("string"), (u % 7).cast("string"), (u / 256).cast("long").cast("string"), (u % 256).cast("string")))
    return table(spark, sf_dir, "events").select(
        ip.alias("ip"),
        F.when(e % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.when(e % 9 == 0, "/api/replication/").otherwise("/api/"), F.col("event_type"), F.lit("/"), (e % 20).cast("string")).alias("path"),
        (F.col("event_type") == "error").alias("blocked"),
        "ts",
        "event_id",
    )


#: action, scope, match type, value, active.
RULES = [
    ("deny", "app", "ip", "20.1.0.3", True), ("deny", "app", "cidr", "21.3.0.0/16", True), ("allow", "app", "cidr", "20.0.0.0/7", True), ("allow", "app", "country", "aa", True), ("deny", "app", "country", "BB", True),
    ("allow", "app", "ip", "not-an-ip", True), ("allow", "app", "cidr", "1.2.3.4/99", True), ("deny", "app", "region", "AA-01", True), ("deny", "app", "ip", "22.0.0.2", False), ("allow", "app", "asn", "64512", True),
    ("deny", "replication", "cidr", "22.5.0.0/16", True), ("deny", "replication", "ip", "192.168.0.10", True),
]
#: lo, hi, country, region, city, lat, lon.
GEO = [("20.0.0.0", "20.255.255.255", "CC", "CC-01", "Cee", 10.5, 20.25), ("22.0.0.0", "22.255.255.255", "AA", "AA-01", "Aye", 37.5, -122.25), ("22.2.0.0", "22.2.255.255", "BB", "BB-07", "Bee", 0.0, 0.0)]


def number_of(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "action string, scope string, match_type string, value string, active boolean")


def geo_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(number_of(lo), number_of(hi), *rest) for lo, hi, *rest in GEO], "lo long, hi long, country string, region string, city string, lat double, lon double")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.col("ts").alias("time"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("click", "op_applied", "error", "op_failed", "purchase", "peer_healthy", "signup", "peer_unhealthy", "view", "snapshot")]), F.col("event_type")).alias("type"),
        F.concat(F.lit("col"), (e % 7).cast("string")).alias("collection"),
        F.concat(F.lit("peer"), (F.col("user_id") % 9).cast("string")).alias("peer"),
    )


#: Peers' applied migrations (None: cannot say), and the files that wait.
PEER_MIGRATIONS = [("p1", ["m1.js", "m2.js"]), ("p2", ["m2.js", "m3.js"]), ("p3", []), ("p4", None)]
DEFERRED = ["m1.js", "m3.js", "m4.js", "m5.js", "m6.js", "m7.js"]
APPLIED = ["m0.js", "m4.js"]


def peer_migrations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PEER_MIGRATIONS, "peer string, applied array<string>")


def files_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "file string")
