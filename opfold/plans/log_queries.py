"""Queries over the operation log: folds, vectors, compaction, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opfold.functions import clock
from opfold.operators import compaction, fold, log, snapshot, timeline
from opfold.plans.registry import HOLES, LATEST, LOG, SCHEMA_LOG, query
from opfold.schemas import Config
from opfold.sources import tables
from opfold.sources.tables import table

CONFIG = Config()
GRACE, EXPIRY = "2024-01-31 23:00:00", "2024-01-22 00:00:00"
OUT = ["col_id", "record_id", "op_type", "hlc", "src_node", "payload"]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("lww_state", f"WITH {LOG} SELECT col_id, record_id, op_type, hlc, src_node, payload FROM (SELECT *, {LATEST} AS k FROM oplog) WHERE k = 1")
def lww_state(spark, d):
    return fold.winners(tables.oplog(spark, d)).select(*OUT)


@query("lww_live_records", f"WITH {LOG} SELECT col_id, record_id, payload FROM (SELECT *, {LATEST} AS k FROM oplog) WHERE k = 1 AND op_type <> 'delete'")
def lww_live_records(spark, d):
    return fold.live(fold.winners(tables.oplog(spark, d))).select("col_id", "record_id", "payload")


@query(
    "version_merge",
    f"""WITH {LOG}, u AS (SELECT col_id, record_id, hlc, src_node, op_type = 'delete' AS deleted, created AS updated FROM oplog)
SELECT col_id, record_id, hlc, src_node, deleted, updated FROM (SELECT *, {LATEST} AS k FROM u) WHERE k = 1""",
)
def version_merge(spark, d):
    """Versions of the first half of the log, then the rest folded in."""
    ops = tables.oplog(spark, d)
    empty = frame(spark, [], "col_id string, record_id string, hlc string, src_node string, deleted boolean, updated timestamp_ntz")
    half = fold.merge_versions(empty, ops.filter("event_id % 2 = 0"))
    return fold.merge_versions(half, ops.filter("event_id % 2 = 1"))


@query("oplog_page", f"WITH {LOG} SELECT src_node, src_seq, hlc, op_type, col_id, record_id, created, event_id FROM oplog WHERE (created, event_id) > (TIMESTAMP '2024-01-03 00:00:00', 0) ORDER BY created, event_id LIMIT 500")
def oplog_page(spark, d):
    return log.after_cursor(tables.oplog(spark, d), "2024-01-03 00:00:00", 0, CONFIG.page(None)).drop("payload")


@query("head_offset", f"WITH {LOG} SELECT created, event_id FROM oplog ORDER BY created DESC, event_id DESC LIMIT 1")
def head_offset(spark, d):
    return log.head(tables.oplog(spark, d))


def horizons(spark):
    return frame(spark, [("node01", 60), ("node03", 10), ("node09", 5)], "src_node string, min_seq long")


def vector(spark):
    return frame(spark, [("node00", 100), ("node01", 50), ("node02", 120), ("node03", 10)], "src_node string, seq long")


VECTOR_SQL = "v(src_node, seq) AS (VALUES ('node00', 100), ('node01', 50), ('node02', 120), ('node03', 10)), h(src_node, min_seq) AS (VALUES ('node01', 60), ('node03', 10), ('node09', 5))"


@query(
    "pull_after_vector",
    f"""WITH {LOG}, {VECTOR_SQL} SELECT o.src_node, o.src_seq, hlc, op_type, col_id, record_id FROM oplog o LEFT JOIN v USING (src_node) LEFT JOIN h USING (src_node)
WHERE o.src_seq > coalesce(seq, 0) AND coalesce(seq, 0) >= coalesce(min_seq, 0) ORDER BY 1, 2 LIMIT 500""",
)
def pull_after_vector(spark, d):
    page, _ = log.page_after_vector(tables.oplog(spark, d), vector(spark), horizons(spark), 500)
    return page.select("src_node", "src_seq", "hlc", "op_type", "col_id", "record_id")


@query(
    "snapshot_required",
    f"""WITH {LOG}, {VECTOR_SQL}, s AS (SELECT src_node FROM oplog UNION SELECT src_node FROM h),
st AS (SELECT src_node, coalesce(seq, 0) < coalesce(min_seq, 0) AS blocked, (SELECT count(*) FROM oplog o WHERE o.src_node = s.src_node AND o.src_seq > coalesce(v.seq, 0)) AS n FROM s LEFT JOIN v USING (src_node) LEFT JOIN h USING (src_node)),
c AS (SELECT a.src_node, a.blocked, coalesce((SELECT sum(n) FROM st b WHERE b.src_node < a.src_node AND NOT b.blocked), 0) AS before FROM st a)
SELECT "limit", coalesce(bool_or(blocked AND before < "limit"), false) AS snapshot_required FROM c, (VALUES (50), (1000000)) AS l("limit") GROUP BY "limit" """,
)
def snapshot_required(spark, d):
    ops, out = tables.oplog(spark, d), None
    for limit in (50, 1_000_000):
        one = log.page_after_vector(ops, vector(spark), horizons(spark), limit)[1].select(F.lit(limit).alias("limit"), "snapshot_required")
        out = one if out is None else out.union(one)
    return out


@query("known_sources", f"WITH {LOG}, {VECTOR_SQL} SELECT src_node FROM oplog UNION SELECT src_node FROM h")
def known_sources(spark, d):
    return log.sources(tables.oplog(spark, d), horizons(spark))


CONTIGUOUS_SQL = f"""WITH {HOLES}, v(src_node, seq) AS (VALUES ('node00', 10), ('node01', 0), ('node07', 3)),
s AS (SELECT src_node FROM v UNION SELECT src_node FROM holes),
c AS (SELECT s.src_node, coalesce(v.seq, 0) AS start, coalesce((SELECT max(src_seq) FROM holes x WHERE x.src_node = s.src_node AND x.src_seq > coalesce(v.seq, 0)), coalesce(v.seq, 0)) AS top FROM s LEFT JOIN v USING (src_node)),
g AS (SELECT c.src_node, c.top, c.start, (SELECT min(t.i) FROM range(c.start + 1, c.top + 2) t(i) WHERE NOT EXISTS (SELECT 1 FROM holes x WHERE x.src_node = c.src_node AND x.src_seq = t.i)) AS missing FROM c)"""


def start_vector(spark):
    return frame(spark, [("node00", 10), ("node01", 0), ("node07", 3)], "src_node string, seq long")


@query("contiguous_vector", CONTIGUOUS_SQL + " SELECT src_node, missing - 1 AS seq, top FROM g")
def contiguous_vector(spark, d):
    return log.contiguous(tables.oplog_with_holes(spark, d), start_vector(spark))


@query("gap_sources", CONTIGUOUS_SQL + " SELECT src_node, missing - 1 AS seq, top FROM g WHERE top > missing - 1")
def gap_sources(spark, d):
    return log.gaps(tables.oplog_with_holes(spark, d), start_vector(spark))


@query("current_vector", f"WITH {LOG}, v AS (SELECT src_node, max(src_seq) - 37 AS seq FROM oplog WHERE src_node <> 'node04' GROUP BY 1) SELECT src_node, CASE WHEN src_node = 'node00' THEN greatest(seq, 77) ELSE seq END AS seq FROM v")
def current_vector(spark, d):
    return log.current_vector(tables.vector_of(tables.oplog(spark, d)), "node00", 77)


@query(
    "adopt_vector",
    f"""WITH {LOG}, a AS (SELECT src_node, max(src_seq) - 37 AS seq FROM oplog WHERE src_node <> 'node04' GROUP BY 1), b AS (SELECT src_node, max(src_seq) - 20 AS seq FROM oplog GROUP BY 1)
SELECT src_node, CASE WHEN src_node = 'node00' THEN a.seq ELSE greatest(a.seq, b.seq) END AS seq FROM a FULL JOIN b USING (src_node) WHERE src_node <> 'node00' OR a.seq IS NOT NULL""",
)
def adopt_vector(spark, d):
    ops = tables.oplog(spark, d)
    other = ops.groupBy("src_node").agg((F.max("src_seq") - 20).alias("seq"))
    return log.adopt(tables.vector_of(ops), other, "node00")


@query("load_vector", "SELECT * FROM (VALUES ('a', 12::BIGINT), ('b', 0::BIGINT)) AS t(src_node, seq)")
def load_vector(spark, d):
    return log.load_vector(frame(spark, [("vector.a", "12"), ("vector.b", "what"), ("node_id", "x"), ("hlc", "0")], "key string, value string"))


LAG_SQL = f"""WITH {LOG}, top AS (SELECT max(src_seq) AS n FROM oplog WHERE src_node = 'node00'),
p AS (SELECT i, CASE WHEN i = 9 THEN -1 ELSE greatest(0, 200 - (n - i * 13 % 50)) END AS lag FROM (VALUES (1), (2), (3), (4), (9)) AS t(i), top)"""


def lags(spark, d):
    peers = frame(spark, [(f"peer0{i}",) for i in (1, 2, 3, 4, 9)], "peer string")
    return log.peer_lag(peers, tables.peer_vectors(spark, d), "node00", 200)


@query("peer_lag", LAG_SQL + " SELECT 'peer0' || i AS peer, CAST(lag AS BIGINT) AS lag FROM p")
def peer_lag(spark, d):
    return lags(spark, d)


@query("lag_summary", LAG_SQL + " SELECT count(*) AS peers, CAST(max(lag) AS BIGINT) AS worst, CAST(sum(lag) AS BIGINT) AS total FROM p WHERE lag >= 0")
def lag_summary(spark, d):
    return log.lag_summary(lags(spark, d))


@query("oplog_counts", f"WITH {LOG} SELECT col_id, count(*) AS ops, count(*) FILTER (op_type = 'delete') AS deletes, count(DISTINCT src_node) AS sources FROM oplog GROUP BY 1")
def oplog_counts(spark, d):
    return log.counts(tables.oplog(spark, d))


TWICE = LOG + ", twice AS (SELECT * FROM oplog UNION ALL SELECT * REPLACE (created + INTERVAL 1 HOUR AS created) FROM oplog WHERE event_id % 10 = 0)"


@query("dedupe_ops", f"WITH {TWICE} SELECT src_node, src_seq, min(created) AS created FROM twice GROUP BY 1, 2")
def dedupe_ops(spark, d):
    return log.first_arrivals(tables.oplog_twice(spark, d)).select("src_node", "src_seq", "created")


@query("ingest_append", f"WITH {LOG} SELECT src_node, src_seq FROM oplog WHERE event_id % 3 = 0 UNION SELECT src_node, src_seq FROM oplog WHERE src_node <> 'node02'")
def ingest_append(spark, d):
    """A log with a third of the operations takes in a delivery of everything, twice in part, with its own echo."""
    ops = tables.oplog(spark, d)
    return log.append(ops.filter("event_id % 3 = 0"), tables.oplog_twice(spark, d), "node02").select("src_node", "src_seq")


@query(
    "push_pages",
    f"""WITH {LOG}, c(peer, created, event_id) AS (VALUES ('node01', TIMESTAMP '2024-01-02 00:00:00', 0), ('node02', TIMESTAMP '2024-01-05 00:00:00', 0), ('node03', TIMESTAMP '2030-01-01 00:00:00', 0))
SELECT peer, src_node, src_seq FROM (SELECT peer, src_node, src_seq, row_number() OVER (PARTITION BY peer ORDER BY o.created, o.event_id) AS k FROM c JOIN oplog o ON (o.created, o.event_id) > (c.created, c.event_id) AND o.src_node <> c.peer) WHERE k <= 500""",
)
def push_pages(spark, d):
    cursors = frame(spark, [("node01", "2024-01-02 00:00:00", 0), ("node02", "2024-01-05 00:00:00", 0), ("node03", "2030-01-01 00:00:00", 0)], "peer string, created string, event_id long")
    return log.push_pages(tables.oplog(spark, d), cursors.withColumn("created", F.col("created").cast("timestamp_ntz")), CONFIG.max_batch).select("peer", "src_node", "src_seq")


@query("next_sequences", f"WITH {LOG} SELECT event_id, src_node, 1000 + row_number() OVER (PARTITION BY src_node ORDER BY created, event_id) AS src_seq FROM oplog WHERE event_id % 5 = 1")
def next_sequences(spark, d):
    return log.next_sequences(tables.oplog(spark, d).filter("event_id % 5 = 1"), 1000, ["created", "event_id"]).select("event_id", "src_node", "src_seq")


# apply


@query(
    "applied_counter",
    f"""WITH {LOG}, j AS (SELECT *, max(hlc || '/' || src_node) OVER (PARTITION BY col_id, record_id ORDER BY created, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM oplog)
SELECT col_id, count(*) FILTER (best IS NULL OR hlc || '/' || src_node > best) AS applied, count(*) AS received FROM j GROUP BY 1""",
)
def applied_counter(spark, d):
    return fold.applied(tables.oplog(spark, d))


@query("barrier_segments", f"WITH {SCHEMA_LOG} SELECT src_node, src_seq, op_type = 'col_upsert' AS barrier, CAST(sum(CASE WHEN op_type = 'col_upsert' THEN 1 ELSE 0 END) OVER (PARTITION BY src_node ORDER BY created, event_id) AS BIGINT) AS segment FROM slog")
def barrier_segments(spark, d):
    return fold.segments(tables.oplog_with_schema(spark, d)).select("src_node", "src_seq", "barrier", "segment")


@query("poison_deadletter", f"WITH {LOG} SELECT src_node, src_seq, col_id, record_id FROM oplog WHERE event_id % 501 = 7 AND op_type = 'upsert'")
def poison_deadletter(spark, d):
    return fold.split_poisoned(tables.oplog_poisoned(spark, d))[1].select("src_node", "src_seq", "col_id", "record_id")


@query("poison_survivors", f"WITH {LOG} SELECT col_id, record_id, hlc, src_node FROM (SELECT *, {LATEST} AS k FROM oplog WHERE NOT (event_id % 501 = 7 AND op_type = 'upsert')) WHERE k = 1")
def poison_survivors(spark, d):
    return fold.winners(fold.split_poisoned(tables.oplog_poisoned(spark, d))[0]).select("col_id", "record_id", "hlc", "src_node")


@query(
    "schema_content_dedupe",
    f"""WITH {SCHEMA_LOG} SELECT record_id, hlc, src_node, sha256(payload) AS content, sha256(payload) IS DISTINCT FROM lag(sha256(payload)) OVER (PARTITION BY record_id ORDER BY hlc, src_node) AS changes FROM slog WHERE op_type LIKE 'col%'""",
)
def schema_content_dedupe(spark, d):
    return fold.schema_changes(tables.oplog_with_schema(spark, d)).select("record_id", "hlc", "src_node", "content", "changes")


CATALOG = [("col0", "posts", False), ("x1", "col1", False), ("v9", "report", True), ("_superusers", "_superusers", False), ("c5", "_logs", False)]
CATALOG_SQL = "cat(id, name, is_view) AS (VALUES ('col0', 'posts', false), ('x1', 'col1', false), ('v9', 'report', true), ('_superusers', '_superusers', false), ('c5', '_logs', false))"


def catalog(spark):
    return frame(spark, CATALOG, "id string, name string, is_view boolean")


@query("collection_resolve", f"WITH {LOG}, {CATALOG_SQL} SELECT col_id, coalesce(a.id, b.id) AS local_col_id, count(*) AS ops FROM oplog LEFT JOIN cat a ON a.id = col_id LEFT JOIN cat b ON b.name = col_id GROUP BY 1, 2")
def collection_resolve(spark, d):
    ops = tables.oplog(spark, d).withColumn("col_name", F.col("col_id"))
    return fold.resolve_collection(ops, catalog(spark)).groupBy("col_id", "local_col_id").agg(F.count("*").alias("ops"))


@query("parked_ops", f"WITH {LOG} SELECT src_node, src_seq FROM oplog WHERE col_id = 'col2' ORDER BY created DESC, event_id DESC LIMIT 10000")
def parked_ops(spark, d):
    ops = tables.oplog(spark, d).withColumn("col_name", F.col("col_id"))
    return fold.parked(ops, catalog(spark), CONFIG.max_parked).select("src_node", "src_seq")


@query("replicated_collections", f"WITH {CATALOG_SQL} SELECT id, name FROM cat WHERE NOT is_view AND name NOT IN ('_logs', '_superusers') AND id NOT IN ('_logs', '_superusers')")
def replicated_collections(spark, d):
    return fold.replicated(catalog(spark), CONFIG.excluded()).select("id", "name")


@query(
    "capture_ops",
    """WITH c AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, o_orderstatus = 'F' AS deleted, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT 'me' AS src_node, 100 + k AS src_seq, printf('%016x', ms) || '-' || printf('%04x', row_number() OVER (PARTITION BY ms ORDER BY k) - 1) AS hlc, CASE WHEN deleted THEN 'delete' ELSE 'upsert' END AS op_type, 'orders' AS col_id, CAST(o_orderkey AS VARCHAR) AS record_id FROM c""",
)
def capture_ops(spark, d):
    """Orders as local changes in order of date."""
    o = table(spark, d, "orders")
    ms = tables.day_ms(F.col("o_orderdate")) + (F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60).cast("long") * 1000 + (F.second("o_orderdate") * 1000).cast("long")
    changes = o.select(F.lit("orders").alias("col_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.struct("o_orderdate", "o_orderkey").alias("change_no"), ms.alias("ms"), (F.col("o_orderstatus") == "F").alias("deleted"), F.struct("o_orderkey", "o_totalprice").alias("fields"))
    return fold.capture(changes, "me", 100, F.expr("ms div 86400000")).drop("payload")


@query(
    "payload_overlay",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey * 2 ELSE c_nationkey END AS nation FROM customer""",
)
def payload_overlay(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    third = c.filter("id % 3 = 0")
    text = F.concat(F.lit('{"name":"new'), F.col("id").cast("string"), F.lit('","nation":'), F.when(F.col("id") % 6 == 0, "null").otherwise((F.col("id") * 2).cast("string")), F.lit("}"))
    return fold.overlay(c, third.select("id", text.alias("payload")), "id", {"name": "string", "nation": "long"})


@query("clock_codec", f"WITH {LOG} SELECT hlc, CAST(day AS BIGINT) AS physical, CAST(lg AS INTEGER) AS logical, hlc AS again FROM (SELECT DISTINCT printf('%016x', day) || '-' || printf('%04x', lg) AS hlc, day, lg FROM numbered)")
def clock_codec(spark, d):
    h = tables.oplog(spark, d).select("hlc").distinct()
    p, c = clock.physical_of(F.col("hlc")), clock.logical_of(F.col("hlc"))
    return h.select("hlc", p.alias("physical"), c.alias("logical"), clock.encode(p, c).alias("again"))


@query("kv_state", "SELECT 'k' || (event_id % 37) AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def kv_state(spark, d):
    e = table(spark, d, "events")
    return timeline.last_values(e.select(F.concat(F.lit("k"), (F.col("event_id") % 37).cast("string")).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("write_no")))


# compaction: the oracles ask for a later operation with EXISTS


def _later(ops: str, key: str, kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM (SELECT {key}, max(hlc || '/' || src_node) AS m FROM {ops} WHERE op_type IN {kinds} GROUP BY {key}) b WHERE {' AND '.join(f'b.{k.strip()} = a.{k.strip()}' for k in key.split(','))} AND b.m > a.hlc || '/' || a.src_node)"


REC_KINDS, COL_KINDS = "('upsert', 'delete')", "('col_upsert', 'col_delete')"
REST = f"rest AS (SELECT * FROM oplog a WHERE NOT (created < TIMESTAMP '{GRACE}' AND {_later('oplog', 'col_id, record_id', REC_KINDS)}))"


@query("compact_superseded", f"WITH {LOG}, {REST} SELECT src_node, src_seq FROM rest")
def compact_superseded(spark, d):
    return compaction.drop_superseded(tables.oplog(spark, d), GRACE).select("src_node", "src_seq")


@query("compact_schema_ops", f"WITH {SCHEMA_LOG} SELECT src_node, src_seq, op_type FROM slog a WHERE op_type IN {COL_KINDS} AND NOT (created < TIMESTAMP '{GRACE}' AND {_later('slog', 'record_id', COL_KINDS)})")
def compact_schema_ops(spark, d):
    return compaction.drop_superseded(tables.oplog_with_schema(spark, d), GRACE).filter(F.col("op_type").startswith("col_")).select("src_node", "src_seq", "op_type")


OLD_HORIZON = [("node01", 7), ("node04", 100_000_000)]
HORIZON_SQL = f"""hz AS (SELECT src_node, max(min_seq) AS min_seq FROM (SELECT * FROM (VALUES ('node01', 7), ('node04', 100000000)) AS o(src_node, min_seq)
UNION ALL SELECT src_node, max(src_seq) FROM rest WHERE op_type = 'delete' AND created < TIMESTAMP '{EXPIRY}' GROUP BY 1) GROUP BY 1)"""


def old_horizon(spark):
    return frame(spark, OLD_HORIZON, "src_node string, min_seq long")


@query("tombstone_horizon", f"WITH {LOG}, {REST}, {HORIZON_SQL} SELECT * FROM hz")
def tombstone_horizon(spark, d):
    return compaction.compact(tables.oplog(spark, d), old_horizon(spark), GRACE, EXPIRY)[1]


@query("compact_full", f"WITH {LOG}, {REST} SELECT src_node, src_seq, op_type FROM rest WHERE NOT (op_type = 'delete' AND created < TIMESTAMP '{EXPIRY}')")
def compact_full(spark, d):
    return compaction.compact(tables.oplog(spark, d), old_horizon(spark), GRACE, EXPIRY)[0].select("src_node", "src_seq", "op_type")


@query("version_purge", f"WITH {LOG} SELECT col_id, record_id FROM (SELECT *, {LATEST} AS k FROM oplog WHERE created < TIMESTAMP '2024-01-20') WHERE k = 1 AND NOT (op_type = 'delete' AND created < TIMESTAMP '{EXPIRY}')")
def version_purge(spark, d):
    empty = frame(spark, [], "col_id string, record_id string, hlc string, src_node string, deleted boolean, updated timestamp_ntz")
    versions = fold.merge_versions(empty, tables.oplog(spark, d).filter("created < timestamp_ntz'2024-01-20 00:00:00'"))
    return compaction.purge_versions(versions, EXPIRY).select("col_id", "record_id")


# snapshots, rescue, identity


STATE = f"state AS (SELECT * FROM (SELECT *, {LATEST} AS k FROM oplog WHERE event_id % 2 = 0) WHERE k = 1)"


def half_state(spark, d, rest: int):
    return fold.winners(tables.oplog(spark, d).filter(F.col("event_id") % 2 == rest))


@query("snapshot_page", f"WITH {LOG}, {STATE} SELECT col_id, record_id, payload, CASE WHEN record_id > 'rec00020' THEN '0000000000000000-0001' ELSE hlc END AS hlc, CASE WHEN record_id > 'rec00020' THEN 'peer' ELSE src_node END AS src_node FROM state WHERE col_id = 'col1' AND op_type <> 'delete' AND record_id > 'rec00005' ORDER BY record_id LIMIT 20")
def snapshot_page(spark, d):
    state = half_state(spark, d, 0)
    return snapshot.page(fold.live(state), state.filter("record_id <= 'rec00020'"), "col1", "rec00005", 20, "peer")


@query("snapshot_meta", f"WITH {LOG}, {STATE}, {CATALOG_SQL} SELECT cat.id AS col_id, name, count(state.record_id) AS rows FROM cat LEFT JOIN state ON state.col_id = cat.id AND op_type <> 'delete' GROUP BY 1, 2")
def snapshot_meta(spark, d):
    return snapshot.meta(catalog(spark), fold.live(half_state(spark, d, 0)))


@query("snapshot_merge", f"WITH {LOG}, {STATE}, other AS (SELECT * FROM (SELECT *, {LATEST} AS k FROM oplog WHERE event_id % 2 = 1) WHERE k = 1 AND src_node <> 'node02'), u AS (SELECT * EXCLUDE k FROM state UNION ALL SELECT * EXCLUDE k FROM other) SELECT col_id, record_id, op_type, payload, hlc, src_node FROM (SELECT *, {LATEST} AS k FROM u) WHERE k = 1")
def snapshot_merge(spark, d):
    return snapshot.merge(half_state(spark, d, 0), half_state(spark, d, 1), "node02").select("col_id", "record_id", "op_type", "payload", "hlc", "src_node")


@query(
    "reconcile_collections",
    """SELECT c AS col_id, CAST(doc_id AS VARCHAR) AS record_id, 'snapshot-reconcile' AS src_node FROM documents, (VALUES ('a'), ('b')) AS t(c)
    WHERE NOT (c = 'a' AND doc_id % 2 = 0) AND NOT (c = 'b' AND doc_id % 3 = 0)""",
)
def reconcile_collections(spark, d):
    """Two collections with the same ids: the peer lacks a's odd ones; of b only every third has a fresh version."""
    ids = tables.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("record_id"))
    both = ids.withColumn("col_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    seen = both.filter("col_id = 'a' and doc_id % 2 = 0")
    versions = both.filter("col_id = 'b' and doc_id % 3 = 0").withColumn("hlc", F.lit(f"{2000:016x}"))
    return snapshot.reconcile(both.select("col_id", "record_id"), seen, versions, f"{1500:016x}")


@query("reconcile_deletes", "SELECT CAST(doc_id AS VARCHAR) AS record_id, 'snapshot-reconcile' AS src_node FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND (doc_id % 17 = 0 OR printf('%016x', 1000 + doc_id) < printf('%016x', 1500))")
def reconcile_deletes(spark, d):
    local = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "doc_id")
    versions = local.filter("doc_id % 17 <> 0").select("record_id", F.format_string("%016x", F.lit(1000) + F.col("doc_id")).alias("hlc"))
    seen = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    return snapshot.reconcile(local.select("record_id"), seen, versions, f"{1500:016x}")


@query("rescue_unacked", f"WITH {LOG} SELECT src_node, src_seq, hlc, record_id FROM oplog WHERE src_node = 'node02' AND src_seq > 150")
def rescue_unacked(spark, d):
    return snapshot.unacknowledged(tables.oplog(spark, d), "node02", 150).select("src_node", "src_seq", "hlc", "record_id")


@query(
    "rescue_replay",
    f"""WITH {LOG}, {STATE}, r AS (SELECT o.*, s.hlc || '/' || s.src_node AS cur, max(o.hlc || '/' || o.src_node) OVER (PARTITION BY o.col_id, o.record_id ORDER BY o.src_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
FROM oplog o LEFT JOIN state s USING (col_id, record_id) WHERE o.src_node = 'node02' AND o.src_seq > 150)
SELECT 'node02b' AS src_node, 900 + row_number() OVER (ORDER BY src_seq) AS src_seq, hlc, op_type, col_id, record_id, payload FROM r WHERE (cur IS NULL OR hlc || '/' || src_node > cur) AND (best IS NULL OR hlc || '/' || src_node > best)""",
)
def rescue_replay(spark, d):
    rescued = snapshot.unacknowledged(tables.oplog(spark, d), "node02", 150)
    return snapshot.replay(rescued, half_state(spark, d, 0), "node02b", 900)


@query("reemit_ops", f"WITH {LOG} SELECT 'node77' AS src_node, row_number() OVER (ORDER BY src_seq) AS src_seq, hlc, op_type, col_id, record_id, payload, src_seq AS old_seq FROM oplog WHERE src_node = 'node01' AND src_seq > 40")
def reemit_ops(spark, d):
    return snapshot.reissue(tables.oplog(spark, d), "node01", "node77", 40)


@query("reemit_versions", f"WITH {LOG} SELECT col_id, record_id, hlc, CASE WHEN src_node = 'node01' AND src_seq > 40 THEN 'node77' ELSE src_node END AS src_node FROM (SELECT *, {LATEST} AS k FROM oplog) WHERE k = 1")
def reemit_versions(spark, d):
    ops = tables.oplog(spark, d)
    versions = fold.winners(ops).select("col_id", "record_id", "hlc", "src_node")
    return snapshot.move_versions(versions, snapshot.reissue(ops, "node01", "node77", 40), "node01", "node77").select("col_id", "record_id", "hlc", "src_node")


@query("duplicate_node_ids", "SELECT 'node' || (s_suppkey % 37) AS node_id, count(DISTINCT s_nationkey) AS instances FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1")
def duplicate_node_ids(spark, d):
    s = table(spark, d, "supplier")
    return snapshot.duplicate_ids(s.select(F.concat(F.lit("node"), (F.col("s_suppkey") % 37).cast("string")).alias("node_id"), F.col("s_nationkey").alias("instance_id")))


@query("sanitized_state", "SELECT * FROM (VALUES ('bootstrap_done', '1'), ('vector.b', '9'), ('local_seq', '12'), ('node_id', 'a')) AS t(key, value)")
def sanitized_state(spark, d):
    state = frame(spark, [("bootstrap_done", "1"), ("vector.z", "3"), ("node_id", "b"), ("local_seq", "9")], "key string, value string")
    return snapshot.sanitized_state(state, frame(spark, [("a", 12), ("b", 9)], "src_node string, seq long"), "a", 7)


# exports


@query("record_export", """SELECT CAST(doc_id AS VARCHAR) AS record_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS payload, CASE WHEN doc_id % 9 = 0 THEN 'extra=' || source || '_' || doc_id ELSE 'cover=' || lang || ';extra=' || source || '_' || doc_id END AS files FROM documents""")
def record_export(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("lang")).alias("cover"), F.array(F.concat_ws("_", "source", "doc_id"), F.lit(None).cast("string")).alias("extra"))
    out = fold.export(docs, "doc_id", ["doc_id", "lang"], ["cover", "extra"])
    shown = F.array_join(F.transform(F.map_entries("files"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return out.select("record_id", "payload", shown.alias("files"))


@query("schema_export", """SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN '{"a":[1,2],"k":' || json_extract_string(props, '$.k') || ',"z":null}' END AS canonical FROM events""")
def schema_export(spark, d):
    """Schema texts with keys in any order and stray white space, some cut off."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    text = F.concat(F.lit('{ "z" : null, "k": '), F.col("k"), F.lit(' , "a" : [ 1, 2 ]'), F.when(F.col("event_id") % 50 == 0, "").otherwise("}"))
    return e.select("event_id", fold.canonical(text).alias("canonical"))


@query("adopted_clock", f"WITH {LOG} SELECT max(hlc) AS hlc, max(src_seq) AS seq FROM oplog WHERE src_node IN ('node01', 'node02', 'node03')")
def adopted_clock(spark, d):
    tops = tables.oplog(spark, d).filter(F.col("src_node").isin("node01", "node02", "node03")).groupBy("src_node").agg(F.max("hlc").alias("hlc"), F.max("src_seq").alias("seq"))
    return fold.adopt_clocks(tops)


@query("countries", "SELECT * FROM (VALUES ('DE', 'Germany'), ('FR', 'France'), ('JP', 'Japan')) AS t(code, name)")
def countries(spark, d):
    """A static JSON table of names by code, exploded."""
    text = frame(spark, [('{"DE":"Germany","FR":"France","JP":"Japan"}',)], "t string")
    return text.select(F.explode(F.from_json("t", "map<string,string>")).alias("code", "name"))


# rounds: pull, schema operations, parked ones, an adopted copy

PULL_SQL = f"""{LOG}, base AS (SELECT src_node, max(src_seq) AS top FROM oplog GROUP BY 1), l(case_no, lim) AS (VALUES (1, 50), (2, 100000000)),
page AS (SELECT l.case_no, o.src_node, o.src_seq FROM l JOIN (SELECT src_node, src_seq, row_number() OVER (ORDER BY src_node, src_seq) AS k FROM oplog WHERE src_seq > 10) o ON k <= l.lim)"""


@query(
    "pull_round",
    f"""WITH {PULL_SQL} SELECT CAST(case_no AS INTEGER) AS case_no, src_node, CASE WHEN src_node = 'node02' THEN 10 WHEN case_no = 2 THEN top + 5 ELSE coalesce(m, 10) END AS seq
FROM l, base LEFT JOIN (SELECT case_no AS c, src_node AS s, max(src_seq) AS m FROM page GROUP BY 1, 2) ON c = case_no AND s = src_node""",
)
def pull_round(spark, d):
    """node02's vector after one pull at 10 operations a source: by a full page, and by a short one, whose vector lies beyond the log by what compaction took."""
    ops, out = tables.oplog(spark, d), None
    told = ops.groupBy("src_node").agg((F.max("src_seq") + 5).alias("seq"))
    own = ops.select("src_node").distinct().withColumn("seq", F.lit(10).cast("long"))
    empty = frame(spark, [], "src_node string, min_seq long")
    for case_no, limit in ((1, 50), (2, 100_000_000)):
        vector = log.pull_round(ops.filter("src_seq <= 10"), own, ops, told, empty, limit, "node02")[1]
        one = vector.select(F.lit(case_no).alias("case_no"), "src_node", "seq")
        out = one if out is None else out.union(one)
    return out


@query("pull_round_log", f"WITH {PULL_SQL} SELECT src_node, src_seq FROM page WHERE case_no = 1 AND src_node <> 'node02' UNION SELECT src_node, src_seq FROM oplog WHERE src_seq <= 10")
def pull_round_log(spark, d):
    ops = tables.oplog(spark, d)
    own = ops.select("src_node").distinct().withColumn("seq", F.lit(10).cast("long"))
    return log.pull_round(ops.filter("src_seq <= 10"), own, ops, own, frame(spark, [], "src_node string, min_seq long"), 50, "node02")[0].select("src_node", "src_seq")


@query(
    "schema_effects",
    f"""WITH {SCHEMA_LOG}, local(id, content) AS (VALUES ('col0', '{{"name":"col0","version":1}}'), ('x1', '{{"name":"col1","version":2}}')), k AS (SELECT max(hlc || '/' || src_node) AS st FROM slog WHERE op_type = 'col_upsert' AND record_id = 'col0' AND src_seq < 100),
s AS (SELECT src_node, src_seq, record_id, payload, created, event_id, hlc || '/' || src_node AS st, CASE record_id WHEN 'col0' THEN 'col0' WHEN 'col1' THEN 'x1' END AS local_col_id FROM slog WHERE op_type = 'col_upsert'),
n AS (SELECT s.*, local.content, NOT (record_id = 'col0' AND s.st <= coalesce(k.st, '')) AS newer FROM s CROSS JOIN k LEFT JOIN local ON local.id = s.local_col_id),
j AS (SELECT *, max(st) FILTER (newer) OVER w AS best, arg_max(payload, st) FILTER (newer) OVER w AS held FROM n WINDOW w AS (PARTITION BY record_id ORDER BY created, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT src_node, src_seq, local_col_id, CASE WHEN NOT newer OR st <= best THEN 'none' WHEN payload = CASE WHEN best IS NULL THEN content ELSE held END THEN 'version' ELSE 'change' END AS effect FROM j""",
)
def schema_effects(spark, d):
    """Schema operations, some padded with white space, against local schemas found by id or by name, one with a version."""
    ops = tables.oplog_with_schema(spark, d)
    padded = ops.withColumns({"col_id": F.col("record_id"), "col_name": F.col("record_id"), "payload": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" \n"), "payload", F.lit("\t "))).otherwise(F.col("payload"))})
    local = frame(spark, [("col0", "posts", '{"version": 1, "name": "col0"}'), ("x1", "col1", '{"name":"col1","version":2}')], "id string, name string, content string")
    versions = padded.filter("op_type = 'col_upsert' and record_id = 'col0' and src_seq < 100").select("record_id", "hlc", "src_node")
    return fold.schema_effects(padded, local, versions).select("src_node", "src_seq", "local_col_id", "effect")


@query(
    "schema_field_merge",
    """WITH p AS (SELECT p_partkey AS k, 'c' || p_partkey % 7 AS collection, 'f' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'number' ELSE 'bool' END AS type FROM part)
SELECT collection, CASE WHEN k % 2 = 0 OR k % 11 <> 0 THEN 'e' || k ELSE 'r' || k END AS id, name, CASE WHEN k % 11 = 0 THEN 'json' ELSE type END AS type, false AS system FROM p WHERE k % 4 <> 0
UNION ALL SELECT collection, 'e' || k, name, type, true FROM p WHERE k % 5 = 0 AND (k % 4 = 0 OR (k % 2 = 1 AND k % 11 = 0))""",
)
def schema_field_merge(spark, d):
    """Fields under the same id, under another id, of another type, and left out."""
    k = F.col("p_partkey")
    mine = table(spark, d, "part").select(k, F.concat(F.lit("c"), (k % 7).cast("string")).alias("collection"), F.concat(F.lit("e"), k.cast("string")).alias("id"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "number").otherwise("bool").alias("type"), (k % 5 == 0).alias("system"))
    theirs = mine.filter("p_partkey % 4 <> 0").withColumns({"id": F.when(k % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("r"), k.cast("string"))), "type": F.when(k % 11 == 0, "json").otherwise(F.col("type")), "system": F.lit(False)})
    return fold.merge_fields(mine.drop("p_partkey"), theirs.drop("p_partkey"))


@query("parked_retry", f"WITH {SCHEMA_LOG} SELECT src_node, src_seq, CASE col_id WHEN 'col2' THEN 'col2' ELSE 'x1' END AS local_col_id, col_id = 'col2' OR (SELECT count(*) > 0 FROM slog WHERE op_type = 'col_upsert' AND record_id = 'col1') AS released FROM slog WHERE op_type IN ('upsert', 'delete') AND col_id <> 'col0' AND EXISTS (SELECT 1 FROM slog s WHERE s.op_type = 'col_upsert' AND s.record_id = slog.col_id) UNION ALL SELECT src_node, src_seq, NULL, false FROM slog WHERE op_type IN ('upsert', 'delete') AND (col_id = 'col0' OR NOT EXISTS (SELECT 1 FROM slog s WHERE s.op_type = 'col_upsert' AND s.record_id = slog.col_id))")
def parked_retry(spark, d):
    """Operations of three unknown collections: one's schema comes under its id, one's under another id and its name, one's never."""
    ops = tables.oplog_with_schema(spark, d).withColumn("col_name", F.col("col_id"))
    came = ops.filter("op_type = 'col_upsert' and record_id <> 'col0'").withColumns({"col_name": F.col("record_id"), "record_id": F.when(F.col("record_id") == "col1", "x1").otherwise(F.col("record_id"))})
    done, rest = fold.retry_parked(ops.filter("op_type in ('upsert', 'delete')"), frame(spark, [], "id string, name string"), came)
    return done.select("src_node", "src_seq", "local_col_id", F.lit(True).alias("released")).unionByName(rest.select("src_node", "src_seq", F.lit(None).cast("string").alias("local_col_id"), F.lit(False).alias("released")))


@query("copy_purge", f"WITH {LOG}, {STATE} SELECT 'versions' AS kept, col_id || '/' || record_id AS key FROM state UNION ALL SELECT 'posts', record_id FROM state WHERE col_id = 'col0' AND op_type <> 'delete'")
def copy_purge(spark, d):
    """A copy with clients, paths, seen rows and an excluded collection, after its adoption."""
    state = half_state(spark, d, 0)
    rows = {name: table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")) for name in ("clients", "client_paths", "sync_seen", "_logs")}
    rows |= {"versions": state.select(F.concat_ws("/", "col_id", "record_id").alias("key")), "posts": fold.live(state).filter("col_id = 'col0'").select(F.col("record_id").alias("key"))}
    out = None
    for name, left in snapshot.purge_copied(rows, CONFIG.excluded()).items():
        one = left.select(F.lit(name).alias("kept"), "key")
        out = one if out is None else out.union(one)
    return out
