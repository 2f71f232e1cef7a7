"""Queries over members, integrity, files, migrations and the event timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from opfold.operators import integrity, membership, migrations, timeline
from opfold.plans.log_queries import CONFIG, frame
from opfold.plans.registry import LOG, query
from opfold.sources import tables
from opfold.sources.tables import NOW, SELF, table

MEMBERS = f"""m AS (SELECT 'node' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS node_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'http://n' || s_suppkey END AS url, s_suppkey % 5 <> 0 AS reachable, TIMESTAMP '2024-01-01' AS joined_at,
  TIMESTAMP '{NOW}' - to_seconds((s_suppkey * s_suppkey) % 61) AS last_seen, s_suppkey % 11 = 0 AS removed, (s_suppkey * s_suppkey) % 61 AS age FROM supplier),
g AS (SELECT 'node' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS node_id, 'http://g' || s_suppkey AS url, s_suppkey % 3 <> 0 AS reachable, TIMESTAMP '2024-01-15' AS joined_at, TIMESTAMP '{NOW}' - to_seconds((s_suppkey * 7) % 61) AS last_seen, s_suppkey % 7 = 0 AS removed FROM supplier)"""
HEALTHY = f"CASE WHEN removed THEN false WHEN node_id = '{SELF}' THEN true ELSE age < 30 END"


@query("member_health", f"WITH {MEMBERS} SELECT node_id, {HEALTHY} AS healthy FROM m")
def member_health(spark, d):
    return tables.members(spark, d).select("node_id", membership.healthy(NOW, SELF, CONFIG.sync_interval).alias("healthy"))


@query(
    "merge_members",
    f"""WITH {MEMBERS}, a AS (SELECT * FROM m WHERE node_id <> 'node00007'), b AS (SELECT * FROM g WHERE node_id NOT IN ('node00009', '{SELF}')),
j AS (SELECT node_id, a.last_seen IS NULL OR b.last_seen > a.last_seen OR (b.last_seen = a.last_seen AND b.removed AND NOT a.removed) AS take, a.url AS au, b.url AS bu, a.reachable AS ar, b.reachable AS br, a.joined_at AS aj, b.joined_at AS bj, a.last_seen AS al, b.last_seen AS bl, a.removed AS ax, b.removed AS bx FROM a FULL JOIN b USING (node_id))
SELECT node_id, CASE WHEN take THEN bu ELSE au END AS url, CASE WHEN take THEN br ELSE ar END AS reachable, coalesce(aj, bj) AS joined_at, CASE WHEN take THEN bl ELSE al END AS last_seen, CASE WHEN take THEN bx ELSE ax END AS removed FROM j""",
)
def merge_members(spark, d):
    return membership.merge(tables.members(spark, d).filter("node_id <> 'node00007'"), tables.gossip(spark, d).filter("node_id <> 'node00009'"), SELF)


@query("upsert_members", f"WITH {MEMBERS}, r AS (SELECT * FROM g WHERE node_id LIKE '%3') SELECT node_id, coalesce(r.url, m.url) AS url, coalesce(r.last_seen, m.last_seen) AS last_seen, m.joined_at, coalesce(r.removed, m.removed) AS removed FROM m LEFT JOIN r USING (node_id)")
def upsert_members(spark, d):
    return membership.upsert(tables.members(spark, d), tables.gossip(spark, d).filter("node_id like '%3'")).select("node_id", "url", "last_seen", "joined_at", "removed")


@query("touch_members", f"WITH {MEMBERS} SELECT node_id, CASE WHEN node_id LIKE '%1' THEN TIMESTAMP '{NOW}' ELSE last_seen END AS last_seen, removed AND node_id NOT LIKE '%1' AS removed FROM m")
def touch_members(spark, d):
    m = tables.members(spark, d)
    return membership.touch(m, m.filter("node_id like '%1'"), NOW).select("node_id", "last_seen", "removed")


@query("leader", f"WITH {MEMBERS} SELECT min(node_id) AS leader, min(node_id) = '{SELF}' AS is_self FROM m WHERE node_id = '{SELF}' OR ({HEALTHY} AND NOT removed)")
def leader(spark, d):
    return membership.leader(tables.members(spark, d), NOW, SELF, CONFIG.sync_interval)


@query("push_targets", f"WITH {MEMBERS} SELECT node_id, url FROM m WHERE node_id <> '{SELF}' AND url <> '' AND NOT removed")
def push_targets(spark, d):
    return membership.push_targets(tables.members(spark, d), SELF).select("node_id", "url")


@query("peer_urls", f"WITH {MEMBERS} SELECT * FROM (SELECT node_id, CASE node_id WHEN 'node00002' THEN 'http://lan2' ELSE url END AS url FROM m WHERE NOT removed AND node_id <> '{SELF}') WHERE url <> ''")
def peer_urls(spark, d):
    return membership.peer_urls(tables.members(spark, d), frame(spark, [("node00002", "http://lan2/"), ("node00004", "")], "node_id string, url string"), SELF)


@query("member_flags", f"WITH o AS (SELECT 'node' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS node_id, (s_suppkey * 13) % 101 AS age, s_suppkey % 11 = 0 AS removed FROM supplier), f AS (SELECT node_id, age, removed OR (node_id <> '{SELF}' AND age > 30) AS removed FROM o) SELECT node_id, removed FROM f WHERE NOT (node_id <> '{SELF}' AND removed AND age > 60)")
def member_flags(spark, d):
    from opfold.operators import compaction

    return compaction.flag_members(tables.old_members(spark, d), SELF, "2024-01-02 00:00:00", "2023-12-03 00:00:00").select("node_id", "removed")


CHECKS = "c AS (SELECT user_id % 50 AS p, event_id AS t, event_type <> 'error' AS healthy FROM events)"


@query("health_transitions", f"WITH {CHECKS} SELECT 'peer' || p AS peer, t, healthy FROM (SELECT *, lag(healthy) OVER (PARTITION BY p ORDER BY t) AS b FROM c) WHERE b IS NOT NULL AND b <> healthy")
def health_transitions(spark, d):
    e = table(spark, d, "events")
    return membership.health_changes(e.select(F.concat(F.lit("peer"), (F.col("user_id") % 50).cast("string")).alias("peer"), F.col("event_id").alias("t"), (F.col("event_type") != "error").alias("healthy")))


@query("peer_errors", f"WITH {CHECKS} SELECT 'peer' || p AS peer, t, CASE WHEN healthy THEN 'clear' ELSE 'report' END AS action FROM (SELECT *, lag(healthy) OVER (PARTITION BY p ORDER BY t) AS b FROM c) WHERE (NOT healthy AND coalesce(b, true)) OR (healthy AND NOT coalesce(b, true))")
def peer_errors(spark, d):
    e = table(spark, d, "events")
    return membership.error_slots(e.select(F.concat(F.lit("peer"), (F.col("user_id") % 50).cast("string")).alias("peer"), F.col("event_id").alias("t"), F.when(F.col("event_type") == "error", F.col("props")).alias("error")))


@query("blob_sources", f"WITH {MEMBERS} SELECT node_id, row_number() OVER (ORDER BY CASE WHEN node_id = 'node00004' THEN 0 ELSE 1 END, node_id) AS place FROM m WHERE node_id <> '{SELF}' AND url <> '' AND NOT removed")
def blob_sources(spark, d):
    return membership.blob_sources(tables.members(spark, d), "node00004", SELF)


@query(
    "status_members",
    f"""WITH {MEMBERS}, {LOG}, v AS (SELECT 'node0000' || substr(src_node, 6) AS node_id, max(src_seq) AS seq FROM oplog GROUP BY 1)
SELECT m.node_id, url, removed, {HEALTHY.replace("node_id", "m.node_id")} AS healthy, coalesce(seq, 0) AS seq, CAST(CASE WHEN m.node_id = '{SELF}' THEN 0 WHEN m.node_id = 'node00001' THEN 4 ELSE -1 END AS BIGINT) AS lag, CASE WHEN m.node_id = 'node00002' THEN 'refused' ELSE '' END AS error
FROM m LEFT JOIN v ON v.node_id = m.node_id""",
)
def status_members(spark, d):
    own = tables.oplog(spark, d).groupBy(F.concat(F.lit("node0000"), F.substring("src_node", 6, 9)).alias("src_node")).agg(F.max("src_seq").alias("seq"))
    return membership.status(tables.members(spark, d), own, frame(spark, [("node00001", 4)], "peer string, lag long"), frame(spark, [("node00002", "refused")], "peer string, error string"), NOW, SELF, CONFIG.sync_interval)


@query("status_counters", f"WITH {MEMBERS}, {LOG} SELECT (SELECT count(*) FROM m WHERE NOT removed) AS members, (SELECT count(*) FROM m WHERE {HEALTHY}) AS healthy, (SELECT count(*) FROM oplog) AS ops, (SELECT count(DISTINCT src_node) FROM oplog) AS sources")
def status_counters(spark, d):
    m = tables.members(spark, d).agg(F.count_if(~F.col("removed")).alias("members"), F.count_if(membership.healthy(NOW, SELF, CONFIG.sync_interval)).alias("healthy"))
    return m.crossJoin(tables.oplog(spark, d).agg(F.count("*").alias("ops"), F.count_distinct("src_node").alias("sources")))  # two single rows


# integrity

REFS = """r AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'customer' AS field, CASE WHEN o_custkey % 53 = 0 THEN -o_custkey ELSE o_custkey END AS target_id FROM orders
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'parts', CASE WHEN l_partkey % 101 = 0 THEN -l_partkey ELSE l_partkey END FROM lineitem),
d AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE r.field = 'customer' AND c.c_custkey = r.target_id) AND NOT EXISTS (SELECT 1 FROM part p WHERE r.field = 'parts' AND p.p_partkey = r.target_id))"""


def references(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    single = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 53 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("customer"))
    multi = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_partkey") % 101 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))).alias("parts"))
    refs = integrity.references(single, {"customer": "customers"}).unionByName(integrity.references(multi, {"parts": "parts"}))
    targets = table(spark, d, "customer").select(F.lit("customers").alias("target_col"), F.col("c_custkey").cast("string").alias("target_id")).unionByName(table(spark, d, "part").select(F.lit("parts").alias("target_col"), F.col("p_partkey").cast("string").alias("target_id")))
    return single, refs, integrity.dangling(refs, targets)


@query("dangling_refs", f"WITH {REFS} SELECT record_id, field, CAST(target_id AS VARCHAR) AS target_id FROM d")
def dangling_refs(spark, d):
    return references(spark, d)[2].select("record_id", "field", "target_id")


@query("integrity_listed", f"WITH {REFS} SELECT record_id, field, CAST(target_id AS VARCHAR) AS target_id FROM d ORDER BY field, record_id, CAST(target_id AS VARCHAR) LIMIT 500")
def integrity_listed(spark, d):
    return integrity.listed(references(spark, d)[2], CONFIG.max_dangling).select("record_id", "field", "target_id")


@query("integrity_summary", f"WITH {REFS}, n AS (SELECT count(*) AS k FROM d) SELECT (SELECT count(*) FROM orders) AS scanned, (SELECT count(*) FROM (SELECT DISTINCT field, target_id FROM r)) AS checked_refs, k AS dangling, least(k, 500) AS listed, CASE WHEN k > 500 THEN k ELSE 0 END AS truncated_at, k = 0 AS converged FROM n")
def integrity_summary(spark, d):
    records, refs, found = references(spark, d)
    return integrity.report(records, refs, found, CONFIG.max_dangling)


@query("missing_blobs", "SELECT CAST(doc_id AS VARCHAR) AS record_id, unnest([source || '_' || doc_id, lang || '_' || doc_id]) AS name FROM documents WHERE doc_id % 9 = 0")
def missing_blobs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "doc_id", F.array(F.concat_ws("_", "source", "doc_id"), F.concat_ws("_", "lang", "doc_id")).alias("names"))
    stored = docs.filter("doc_id % 9 <> 0").select("record_id", F.explode("names").alias("name"))
    return integrity.missing_files(docs.select("record_id", F.create_map(F.lit("attachment"), F.col("names")).alias("files")), stored)


# migrations

PEERS = "p(file) AS (VALUES ('m1.js'), ('m2.js'), ('m3.js')), df(file) AS (VALUES ('m1.js'), ('m3.js'), ('m4.js'), ('m5.js'), ('m6.js'), ('m7.js')), ap(file) AS (VALUES ('m0.js'), ('m4.js'))"


@query("migration_union", f"WITH {PEERS} SELECT file FROM p")
def migration_union(spark, d):
    return migrations.cluster_applied(tables.peer_migrations(spark))


@query("migration_reachable", "SELECT 3::BIGINT AS reachable, 4::BIGINT AS peers")
def migration_reachable(spark, d):
    return migrations.reachable(tables.peer_migrations(spark))


@query("migrations_to_import", f"WITH {PEERS} SELECT file FROM df INTERSECT SELECT file FROM p")
def migrations_to_import(spark, d):
    return migrations.to_import(tables.files_of(spark, tables.DEFERRED), tables.files_of(spark, tables.APPLIED), tables.peer_migrations(spark))


@query("migrations_to_run", f"WITH {PEERS} SELECT file FROM df EXCEPT SELECT file FROM p EXCEPT SELECT file FROM ap")
def migrations_to_run(spark, d):
    return migrations.to_run(tables.files_of(spark, tables.DEFERRED), tables.files_of(spark, tables.APPLIED), tables.peer_migrations(spark))


@query("migrations_unapplied", f"WITH {PEERS} SELECT count(*) AS unapplied FROM (SELECT file FROM df EXCEPT SELECT file FROM ap)")
def migrations_unapplied(spark, d):
    return migrations.unapplied(tables.files_of(spark, tables.DEFERRED), tables.files_of(spark, tables.APPLIED))


# timeline

TYPES = "CASE event_type WHEN 'click' THEN 'op_applied' WHEN 'error' THEN 'op_failed' WHEN 'purchase' THEN 'peer_healthy' WHEN 'signup' THEN 'peer_unhealthy' WHEN 'view' THEN 'snapshot' END"
LINE = f"tl AS (SELECT event_id AS seq, ts AS time, {TYPES} AS type, 'col' || (event_id % 7) AS collection, 'peer' || (user_id % 9) AS peer FROM events)"


@query("event_ring", f"WITH {LINE} SELECT * FROM tl ORDER BY seq DESC LIMIT 512")
def event_ring(spark, d):
    return timeline.latest(tables.timeline(spark, d), CONFIG.event_buffer_size)


@query("events_by_type", f"WITH {LINE} SELECT type, count(*) AS n, max(seq) AS last_seq, max(time) AS last_time FROM tl GROUP BY 1")
def events_by_type(spark, d):
    return timeline.by_type(tables.timeline(spark, d))


@query("events_filtered", f"WITH {LINE} SELECT seq, time, peer FROM tl WHERE type = 'op_failed' ORDER BY seq DESC LIMIT 200")
def events_filtered(spark, d):
    return timeline.latest(tables.timeline(spark, d).filter("type = 'op_failed'"), 200).select("seq", "time", "peer")


GREEDY = f"""WITH RECURSIVE {LINE}, f AS (SELECT collection, min(time) AS time FROM tl GROUP BY 1),
walk AS (SELECT collection, time FROM f UNION ALL SELECT w.collection, (SELECT min(t.time) FROM tl t WHERE t.collection = w.collection AND t.time >= w.time + INTERVAL 1 HOUR) FROM walk w WHERE w.time IS NOT NULL)"""


@query("throttled_events", GREEDY + " SELECT tl.collection, min(seq) AS seq, time FROM walk JOIN tl USING (collection, time) GROUP BY 1, 3")
def throttled_events(spark, d):
    return timeline.throttle(tables.timeline(spark, d), "collection", 3600).select("collection", "seq", "time")


@query("debounce_batches", GREEDY + ", o AS (SELECT collection, time AS opened, lead(time) OVER (PARTITION BY collection ORDER BY time) AS until FROM walk WHERE time IS NOT NULL) SELECT o.collection, opened, count(*) AS wakes FROM o JOIN tl ON tl.collection = o.collection AND tl.time >= opened AND (until IS NULL OR tl.time < until) GROUP BY 1, 2")
def debounce_batches(spark, d):
    return timeline.debounce(tables.timeline(spark, d), "collection", 3600)


@query("sync_progress", "SELECT event_id, CAST(CASE WHEN t <= 0 THEN 0 WHEN k >= t THEN 100 ELSE k * 100 // t END AS BIGINT) AS percent, CASE WHEN t > 0 AND k >= t THEN 0.0 WHEN t > 0 AND k > 0 THEN round((t - k) / (k / 10.0), 3) END AS eta FROM (SELECT event_id, event_id % 201 AS k, event_id % 7 * 40 AS t FROM events)")
def sync_progress(spark, d):
    k, t = F.col("event_id") % 201, F.col("event_id") % 7 * 40
    return table(spark, d, "events").select("event_id", timeline.percent(k, t).alias("percent"), F.round(timeline.eta_seconds(k.cast("double"), t, F.lit(10.0)), 3).alias("eta"))


@query("migrated_rows", f"WITH {LOG}, s AS (SELECT col_id, count(DISTINCT record_id) AS rows FROM oplog GROUP BY 1) SELECT * FROM s UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT) FROM s")
def migrated_rows(spark, d):
    counts = tables.oplog(spark, d).groupBy("col_id").agg(F.count_distinct("record_id").alias("rows"))
    return timeline.with_total(counts, "col_id", "rows")


@query(
    "global_error",
    """WITH r AS (SELECT 'n' || user_id % 7 AS node, 'p' || event_id % 9 AS peer, event_id AS t, CASE WHEN event_type IN ('error', 'click') THEN 'sync ' || event_id END AS error FROM events),
s AS (SELECT *, lag(error) OVER (PARTITION BY node, peer ORDER BY t) AS b FROM r), e AS (SELECT node, arg_max(peer, t) AS peer, max(t) AS t, arg_max(error, t) AS error FROM s WHERE error IS NOT NULL AND b IS NULL GROUP BY 1)
SELECT n.node, CASE WHEN e.error IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.node = e.node AND r.peer = e.peer AND r.t > e.t AND r.error IS NULL) THEN '' ELSE e.error END AS error FROM (SELECT DISTINCT node FROM r) n LEFT JOIN e USING (node)""",
)
def global_error(spark, d):
    e = table(spark, d, "events")
    failed = F.when(F.col("event_type").isin("error", "click"), F.concat_ws(" ", F.lit("sync"), "event_id"))
    return membership.global_error(e.select(F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")).alias("node"), F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string")).alias("peer"), F.col("event_id").alias("t"), failed.alias("error")))


@query("members_listed", f"WITH {MEMBERS} SELECT node_id, url, removed FROM m ORDER BY node_id")
def members_listed(spark, d):
    return membership.listed(tables.members(spark, d)).select("node_id", "url", "removed")


@query("migrations_listed", "SELECT DISTINCT p_brand || '.js' AS file FROM part ORDER BY file")
def migrations_listed(spark, d):
    return migrations.listed(table(spark, d, "part").select(F.concat("p_brand", F.lit(".js")).alias("file")))
