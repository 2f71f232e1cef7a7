"""Queries over rules, geography and client telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from opfold.functions.network import address_class, ipv4, ipv4_class
from opfold.operators import firewall, telemetry
from opfold.plans.log_queries import CONFIG
from opfold.plans.registry import query
from opfold.sources import tables

IP4 = "CASE WHEN regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}') THEN CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END"
REQUESTS = f"""q0 AS (SELECT CASE WHEN user_id % 10 = 0 THEN '192.168.0.' || (user_id % 256) ELSE (20 + user_id % 3) || '.' || (user_id % 7) || '.' || (user_id // 256) || '.' || (user_id % 256) END AS ip, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_id % 9 = 0 THEN '/api/replication/' ELSE '/api/' END || event_type || '/' || (event_id % 20) AS path, event_type = 'error' AS blocked, ts, event_id FROM events),
q AS (SELECT *, {IP4} AS n, CASE WHEN starts_with(path, '/api/replication/') THEN 'replication' ELSE 'app' END AS scope FROM q0)"""
_geo = ", ".join(f"({tables.number_of(a)}, {tables.number_of(b)}, '{c}', '{r}', '{t}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for a, b, c, r, t, x, y in tables.GEO)
PLACES = f"""geo(lo, hi, country, region, city, lat, lon) AS (VALUES {_geo}),
ips AS (SELECT DISTINCT ip, n FROM q),
place AS (SELECT * EXCLUDE k FROM (SELECT ips.ip, ips.n, country, region, city, lat, lon, row_number() OVER (PARTITION BY ips.ip ORDER BY hi - lo, lo) AS k FROM ips LEFT JOIN geo ON n BETWEEN lo AND hi) WHERE k = 1)"""
PRIVATE = "(n IS NULL OR n >> 24 IN (10, 127) OR n >> 20 = 2753 OR n >> 16 IN (49320, 43518) OR n = 0)"
_n = tables.number_of
RULES = f"""rule(action, scope, kind, value, lo, hi) AS (VALUES ('deny', 'app', 'ip', '20.1.0.3', {_n("20.1.0.3")}, {_n("20.1.0.3")}), ('deny', 'app', 'cidr', '21.3.0.0/16', {_n("21.3.0.0")}, {_n("21.3.255.255")}), ('allow', 'app', 'cidr', '20.0.0.0/7', {_n("20.0.0.0")}, {_n("21.255.255.255")}),
('allow', 'app', 'country', 'AA', NULL, NULL), ('deny', 'app', 'country', 'BB', NULL, NULL), ('deny', 'replication', 'cidr', '22.5.0.0/16', {_n("22.5.0.0")}, {_n("22.5.255.255")}), ('deny', 'replication', 'ip', '192.168.0.10', {_n("192.168.0.10")}, {_n("192.168.0.10")}))"""


def judged(spark):
    return firewall.judge_rules(tables.rules(spark), has_geo=True, has_regions=False)


@query("rule_compile", f"WITH {RULES} SELECT action, scope, kind AS match_type, value, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM rule")
def rule_compile(spark, d):
    return firewall.compiled(judged(spark)).select("action", "scope", "match_type", "value", "lo", "hi")


#: Every client as an address of both families: the customer's number in an IPv6 network, or the same in an IPv4 one.
TWO_FAMILIES = """f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN printf('2001:db8:%x::%x', c_custkey // 256, c_custkey % 256) WHEN c_custkey % 3 = 1 THEN printf('::ffff:10.0.%d.%d', (c_custkey // 256) % 256, c_custkey % 256) WHEN c_custkey % 15 = 2 THEN '::1' ELSE printf('20.0.%d.%d', (c_custkey // 256) % 256, c_custkey % 256) END AS ip FROM customer)"""


@query("firewall_two_families", f"WITH {TWO_FAMILIES} SELECT c_custkey, ip, CASE WHEN ip = '::1' THEN 'loopback' WHEN c_custkey % 3 = 0 AND c_custkey // 256 = 1 THEN 'denied' WHEN c_custkey % 3 = 0 AND c_custkey % 256 < 128 OR c_custkey % 3 = 1 THEN 'open' ELSE 'not listed' END AS why FROM f")
def firewall_two_families(spark, d):
    key = F.col("c_custkey")
    ip = (
        F.when(key % 3 == 0, F.format_string("2001:db8:%x::%x", F.floor(key / 256), key % 256))
        .when(key % 3 == 1, F.format_string("::ffff:10.0.%d.%d", F.floor(key / 256) % 256, key % 256))
        .when(key % 15 == 2, "::1")
        .otherwise(F.format_string("20.0.%d.%d", F.floor(key / 256) % 256, key % 256))
    )
    q = tables.table(spark, d, "customer").select("c_custkey", ip.alias("ip"), F.lit("app").alias("scope"), F.lit(False).alias("superuser"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("region"))
    networks = tables.table(spark, d, "customer").select(F.floor(key / 256).alias("n")).distinct().select(F.lit("allow").alias("action"), F.lit("app").alias("scope"), F.lit("cidr").alias("match_type"), F.format_string("2001:DB8:%x:0::0/121", "n").alias("value"), F.lit(True).alias("active"))
    more = spark.createDataFrame([("deny", "app", "cidr", "2001:db8:1::/48", True), ("allow", "app", "ip", "10.0.0.1.2", True), ("allow", "app", "cidr", "10.0.0.0/8", True), ("deny", "app", "ip", "::1", True)], networks.schema)
    decided_ = firewall.decide(q, firewall.compiled(firewall.judge_rules(networks.union(more), False, False)))
    return decided_.select("c_custkey", "ip", "why")


@query("rule_warnings", "SELECT * FROM (VALUES ('bad ip', 1::BIGINT), ('bad cidr', 1), ('no region data', 1), ('unknown match type', 1)) AS t(reason, rules)")
def rule_warnings(spark, d):
    return firewall.warnings(judged(spark))


@query("ip_class", f"WITH {REQUESTS} SELECT DISTINCT ip, CASE WHEN {PRIVATE} THEN 'private' ELSE '' END AS class FROM q")
def ip_class(spark, d):
    ips = tables.requests(spark, d).select("ip").distinct()
    return ips.select("ip", ipv4_class(F.col("ip")).alias("class"))


@query("ip_class_v6", "SELECT * FROM (VALUES ('::1', 'private'), ('fe80::1', 'private'), ('fd00::7', 'private'), ('2001:db8::1', ''), ('::ffff:10.0.0.1', 'private'), ('nonsense', 'private'), ('8.8.8.8', ''), ('::', 'private')) AS t(ip, class)")
def ip_class_v6(spark, d):
    ips = tables.files_of(spark, ["::1", "fe80::1", "fd00::7", "2001:db8::1", "::ffff:10.0.0.1", "nonsense", "8.8.8.8", "::"]).toDF("ip")
    return ips.select("ip", address_class(F.col("ip")).alias("class"))


def decided(spark, d):
    q = tables.requests(spark, d).withColumn("scope", firewall.scope_of(F.col("path"))).withColumn("superuser", F.col("event_id") % 50 == 0)
    return firewall.decide(firewall.locate(q, tables.geo_ranges(spark)), firewall.compiled(judged(spark)))


DECISIONS = f"""WITH {REQUESTS}, {PLACES}, {RULES},
v AS (SELECT q.*, EXISTS (SELECT 1 FROM rule r WHERE r.action = 'deny' AND r.scope = q.scope AND (q.n BETWEEN r.lo AND r.hi OR (r.kind = 'country' AND r.value = p.country))) AS denied,
  EXISTS (SELECT 1 FROM rule r WHERE r.action = 'allow' AND r.scope = q.scope AND (q.n BETWEEN r.lo AND r.hi OR (r.kind = 'country' AND r.value = p.country))) AS listed FROM q JOIN place p USING (ip)),
w AS (SELECT *, CASE WHEN event_id % 50 = 0 AND scope = 'app' THEN 'superuser' WHEN denied THEN 'denied' WHEN scope = 'app' AND NOT listed THEN 'not listed' ELSE 'open' END AS why FROM v)"""


@query("firewall_decisions", DECISIONS + " SELECT event_id, ip, scope, why, why NOT IN ('denied', 'not listed') AS allowed FROM w")
def firewall_decisions(spark, d):
    return decided(spark, d).select("event_id", "ip", "scope", "why", "allowed")


@query("firewall_summary", DECISIONS + " SELECT 7::BIGINT AS rules, 4::BIGINT AS skipped, 'app' AS whitelist_scopes, count(*) FILTER (why IN ('denied', 'not listed')) AS blocked, count(*) AS requests FROM w")
def firewall_summary(spark, d):
    return firewall.summary(judged(spark), decided(spark, d))


@query("blocked_geo", "SELECT 'country' AS kind, 'BB' AS place")
def blocked_geo(spark, d):
    return firewall.blocked_places(firewall.compiled(judged(spark)))


CLIENTS = f"""WITH {REQUESTS}, {PLACES}, cl AS (SELECT ip, count(*) AS requests, count(*) FILTER (blocked) AS blocked, min(ts) AS first_seen, max(ts) AS last_seen FROM q GROUP BY 1),
en AS (SELECT cl.*, CASE WHEN {PRIVATE} THEN 'private' WHEN country IS NOT NULL THEN 'ok' ELSE 'failed' END AS geo_status, country, region, city, lat, lon FROM cl JOIN place USING (ip))"""


def enriched(spark, d):
    return firewall.enrich(telemetry.clients(tables.requests(spark, d)), tables.geo_ranges(spark))


@query("geo_enrich", CLIENTS + " SELECT ip, geo_status, country, region, city, lat, lon FROM en")
def geo_enrich(spark, d):
    return enriched(spark, d).select("ip", "geo_status", "country", "region", "city", "lat", "lon")


@query("client_counters", CLIENTS + " SELECT * FROM cl")
def client_counters(spark, d):
    return telemetry.clients(telemetry.usable(tables.requests(spark, d), CONFIG.path_bytes))


@query("client_counters_flushed", CLIENTS + " SELECT * FROM cl")
def client_counters_flushed(spark, d):
    """Two flushes added up."""
    q = tables.requests(spark, d)
    return telemetry.add(telemetry.clients(q.filter("event_id % 3 = 0")), telemetry.clients(q.filter("event_id % 3 <> 0")))


PATHS = CLIENTS + ", pa AS (SELECT ip, method, path, count(*) AS hits, max(ts) AS last_seen FROM q GROUP BY 1, 2, 3)"


@query("path_counters", PATHS + " SELECT * FROM pa")
def path_counters(spark, d):
    return telemetry.paths(telemetry.usable(tables.requests(spark, d), CONFIG.path_bytes))


@query("top_paths_per_ip", PATHS + " SELECT * FROM pa a WHERE (SELECT count(*) FROM pa b WHERE b.ip = a.ip AND b.hits > a.hits) < 5")
def top_paths_per_ip(spark, d):
    return telemetry.top_paths(telemetry.paths(tables.requests(spark, d)), 5)


@query("top_clients", CLIENTS + " SELECT ip, last_seen, requests FROM cl ORDER BY last_seen DESC, ip LIMIT 100")
def top_clients(spark, d):
    return telemetry.top_clients(telemetry.clients(tables.requests(spark, d)), 100).select("ip", "last_seen", "requests")


KEPT = PATHS + ", k AS (SELECT * FROM cl WHERE last_seen >= TIMESTAMP '2024-01-10' ORDER BY last_seen DESC, ip LIMIT 120)"


def collected(spark, d):
    q = tables.requests(spark, d)
    return telemetry.collect_garbage(telemetry.clients(q), telemetry.paths(q), "2024-01-10 00:00:00", 120, 3)


@query("client_gc", KEPT + " SELECT * FROM k")
def client_gc(spark, d):
    return collected(spark, d)[0]


@query("path_gc", KEPT + ", o AS (SELECT * FROM pa WHERE ip IN (SELECT ip FROM k)) SELECT * EXCLUDE r FROM (SELECT *, rank() OVER (PARTITION BY ip ORDER BY hits DESC) AS r FROM o) WHERE r <= 3")
def path_gc(spark, d):
    return collected(spark, d)[1]


@query("client_search", CLIENTS + " SELECT ip, requests FROM en WHERE contains(lower(concat_ws(' ', ip, country, region, city)), 'bb-0')")
def client_search(spark, d):
    return telemetry.search(enriched(spark, d), "BB-0").select("ip", "requests")


@query("map_cards", CLIENTS + " SELECT count(*) AS clients, count(*) FILTER (geo_status = 'ok') AS located, count(*) FILTER (blocked > 0) AS blocked_ips, count(DISTINCT region) AS regions, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM en")
def map_cards(spark, d):
    return telemetry.cards(enriched(spark, d))


@query("map_dots", CLIENTS + " SELECT ip, (lon + 180) / 360 * 960 AS x, (90 - lat) / 180 * 480 AS y FROM en WHERE lat <> 0 OR lon <> 0")
def map_dots(spark, d):
    return telemetry.dots(enriched(spark, d))


@query("ip_numbers", f"WITH {REQUESTS} SELECT DISTINCT ip, n FROM q")
def ip_numbers(spark, d):
    return tables.requests(spark, d).select("ip").distinct().select("ip", ipv4(F.col("ip")).alias("n"))


@query("path_flush", "WITH " + REQUESTS + " SELECT ip, method, path, count(*) AS hits, count(*) FILTER (blocked) AS blocked, max(ts) AS last_seen FROM q GROUP BY 1, 2, 3")
def path_flush(spark, d):
    """Counters by address, method and path after two flushes."""
    q = telemetry.usable(tables.requests(spark, d), CONFIG.path_bytes)
    return telemetry.add_paths(telemetry.path_flush(q.filter("event_id % 3 = 0")), telemetry.path_flush(q.filter("event_id % 3 <> 0")))
