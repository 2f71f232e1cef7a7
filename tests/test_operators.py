"""The semantic traps, on small tables written by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from opfold.functions import clock, network
from opfold.functions.lww import supersedes
from opfold.operators import compaction, firewall, fold, integrity, log, membership, migrations, snapshot, telemetry, timeline
from opfold.schemas import Config
from opfold.sources import tables
from opfold.streaming import ingest

OPS = "src_node string, src_seq long, hlc string, op_type string, col_id string, record_id string, payload string, created string, event_id long"


def ops(spark, rows):
    return spark.createDataFrame(rows, OPS).withColumn("created", F.col("created").cast("timestamp_ntz"))


def hlc(ms, c=0):
    return f"{ms:016x}-{c:04x}"


def test_clock_ticks_carries_and_observes():
    wall = [1000]
    c = clock.Clock(lambda: wall[0])
    assert c.now() == hlc(1000) and c.now() == hlc(1000, 1)
    c.observe(hlc(5000, 0xFFFF))
    assert c.current() == hlc(5000, 0xFFFF) and c.now() == hlc(5001, 0)
    c.observe("nonsense")
    c.observe(hlc(1))
    assert c.current() == hlc(5001, 0)
    assert clock.Clock(lambda: 0, hlc(77, 3)).now() == hlc(77, 4)


def test_supersedes_is_strict(spark):
    df = spark.createDataFrame([("b", "n", "a", "z"), ("a", "z", "a", "n"), ("a", "n", "a", "n"), ("a", "a", "a", "n"), ("a", "a", None, None)], "h string, n string, oh string, o string")
    got = [r[0] for r in df.select(supersedes(F.col("h"), F.col("n"), F.col("oh"), F.col("o"))).collect()]
    assert got == [True, True, False, False, True]


def test_fold_does_not_depend_on_order_or_repetition(spark, sf_dir):
    whole = {tuple(r) for r in fold.winners(tables.oplog(spark, sf_dir)).collect()}
    rows = [tuple(r) for r in tables.oplog(spark, sf_dir).collect()]
    rows += rows[::7]
    random.Random(5).shuffle(rows)
    again = spark.createDataFrame(rows, tables.oplog(spark, sf_dir).schema).repartition(7)
    assert {tuple(r) for r in fold.winners(again).collect()} == whole


def test_applied_counts_winners_on_arrival(spark):
    rows = [("a", 1, hlc(2), "upsert", "c", "r", "{}", "2024-01-01 00:00:01", 1), ("b", 1, hlc(1), "upsert", "c", "r", "{}", "2024-01-01 00:00:02", 2), ("b", 2, hlc(3), "delete", "c", "r", "", "2024-01-01 00:00:03", 3)]
    assert [tuple(r) for r in fold.applied(ops(spark, rows)).collect()] == [("c", 2, 3)]


def test_admission_drops_echo_and_nonsense(spark):
    rows = [(n, s, hlc(1), "upsert", "c", "r", "{}", "2024-01-01 00:00:00", k) for k, (n, s) in enumerate([("", 1), ("a", 0), ("me", 1), ("a", 1), ("a", 1)])]
    assert log.append(ops(spark, []), ops(spark, rows), "me").count() == 1


def test_contiguous_stops_at_the_first_hole(spark):
    rows = [("b", s, hlc(s), "upsert", "c", "r", "{}", "2024-01-01 00:00:00", s) for s in [*range(1, 2501), 2502]]
    nothing = spark.createDataFrame([], "src_node string, seq long")
    for block in (100, 250, 2500, 2501, 2502, 1 << 16):
        assert [tuple(r) for r in log.contiguous(ops(spark, rows), nothing, block).collect()] == [("b", 2500, 2502)]
    assert [tuple(r) for r in log.contiguous(ops(spark, rows[:200]), nothing, 100).collect()] == [("b", 200, 200)]
    assert [tuple(r) for r in log.contiguous(ops(spark, rows[150:]), nothing, 100).collect()] == [("b", 0, 2502)]


@pytest.mark.parametrize(("vector", "horizon", "limit", "page", "needed"), [({}, {}, 10, 6, False), ({"a": 6}, {}, 10, 0, False), ({"a": 2}, {"a": 3}, 10, 0, True), ({"a": 3}, {"a": 3}, 10, 3, False), ({"a": 0}, {"z": 3}, 6, 6, False), ({"a": 0}, {"z": 3}, 7, 6, True)])
def test_pull_page(spark, vector, horizon, limit, page, needed):
    rows = ops(spark, [("a", s, hlc(s), "upsert", "c", "r", "{}", "2024-01-01 00:00:00", s) for s in range(1, 7)])
    v = spark.createDataFrame(list(vector.items()), "src_node string, seq long")
    h = spark.createDataFrame(list(horizon.items()), "src_node string, min_seq long")
    got, flag = log.page_after_vector(rows, v, h, limit)
    assert got.count() == page and flag.first()[0] == needed


def test_overwritten_deletion_raises_no_horizon(spark):
    old, new = "2024-01-01 00:00:00", "2024-01-30 00:00:00"
    rows = [("a", 1, hlc(1), "delete", "c", "r", "", old, 1), ("a", 2, hlc(2), "upsert", "c", "r", "{}", new, 2), ("b", 1, hlc(1), "delete", "c", "q", "", old, 3), ("b", 2, hlc(9), "col_upsert", "c", "q", "{}", new, 4)]
    kept, horizon = compaction.compact(ops(spark, rows), spark.createDataFrame([("b", 0)], "src_node string, min_seq long"), "2024-01-31 00:00:00", "2024-01-15 00:00:00")
    assert {(r.src_node, r.src_seq) for r in kept.collect()} == {("a", 2), ("b", 2)}
    assert {tuple(r) for r in horizon.collect()} == {("b", 1)}


def test_reconcile_keeps_what_is_as_new_as_the_horizon(spark):
    local = spark.createDataFrame([("aaa",), ("bbb",), ("ccc",), ("ddd",)], "record_id string")
    seen = spark.createDataFrame([("bbb",), (None,)], "record_id string")
    versions = spark.createDataFrame([("aaa", hlc(1000)), ("ccc", hlc(2000))], "record_id string, hlc string")
    assert {r.record_id for r in snapshot.reconcile(local, seen, versions, hlc(2000)).collect()} == {"aaa", "ddd"}
    assert {r.record_id for r in snapshot.reconcile(local, seen, versions, "").collect()} == {"aaa", "ccc", "ddd"}


def test_member_merge_tie_and_self(spark):
    schema = "node_id string, url string, reachable boolean, joined_at string, last_seen string, removed boolean"
    have = spark.createDataFrame([("a", "u", True, "1", "5", False), ("b", "u", True, "1", "5", True), ("me", "u", True, "1", "5", False)], schema)
    told = spark.createDataFrame([("a", "v", True, "2", "5", True), ("b", "v", True, "2", "5", False), ("me", "v", True, "2", "9", True), ("n", "v", True, "2", "1", False)], schema)
    got = {r.node_id: (r.url, r.joined_at, r.removed) for r in membership.merge(have, told, "me").collect()}
    assert got == {"a": ("v", "1", True), "b": ("u", "1", True), "me": ("u", "1", False), "n": ("v", "2", False)}


def test_leader_is_self_even_if_removed(spark):
    rows = spark.createDataFrame([("b", "2024-02-01 00:00:00", False), ("me", "2020-01-01 00:00:00", True), ("a", "2024-01-31 23:59:30", False)], "node_id string, last_seen string, removed boolean").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
    assert membership.leader(rows, tables.NOW, "me", 10).first().leader == "b"
    assert membership.leader(rows.filter("node_id <> 'b'"), tables.NOW, "me", 10).first().leader == "me"


def test_deny_beats_allow_and_bad_rules_do_not_whitelist(spark):
    requests = spark.createDataFrame([("1.2.3.4", "app", False, None, None), ("9.9.9.9", "app", False, None, None), ("127.0.0.1", "app", False, None, None), ("9.9.9.9", "app", True, None, None), ("::1x", "app", False, None, None)], "ip string, scope string, superuser boolean, country string, region string")
    schema = "action string, scope string, match_type string, value string, active boolean"

    def run(rules):
        judged = firewall.judge_rules(spark.createDataFrame(rules, schema), False, False)
        return [r.allowed for r in firewall.decide(requests.coalesce(1), firewall.compiled(judged)).orderBy("ip", "superuser").collect()]

    assert run([("allow", "app", "ip", "bad", True)]) == [True] * 5
    assert run([("allow", "app", "cidr", "1.2.3.0/24", True)]) == [True, True, False, True, False]
    assert run([("allow", "app", "cidr", "1.2.3.0/24", True), ("deny", "app", "ip", "1.2.3.4", True), ("deny", "app", "country", "xx", True)]) == [False, True, False, True, False]


def test_large_range_table_gives_the_same_places(spark, monkeypatch):
    ips = spark.createDataFrame([("22.2.3.4",), ("22.9.0.1",), ("1.1.1.1",), ("x",)], "ip string")
    small = {tuple(r) for r in firewall.locate(ips, tables.geo_ranges(spark)).collect()}
    monkeypatch.setattr(firewall, "SMALL", 1)
    assert {tuple(r) for r in firewall.locate(ips, tables.geo_ranges(spark)).collect()} == small


def test_paths_are_cut_by_bytes(spark):
    got = telemetry.usable(spark.createDataFrame([("1", "abé"), ("1", ""), ("", "x"), ("1", "abcd")], "ip string, path string"), 3).collect()
    assert [r.path for r in got] == ["ab", "abc"]


def test_dangling_and_cap(spark):
    records = spark.createDataFrame([(1, "x", ["x", "", None, "ghost"]), (2, "ghost", [])], "id int, one string, many array<string>")
    refs = integrity.references(records, {"one": "t", "many": "t"})
    found = integrity.dangling(refs, spark.createDataFrame([("t", "x")], "target_col string, target_id string"))
    assert {(r.record_id, r.field) for r in found.collect()} == {("1", "many"), ("2", "one")}
    row = integrity.report(records, refs, found, 1).first()
    assert (row.scanned, row.dangling, row.listed, row.truncated_at, row.converged) == (2, 2, 1, 2, False)


def test_null_migrations_are_not_empty_ones(spark):
    assert tuple(migrations.reachable(tables.peer_migrations(spark)).first()) == (3, 4)


def test_throttle_mark_moves_only_on_acceptance(spark):
    rows = [("k", s, f"2024-01-01 00:00:{s:02d}") for s in (0, 6, 10, 12, 19, 20)]
    df = spark.createDataFrame(rows, "key string, seq int, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    assert sorted(r.seq for r in timeline.throttle(df, "key", 10).collect()) == [0, 10, 20]
    assert sorted(r.wakes for r in timeline.debounce(df, "key", 10).collect()) == [1, 2, 3]


def test_json_source_keeps_malformed_lines(spark, tmp_path):
    (tmp_path / "ops.json").write_text('{"src_node":"a","src_seq":1,"hlc":"x","files":{"f":["n"]}}\n{"src_node":\n')
    rows = tables.read_ops_json(spark, str(tmp_path)).cache()
    assert rows.filter("_corrupt is null").count() == 1 and rows.filter("_corrupt is not null").count() == 1


def test_replayed_batch_overwrites_its_own_version(spark, tmp_path):
    state = ingest.StateTable(spark, f"file://{tmp_path}/s", "k int")
    for _ in range(2):
        state.advance(0, lambda before: before.unionByName(spark.createDataFrame([(1,)], "k int")))
    assert state.at(0).count() == 1


def test_stream_sorts_no_whole_batch(spark, sf_dir, monkeypatch):
    """Batches of several bounded files, some operations delivered again: the state is the batch result."""
    from opfold.plans import stream_queries

    whole = tables.oplog(spark, sf_dir)
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    stream, path = stream_queries.replayed(spark, sf_dir, "test")
    files = spark.read.parquet(f"{path}/log").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 3 * -(-whole.count() // 300) and max(r["count"] for r in files) < 200
    again = spark.read.parquet(f"{path}/log").filter("event_id % 5 = 0").repartition(2)
    again.write.mode("append").parquet(f"{path}/log")
    state = ingest.StateTable(spark, f"{path}/state", "col_id string, record_id string, op_type string, payload string, hlc string, src_node string")
    last = ingest.ingest(stream, state, f"{path}/checkpoint")
    assert 3 <= last + 1 <= 4 and sorted(map(tuple, state.at(last).collect())) == sorted(map(tuple, fold.winners(whole).select(*state.at(last).columns).collect()))


def test_addresses_of_six(spark):
    import ipaddress

    texts = ["::", "::1", "1::", "2001:db8::5", "2001:DB8:0:0:0:0:0:5", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", ":1", "1:", ":::", "1::2::3", "12345::", "g::", "::1x", "1.2.3.4", "", "::1.2.3.400", "fc00::1", "1:2:3:4:5:6:7:1.2.3.4"]

    def want(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return None if a.version == 4 or a.ipv4_mapped else f"{int(a):032x}"

    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    assert {r.ip: r.h for r in df.select("ip", network.ipv6(F.col("ip")).alias("h")).collect()} == {t: want(t) for t in texts}
    nets = ["2001:db8::/32", "2001:db8::ff/121", "::/0", "1:2:3:4:5:6:7:8/128", "fe80::/10", "2001:db8::/129", "2001:db8::", "x/3", "2001:db8::/"]
    got = {r.n: (r.a, r.b) for r in spark.createDataFrame([(n,) for n in nets], "n string").select("n", *(c.alias(x) for c, x in zip(network.cidr6(F.col("n")), "ab", strict=True))).collect()}
    for n in nets[:5]:
        net = ipaddress.ip_network(n, strict=False)
        assert got[n] == (f"{int(net[0]):032x}", f"{int(net[-1]):032x}"), n
    assert all(got[n] == (None, None) for n in nets[5:])


def test_ranges_and_rules_of_both_families(spark, monkeypatch):
    ranges = spark.createDataFrame([(1 << 24, (2 << 24) - 1, None, None, "A"), (None, None, "2001" + "0" * 28, "2001" + "f" * 28, "B"), (None, None, "20010db8" + "0" * 24, "20010db8" + "f" * 24, "C")], "lo long, hi long, lo6 string, hi6 string, country string").selectExpr("*", "'' region", "'' city", "0d lat", "0d lon")
    ips = spark.createDataFrame([("1.2.3.4",), ("2001:db8::9",), ("2001:db9::9",), ("3000::",), ("::1",), ("no",)], "ip string")
    want = {"1.2.3.4": ("ok", "A"), "2001:db8::9": ("ok", "C"), "2001:db9::9": ("ok", "B"), "3000::": ("failed", None), "::1": ("private", None), "no": ("private", None)}
    for small in (10_000, 1):
        monkeypatch.setattr(firewall, "SMALL", small)
        assert {r.ip: (r.geo_status, r.country) for r in firewall.enrich(ips, ranges).collect()} == want
    requests = ips.selectExpr("ip", "'app' scope", "ip = '3000::' superuser", "cast(null as string) country", "cast(null as string) region")
    rules = firewall.compiled(firewall.judge_rules(spark.createDataFrame([("allow", "app", "cidr", "2001:db8::/32", True), ("deny", "app", "ip", "::1", True)], "action string, scope string, match_type string, value string, active boolean"), False, False))
    why = {r.ip: r.why for r in firewall.decide(requests, rules).collect()}
    assert why == {"1.2.3.4": "not listed", "2001:db8::9": "open", "2001:db9::9": "not listed", "3000::": "superuser", "::1": "loopback", "no": "not listed"}
    assert {r.why for r in firewall.decide(requests, rules, exempt_superusers=False).filter("superuser").collect()} == {"not listed"}


@pytest.mark.parametrize("small", [10_000, 20, 0])
def test_rules_meet_addresses_by_prefix(spark, monkeypatch, small):
    """Random rules of all lengths, some repeated, against the standard library; no nested loop, whatever goes along."""
    import ipaddress

    monkeypatch.setattr(firewall, "SMALL", small)
    rng = random.Random(7)

    def number(family, base, free):
        bits = 32 if family == 4 else 128
        return (base << (bits - 16)) + (rng.getrandbits(free) << rng.randrange(bits - 16 - free))

    def address(family):
        a = (ipaddress.IPv4Address if family == 4 else ipaddress.IPv6Address)(number(family, rng.choice([0x0A00, 0x1401] if family == 4 else [0x2001, 0x2002]), 4))
        return str(a)

    families = [rng.choice([4, 6]) for _ in range(400)]
    ips = sorted({address(f) for f in families} | {"255.255.255.255", "0.0.0.1", "ffff::", "nonsense"})
    rows = [(rng.choice(["deny", "allow"]), rng.choice(["app", "replication"]), "cidr", f"{address(f)}/{rng.randrange(10 if k % 9 else 0, 33 if f == 4 else 129)}", True) for k, f in enumerate(families[:150])]
    rows += [("deny", "app", "ip", address(f), True) for f in families[:20]] + rows[:9] + [("deny", "app", "country", " xx ", True)]
    requests = spark.createDataFrame([(ip, scope, False, c, None) for ip in ips for scope in ("app", "replication") for c in (None, "Xx")], "ip string, scope string, superuser boolean, country string, region string")
    found = firewall.decide(requests, firewall.compiled(firewall.judge_rules(spark.createDataFrame(rows, "action string, scope string, match_type string, value string, active boolean"), True, False)))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()

    def inside(ip, rule):
        try:
            a, net = ipaddress.ip_address(ip), ipaddress.ip_network(rule[3].strip(), strict=False)
        except ValueError:
            return False
        return a.version == net.version and a in net

    def want(ip, scope, country):
        hit = {r[0] for r in rows if r[1] == scope and (inside(ip, r) or (r[2] == "country" and country))}
        return "denied" if "deny" in hit else "open" if "allow" in hit else "not listed"

    got = {(r.ip, r.scope, r.country): r.why for r in found.collect()}
    assert got == {k: want(*k) for k in got} and len(got) == 4 * len(ips) and set(got.values()) == {"denied", "open", "not listed"}


def test_bounds_that_are_no_network(spark):
    """A range from .3 to .12 holds these ten addresses, not the sixteen that share its first bits."""
    rules = spark.createDataFrame([("deny", "app", "ip", "x", 3, 12, None, None), ("deny", "app", "ip", "y", None, None, f"{7:032x}", f"{9:032x}")], "action string, scope string, match_type string, value string, lo long, hi long, lo6 string, hi6 string")
    ips = [f"0.0.0.{k}" for k in range(20)] + [f"::{k:x}" for k in range(2, 20)]
    requests = spark.createDataFrame([(ip,) for ip in ips], "ip string").selectExpr("ip", "'app' scope", "false superuser", "cast(null as string) country", "cast(null as string) region")
    assert {r.ip for r in firewall.decide(requests, rules).filter("why = 'denied'").collect()} == {f"0.0.0.{k}" for k in range(3, 13)} | {"::7", "::8", "::9"}


def test_clock_carries_and_capture_goes_on(spark):
    """70 000 changes in one millisecond, then some in the next and one before the wall: values rise strictly."""
    changes = spark.range(70_010).selectExpr("id AS change_no", "if(id < 70000, 5, if(id < 70009, 6, 3)) AS ms", "false AS deleted", "'c' AS col_id", "cast(id AS string) AS record_id", "named_struct('x', id) AS fields")
    whole = [r.hlc for r in fold.capture(changes, "me", 100).orderBy("src_seq").collect()]
    assert whole[0] == f"{5:016x}-0000" and whole[65_536] == f"{6:016x}-0000" and all(a < b and len(b) == 21 for a, b in zip(whole, whole[1:], strict=False))
    parts = [(r.src_seq, r.hlc) for r in fold.capture(changes, "me", 100, block=1000).orderBy("src_seq").collect()]
    assert parts == list(enumerate(whole, 101))


def test_null_keys_and_repeated_gossip(spark):
    rows = [(None, 0, "2024-01-01 00:00:00"), (None, 1, "2024-01-01 00:00:03"), ("k", 2, "2024-01-01 00:00:04"), (None, 3, "2024-01-01 00:00:20")]
    df = spark.createDataFrame(rows, "key string, seq int, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    assert sorted((r.key or "", r.wakes) for r in timeline.debounce(df, "key", 10).collect()) == [("", 1), ("", 2), ("k", 1)]
    assert sorted(r.seq for r in timeline.throttle(df, "key", 10).collect()) == [0, 2, 3]
    assert timeline.debounce(df.limit(0), "key", 10).count() == 0
    schema = "node_id string, url string, reachable boolean, joined_at string, last_seen string, removed boolean"
    have = spark.createDataFrame([("a", "u", True, "1", "5", False)], schema)
    told = spark.createDataFrame([("a", "v", True, "2", "6", False), ("a", "w", True, "2", "7", False), ("a", "w", True, "2", "7", True), ("n", "x", True, "2", None, False), ("n", "y", True, "2", "1", False)], schema)
    for found in (membership.merge(have, told, "me"), membership.upsert(have, told)):
        assert sorted((r.node_id, r.url, r.removed) for r in found.collect()) == [("a", "w", True), ("n", "y", False)]


def test_reconcile_by_collection(spark):
    local = spark.createDataFrame([("a", "1"), ("b", "1")], "col_id string, record_id string")
    versions = spark.createDataFrame([("b", "1", hlc(3000)), ("b", "1", hlc(1000))], "col_id string, record_id string, hlc string")
    assert [(r.col_id, r.record_id) for r in snapshot.reconcile(local, local.limit(0), versions, hlc(2000)).collect()] == [("a", "1")]


def test_config():
    c = Config()
    assert c.page(None) == 500 and c.page(0) == 500 and c.page(9999) == 500 and c.page(3) == 3
    assert "_superusers" in c.excluded() and "_superusers" not in Config(replicate_superusers=True).excluded()
    with pytest.raises(ValueError):
        Config(max_batch=0)
    assert snapshot.copy_strategy(True, True, True) == "resync" and snapshot.copy_strategy(False, False, True) == "fresh" and snapshot.copy_strategy(True, False, True) == "none"


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_running_sums_by_block(spark):
    """Blocks of any size give what one window gives; a null group is a group, an empty table stays empty."""
    rows = [(s, k, k % 3) for s in ("a", None) for k in range(40)]
    df = spark.createDataFrame(rows, "s string, k long, v long")
    for size in (1, 7, 100):
        got = {(r.s, r.k): r.total for r in log.running(df, ["s"], F.expr(f"k div {size}"), ["k"], F.col("v"), "total").collect()}
        assert got == {(s, k): sum(i % 3 for i in range(k + 1)) for s, k, _ in rows}
    assert log.running(df.limit(0), ["s"], F.col("k"), ["k"], F.lit(1), "n").collect() == []


def test_pull_round(spark):
    """A short page adopts the peer's vector over a hole, a full one doesn't; a horizon beyond the vector leaves all as it was."""
    schema = "src_node string, src_seq long, created timestamp_ntz, event_id long"
    at = datetime.datetime(2024, 1, 1)
    ops = spark.createDataFrame([("a", n, at, n) for n in (1, 2, 4)], schema)
    none, vector = spark.createDataFrame([], "src_node string, min_seq long"), spark.createDataFrame([("a", 0)], "src_node string, seq long")
    told = spark.createDataFrame([("a", 4), ("me", 9)], "src_node string, seq long")

    def after(limit, horizon=none):
        found, moved, needed = log.pull_round(ops.limit(0), vector, ops, told, horizon, limit, "me")
        return sorted(r.src_seq for r in found.collect()), {r.src_node: r.seq for r in moved.collect()}, needed.first()[0]

    assert after(10) == ([1, 2, 4], {"a": 4}, False)
    assert after(3) == ([1, 2, 4], {"a": 2}, False)
    assert after(10, spark.createDataFrame([("a", 3)], "src_node string, min_seq long")) == ([], {"a": 0}, True)


def test_schema_changed_back(spark):
    """A schema that was changed and changed back counts as a change, white space doesn't, an older operation is none; a deletion is a change."""
    schema = "op_type string, col_id string, col_name string, record_id string, payload string, hlc string, src_node string, created timestamp_ntz, event_id long"
    text = ['{"v":1}', ' {"v":1}\n', '{"v":2}', '{"v":1}', '{"v":3}', "", '{"v":1}']
    rows = [("col_delete" if not t else "col_upsert", "c", None, "c", t, f"{h:04d}", "n", datetime.datetime(2024, 1, 1), k) for k, (t, h) in enumerate(zip(text, (1, 2, 3, 4, 1, 6, 7), strict=True))]
    catalog = spark.createDataFrame([("c", "posts", '{"v": 1}')], "id string, name string, content string")
    versions = spark.createDataFrame([("c", "0000", "n")], "record_id string, hlc string, src_node string")
    got = fold.schema_effects(spark.createDataFrame(rows, schema), catalog, versions).orderBy("event_id").collect()
    assert [r.effect for r in got] == ["version", "version", "change", "change", "none", "change", "change"]
    assert fold.schema_effects(spark.createDataFrame(rows, schema).limit(0), catalog, versions).count() == 0


def test_purge_after_a_copy(spark):
    rows = spark.range(3)
    left = snapshot.purge_copied({"clients": rows, "sync_seen": rows, "_logs": rows, "posts": rows}, ("_logs",))
    assert {k: v.count() for k, v in left.items()} == {"clients": 0, "sync_seen": 0, "_logs": 0, "posts": 3} and left["_logs"].columns == ["id"]


def test_error_of_another_peer_stays(spark):
    """A success takes back only its own peer's error; what that one had replaced doesn't come again."""
    rows = [("n", "a", 1, "x"), ("n", "b", 2, "y"), ("n", "a", 3, None), ("m", "a", 1, "x"), ("m", "b", 2, "y"), ("m", "b", 3, None), ("k", "a", 1, None)]
    got = membership.global_error(spark.createDataFrame(rows, "node string, peer string, t long, error string"))
    assert {r.node: r.error for r in got.collect()} == {"n": "y", "m": "", "k": ""}


def test_contiguous_over_the_edges_of_bitmaps(spark):
    """Holes at and beside the edge of a bitmap and of a byte, whole bitmaps that are missing, repeated numbers, a start."""
    edge = log.BITS
    held = {"full": range(1, edge + 1), "two": range(1, 2 * edge + 10), "byte": [i for i in range(1, 60) if i != 9], "bit": [i for i in range(1, 60) if i != 8], "missing": [*range(1, edge + 1), 2 * edge + 5], "last": [i for i in range(1, edge + 3) if i != edge], "twice": [1, 1, 2, 2, 3], "start": range(1, 20)}
    rows = spark.createDataFrame([(k, list(v)) for k, v in held.items()], "src_node string, n array<long>").select("src_node", F.explode("n").alias("src_seq"))
    vector = {"start": 7, "only": 3}
    got = {r.src_node: (r.seq, r.top) for r in log.contiguous(rows, spark.createDataFrame(list(vector.items()), "src_node string, seq long")).collect()}
    for k in (*held, "only"):
        seen, end = set(held.get(k, ())), vector.get(k, 0)
        top = max([*seen, end])
        while end + 1 in seen:
            end += 1
        assert got[k] == (end, top), k
