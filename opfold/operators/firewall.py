"""Allow and deny rules over addresses and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opfold.functions.network import address_class, bits, bound, cidr6, cidr_high, cidr_low, ipv4, ipv6, loopback, shared_bits

#: Rules and ranges up to this many rows go along with the requests. Of more rules, those of the kinds with the fewest do and the rest are shuffled; more ranges are joined by prefix buckets.
SMALL = 10_000


def bounds(lo, hi, six):
    """A rule's bounds; ``six`` is an address or a pair of digits."""
    lo6, hi6 = six if isinstance(six, tuple) else (six, six)
    return F.struct(lo.alias("lo"), hi.alias("hi"), lo6.alias("lo6"), hi6.alias("hi6"))


def judge_rules(rules: DataFrame, has_geo: bool, has_regions: bool) -> DataFrame:
    """The active rules with parsed bounds and the reason why a rule is left out (null: it counts).

    Bounds are numbers (lo, hi) for IPv4 and digits (lo6, hi6) for IPv6; a rule
    of one family matches no address of the other.
    """
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    kind = F.col("match_type")
    parsed = rules.filter("active").withColumn("value", F.when(kind.isin("country", "region"), F.upper(value)).otherwise(value))
    # exploded, not selected: the optimizer leaves it as one step instead of copying the parser into every later use
    text = F.col("value")
    one = F.array(F.when(kind == "ip", bounds(ipv4(text), ipv4(text), ipv6(text))).when(kind == "cidr", bounds(cidr_low(text), cidr_high(text), cidr6(text))).otherwise(bounds(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"))))
    parsed = parsed.withColumn("__b", F.explode(one))
    lo, hi, lo6, hi6 = (F.col(f"__b.{c}") for c in ("lo", "hi", "lo6", "hi6"))
    reason = (
        F.when((kind == "ip") & lo.isNull() & lo6.isNull(), "bad ip")
        .when((kind == "cidr") & lo.isNull() & lo6.isNull(), "bad cidr")
        .when(kind.isin("country", "region") & ~F.lit(has_geo), "no geo data")
        .when((kind == "region") & ~F.lit(has_regions), "no region data")
        .when(~kind.isin("ip", "cidr", "country", "region"), "unknown match type")
    )
    return parsed.withColumns({"lo": lo, "hi": hi, "lo6": lo6, "hi6": hi6, "reason": reason}).drop("__b")


def compiled(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNull()).select("action", "scope", "match_type", "value", "lo", "hi", "lo6", "hi6")


def warnings(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("rules"))


def locate(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Addresses (column ip) with the smallest range that holds each.

    ranges: lo, hi (numbers, IPv4) and, where there are any of IPv6, lo6, hi6
    (digits). A table of at most ``SMALL`` ranges is broadcast and compared
    directly; a larger one is joined on the first 16 bits. Each distinct
    address is looked up once.
    """
    fields = ("country", "region", "city", "lat", "lon")
    both = "lo6" in ranges.columns
    r = ranges if both else ranges.withColumns({"lo6": F.lit(None).cast("string"), "hi6": F.lit(None).cast("string")})
    n = addresses.select("ip").distinct().withColumns({"__n": ipv4(F.col("ip")), "__h": ipv6(F.col("ip")) if both else F.lit(None).cast("string")})
    inside = F.col("__n").between(F.col("lo"), F.col("hi")) | F.col("__h").between(F.col("lo6"), F.col("hi6"))
    if ranges.limit(SMALL + 1).count() <= SMALL:
        hit = n.join(F.broadcast(r), inside)
    else:

        def top(digits):
            return F.conv(F.substring(digits, 1, 4), 16, 10).cast("long") + F.lit(1 << 16)  # beyond those of IPv4

        cut = r.withColumn("__b", F.explode(F.when(F.col("lo").isNotNull(), F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).otherwise(F.sequence(top(F.col("lo6")), top(F.col("hi6"))))))
        hit = n.withColumn("__b", F.coalesce(F.shiftright("__n", 16), top(F.col("__h")))).join(cut, "__b").filter(inside)

    def part(digits, first):
        return F.conv(F.substring(digits, first, 16), 16, 10).cast("decimal(20,0)")

    width = F.struct((F.col("hi") - F.col("lo")).alias("w"), (part(F.col("hi6"), 1) - part(F.col("lo6"), 1)).alias("w1"), (part(F.col("hi6"), 17) - part(F.col("lo6"), 17)).alias("w2"), "lo", "lo6")
    best = hit.groupBy("ip").agg(F.min_by(F.struct(*fields), width).alias("g"))
    return addresses.join(best, "ip", "left").select(*addresses.columns, *(F.col(f"g.{f}").alias(f) for f in fields))


def by_place(rules: DataFrame) -> DataFrame:
    """Rules by what they are looked up by, repeated ones once.

    r_kind is ``4/8`` for the first 8 bits of IPv4 addresses, ``6/48``, ``country``
    or ``region``; r_place those bits, which all addresses from r_low to r_high
    share, or the name.
    """
    kind, value = F.col("match_type"), F.col("value")

    def held(family, low, high):
        return F.struct(family.alias("family"), low.alias("low"), high.alias("high"))

    # bounds first, each once: what is made of them stays out of the expressions that parse a rule
    networks = [F.when(kind.isin("ip", "cidr"), held(F.lit("4"), F.hex("lo"), F.hex("hi"))), F.when(kind.isin("ip", "cidr"), held(F.lit("6"), F.col("lo6"), F.col("hi6")))]
    found = F.explode(F.array(*networks, F.when(kind.isin("country", "region"), held(kind, value, value))))
    bounds = rules.select(F.col("scope").alias("r_scope"), "action", found.alias("b")).select("r_scope", "action", "b.*").filter("low IS NOT NULL AND high IS NOT NULL")
    binary = bounds.withColumns({c: F.when(F.col("family") == "4", bits(F.col(c), 32)).when(F.col("family") == "6", bits(F.col(c), 128)).otherwise(F.col(c)) for c in ("low", "high")})
    width = F.when(F.col("family").isin("4", "6"), shared_bits(F.col("low"), F.col("high")))
    each = binary.withColumn("width", width).select(
        "r_scope", "action", F.concat_ws("/", "family", F.col("width").cast("string")).alias("r_kind"), F.when(F.col("width").isNotNull(), F.substr("low", F.lit(1), F.col("width"))).otherwise(F.col("low")).alias("r_place"), F.col("low").alias("r_low"), F.col("high").alias("r_high")
    )
    return each.groupBy("r_scope", "r_kind", "r_place", "r_low", "r_high").agg(F.bool_or(F.col("action") == "deny").alias("r_deny"), F.bool_or(F.col("action") == "allow").alias("r_allow"))


def places(kinds: list[str]):
    """Where rules of these kinds that match an address (its bits in __4 or __6), country or region are found."""

    def row(kind, place, at):
        return F.struct(kind.alias("kind"), place.alias("place"), at.alias("at"))

    def first(family: str, at, widths: list[int]):
        return F.transform(F.array(*map(F.lit, widths)), lambda w: row(F.concat(F.lit(f"{family}/"), w.cast("string")), F.substr(at, F.lit(1), w), at))

    widths = {family: sorted(int(k[2:]) for k in kinds if k.startswith(f"{family}/")) for family in ("4", "6")}
    found = [first(family, F.col(f"__{family}"), own) for family, own in widths.items() if own]
    found += [F.array(row(F.lit(name), F.upper(name), F.upper(name))) for name in ("country", "region") if name in kinds]
    nothing = F.array(row(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return F.filter(F.concat(*found, nothing), lambda x: x["place"].isNotNull())


def decide(requests: DataFrame, rules: DataFrame, exempt_superusers: bool = True) -> DataFrame:
    """allowed and why, of each request (ip, scope, superuser, country, region).

    Loopback passes, then superusers of the application if they are exempt; then
    a matching deny rule blocks; a scope with allow rules blocks what none of
    them matches. Addresses meet rules by equality on their first bits, once for
    every length that the rules have (162 at most), never all rules.
    """
    of = ("ip", "scope", "country", "region")
    keys = requests.select(*of).distinct().withColumns({"__4": bound(F.hex(ipv4(F.col("ip"))), lambda n: bits(n, 32)), "__6": bound(ipv6(F.col("ip")), lambda h: bits(h, 128))})
    r = by_place(rules)
    few, rest, total = [], [], 0
    for kind, n in r.groupBy("r_kind").count().sort("count", "r_kind").collect():
        total += n
        (few if total <= SMALL else rest).append(kind)

    def met(kinds: list[str], how: str, hint=lambda x: x) -> DataFrame:
        sought = keys.select(*of, F.explode_outer(places(kinds)).alias("p")).select(*of, "p.*")
        same = (F.col("scope") == F.col("r_scope")) & (F.col("kind") == F.col("r_kind")) & (F.col("place") == F.col("r_place"))
        held = F.col("at").between(F.col("r_low"), F.col("r_high"))  # bounds that are no network share their first bits with more than they hold
        return sought.join(hint(r.filter(F.col("r_kind").isin(kinds))), same, how).select(*of, (held & F.col("r_deny")).alias("deny"), (held & F.col("r_allow")).alias("allow"))

    hits = met(few, "left", F.broadcast)
    if rest:
        hits = hits.unionByName(met(rest, "inner"))
    verdict = hits.groupBy(*of).agg(F.coalesce(F.bool_or("deny"), F.lit(False)).alias("denied"), F.coalesce(F.bool_or("allow"), F.lit(False)).alias("listed")).withColumn("__self", loopback(F.col("ip")))
    white = rules.groupBy("scope").agg(F.bool_or(F.col("action") == "allow").alias("__white"))
    judged = verdict.join(F.broadcast(white), "scope", "left")
    out = requests.alias("q").join(judged.alias("v"), F.col("q.ip").eqNullSafe(F.col("v.ip")) & (F.col("q.scope") == F.col("v.scope")) & F.col("q.country").eqNullSafe(F.col("v.country")) & F.col("q.region").eqNullSafe(F.col("v.region")), "left")
    why = (
        F.when(F.col("v.__self"), "loopback")
        .when(F.lit(exempt_superusers) & F.col("q.superuser") & (F.col("q.scope") == "app"), "superuser")
        .when(F.col("v.denied"), "denied")
        .when(F.coalesce(F.col("v.__white"), F.lit(False)) & ~F.col("v.listed"), "not listed")
        .otherwise("open")
    )
    return out.select("q.*", why.alias("why"), (~why.isin("denied", "not listed")).alias("allowed"))


def summary(judged: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: rules that count, those that don't, scopes in whitelist mode, requests blocked."""
    a = judged.agg(F.count_if(F.col("reason").isNull()).alias("rules"), F.count_if(F.col("reason").isNotNull()).alias("skipped"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("reason").isNull() & (F.col("action") == "allow"), F.col("scope")))), ",").alias("whitelist_scopes"))
    return a.crossJoin(decisions.agg(F.count_if(~F.col("allowed")).alias("blocked"), F.count("*").alias("requests")))  # two single rows


def blocked_places(rules: DataFrame) -> DataFrame:
    """Countries and regions with a deny rule."""
    return rules.filter((F.col("action") == "deny") & F.col("match_type").isin("country", "region")).select(F.col("match_type").alias("kind"), F.col("value").alias("place")).distinct()


def scope_of(path):
    return F.when(path.startswith("/api/replication/"), "replication").otherwise("app")


def enrich(clients: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clients (ip) with geo_status: private stays, found becomes ok, the rest failed; each address is looked up once."""
    own = locate(clients.withColumn("geo_status", address_class(F.col("ip"))), ranges)
    public = F.col("geo_status") == ""
    status = F.when(~public, "private").when(F.col("country").isNotNull(), "ok").otherwise("failed")
    return own.withColumns({c: F.when(public, F.col(c)) for c in ("country", "region", "city", "lat", "lon")} | {"geo_status": status})
