"""IPv4 and IPv6 addresses in built-in expressions: a number, or 32 hexadecimal digits, which sort as addresses do."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4(ip: Column) -> Column:
    """The address as a number, null if it isn't one."""
    plain = F.regexp_replace(ip, "^::ffff:", "")
    return F.when(plain.rlike(IPV4), F.aggregate(F.split(plain, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long")))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cidr_low(cidr: Column) -> Column:
    """The first address of an IPv4 network, null if malformed."""
    bits = cidr_bits(cidr)
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    at = ipv4(F.substring_index(cidr, "/", 1))
    return at - at % size


def cidr_bits(cidr: Column) -> Column:
    text = F.regexp_extract(cidr, r"^[^/]+/(\d{1,2})$", 1)
    bits = F.when(text != "", text.cast("int"))
    return F.when(bits.between(0, 32), bits)


def cidr_high(cidr: Column) -> Column:
    return cidr_low(cidr) + F.pow(F.lit(2.0), 32 - cidr_bits(cidr)).cast("long") - 1


def _between(n: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr)
    return n.between(int(net.network_address), int(net.broadcast_address))


def is_local(n: Column) -> Column:
    """Loopback, private, link-local or unspecified IPv4."""
    kinds = [_between(n, c) for c in ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")]
    out = n == 0
    for k in kinds:
        out = out | k
    return out


def is_loopback(n: Column) -> Column:
    return _between(n, "127.0.0.0/8")


#: Groups of an IPv6 address around at most one ``::``.
_GROUPS = r"([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?"
IPV6 = rf"^{_GROUPS}(::{_GROUPS})?$"
MAPPED = "0" * 20 + "ffff"


def ipv6(ip: Column) -> Column:
    """The address as 32 hexadecimal digits; null if it isn't one or stands for an IPv4 address."""
    tail = F.regexp_extract(ip, r"^.*:(\d+\.\d+\.\d+\.\d+)$", 1)
    low = ipv4(tail)
    head = F.substr(ip, F.lit(1), F.length(ip) - F.length(tail))
    # an IPv4 tail is the last two groups; a malformed one leaves a group that no address has
    plain = F.lower(F.when(tail == "", ip).when(low.isNull(), "-").otherwise(F.concat(head, F.hex(F.shiftright(low, 16)), F.lit(":"), F.hex(low % 65536))))

    def digits(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        left, right = (F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "") for k in (1, 2))
        n, gap = F.size(left) + F.size(right), F.size(halves) == 2
        wide = [F.array_join(F.transform(half, lambda g: F.lpad(g, 4, "0")), "") for half in (left, right)]
        whole = F.when(text.contains(":") & text.rlike(IPV6) & ((gap & (n <= 7)) | (~gap & (n == 8))), F.concat(wide[0], F.repeat(F.lit("0"), 32 - 4 * n), wide[1]))
        return bound(whole, lambda h: F.when(~h.startswith(MAPPED), h))

    return bound(plain, digits)


def bits(digits: Column, size: int) -> Column:
    """Hexadecimal digits as so many binary ones, which sort as addresses do."""
    if size <= 64:
        return F.lpad(F.conv(digits, 16, 2), size, "0")
    return F.concat(*(F.lpad(F.conv(F.substring(digits, k // 4 + 1, 16), 16, 2), 64, "0") for k in range(0, size, 64)))


def shared_bits(low: Column, high: Column) -> Column:
    """How many digits two strings of bits have in common at their beginning."""
    return F.length(F.regexp_extract(F.concat(low, F.lit(","), high), r"^([01]*)[01]*,\1", 1))


def cidr6(cidr: Column) -> tuple[Column, Column]:
    """The first and the last address of an IPv6 network as digits, null if malformed."""
    text = F.regexp_extract(cidr, r"^[^/]+/(\d{1,3})$", 1)
    bits = F.when((text != "") & (F.length(text) < 4), text.try_cast("int"))
    bits = F.when(bits.between(0, 128), bits)

    def ends(at: Column, bits: Column) -> Column:
        whole, rest = F.floor(bits / 4).cast("int"), bits % 4
        kept = F.substr(at, F.lit(1), whole)
        step = F.pow(F.lit(2.0), 4 - rest).cast("int")
        digit = F.conv(F.substr(at, whole + 1, F.lit(1)), 16, 10).cast("int")
        first = F.when(rest > 0, F.lower(F.hex((digit - digit % step).cast("long")))).otherwise("")
        last = F.when(rest > 0, F.lower(F.hex((digit - digit % step + step - 1).cast("long")))).otherwise("")
        return F.struct(F.rpad(F.concat(kept, first), 32, "0").alias("first"), F.rpad(F.concat(kept, last), 32, "f").alias("last"))

    parts = F.struct(ipv6(F.substring_index(cidr, "/", 1)).alias("at"), bits.alias("bits"))
    both = bound(parts, lambda p: ends(p["at"], p["bits"]))
    return both["first"], both["last"]


def local6(digits: Column) -> Column:
    """Loopback, unique local, link-local or unspecified IPv6."""
    return digits.isin("0" * 32, "0" * 31 + "1") | digits.rlike("^f[cd]") | digits.rlike("^fe[89ab]")


def address_class(ip: Column) -> Column:
    """``private`` for unparsable or local addresses, else empty (to be looked up)."""
    v4 = bound(ipv4(ip), lambda n: F.when(n.isNotNull(), F.when(is_local(n), "private").otherwise("")))
    v6 = bound(ipv6(ip), lambda h: F.when(h.isNull() | local6(h), "private").otherwise(""))
    return F.coalesce(v4, v6)


def loopback(ip: Column) -> Column:
    """Whether an address of either family is loopback; never null."""
    return F.coalesce(is_loopback(ipv4(ip)), F.lit(False)) | F.coalesce(ipv6(ip) == "0" * 31 + "1", F.lit(False))


def ipv4_class(ip: Column) -> Column:
    """The same for tables known to hold no IPv6; all in built-in expressions."""
    return bound(ipv4(ip), lambda n: F.when(n.isNull() | is_local(n), "private").otherwise(""))
