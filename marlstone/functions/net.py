"""Internet address functions: IPv4 by column arithmetic, both families by an Arrow UDF."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,2}))?$"


def _part(a: Column, i: int) -> Column:
    return F.regexp_extract(a, _QUAD, i).try_cast("long")


def inet_to_int(a: Column) -> Column:
    """Number of an IPv4 address; null for anything else."""
    p = [_part(a, i) for i in range(1, 5)]
    value = p[0] * 2**24 + p[1] * 2**16 + p[2] * 2**8 + p[3]
    return F.when(F.greatest(*p) <= 255, value)


def int_to_inet(n: Column) -> Column:
    n = n.cast("long")
    parts = [F.pmod(F.floor(n / 2**s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.when((n >= 0) & (n < 2**32), F.concat_ws(".", *parts))


def mask_length(a: Column) -> Column:
    """Bits of the network; by class where the address has none."""
    first = _part(a, 1)
    by_class = F.when(first < 128, 8).when(first < 192, 16).when(first < 224, 24).otherwise(32)
    return F.when(inet_to_int(a).isNotNull(), F.coalesce(_part(a, 5).cast("int"), by_class))


def _host_size(a: Column) -> Column:
    return F.pow(F.lit(2), 32 - mask_length(a)).cast("long")


def network(a: Column) -> Column:
    return int_to_inet(inet_to_int(a) - F.pmod(inet_to_int(a), _host_size(a)))


def host(a: Column) -> Column:
    return int_to_inet(F.pmod(inet_to_int(a), _host_size(a)))


def broadcast(a: Column) -> Column:
    return int_to_inet(inet_to_int(a) - F.pmod(inet_to_int(a), _host_size(a)) + _host_size(a) - 1)


def netmask(a: Column) -> Column:
    return int_to_inet(F.lit(2**32) - _host_size(a))


def contains(a: Column, b: Column) -> Column:
    """1 if network a holds all of b."""
    inside = (mask_length(a) <= _width(b)) & (inet_to_int(a) - F.pmod(inet_to_int(a), _host_size(a)) == inet_to_int(b) - F.pmod(inet_to_int(b), _host_size(a)))
    return inside.cast("int")


def _width(b: Column) -> Column:
    return F.coalesce(_part(b, 5).cast("int"), F.lit(32))


def address_class(a: Column) -> Column:
    first = _part(a, 1)
    return F.when(inet_to_int(a).isNotNull(), F.when(first < 128, "A").when(first < 192, "B").when(first < 224, "C").when(first < 240, "D").otherwise("E"))


def canonical(a: Column) -> Column:
    """Full form with the mask length."""
    return F.concat(int_to_inet(inet_to_int(a)), F.lit("/"), mask_length(a).cast("string"))


def abbreviated(a: Column) -> Column:
    """Shortest form: the mask length only where it isn't that of a host."""
    return F.when(_width(a) == 32, int_to_inet(inet_to_int(a))).otherwise(canonical(a))


def address_family(a: Column) -> Column:
    """4, 6 or null."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> int | None:
            try:
                return ipaddress.ip_interface(x).version
            except (ValueError, TypeError, AttributeError):
                return None

        return pd.Series([one(x) for x in s], dtype="Int32")

    return run(a)


def _converted(version: int):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                ip = ipaddress.ip_address(x)
            except (ValueError, TypeError, AttributeError):
                return None
            if version == 6:
                return str(ip if ip.version == 6 else ipaddress.IPv6Address(f"::ffff:{ip}"))
            mapped = ip if ip.version == 4 else ip.ipv4_mapped
            return str(mapped) if mapped else None

        return pd.Series([one(x) for x in s], dtype=object)

    return run


def to_ipv4(a: Column) -> Column:
    return _converted(4)(a)


def to_ipv6(a: Column) -> Column:
    return _converted(6)(a)
