"""Which addresses may be fetched: none that lead to the machine itself, to private nets or to metadata services."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that are fetched; hosts, and endings of hosts, that are inside.
SCHEMES = ["http", "https"]
INSIDE = ["localhost", "metadata.google.internal", "metadata", "0.0.0.0"]
INSIDE_ENDINGS = [".localhost", ".local", ".internal"]
#: Hosts that may be an IP address in some writing: numbers with dots, hexadecimal or octal parts, one whole number, colons.
NUMERIC = r"^(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+)){0,3}$|:"


def address(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """An IP address in any writing that resolvers take: dotted, with fewer parts, octal or hexadecimal parts, IPv6."""
    if ":" in host:
        try:
            found = ipaddress.ip_address(host.split("%")[0])
        except ValueError:
            return None
        inner = found.ipv4_mapped or (ipaddress.IPv4Address(int(found) & 0xFFFFFFFF) if int(found) >> 32 == 0x64FF9B << 64 else None)
        return inner or found
    try:
        parts = [int(p, 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in host.split(".")]
    except ValueError:
        return None
    *heads, last = parts
    if any(p > 255 for p in heads) or last >= 256 ** (4 - len(heads)):
        return None
    return ipaddress.IPv4Address(sum(p << 8 * (3 - i) for i, p in enumerate(heads)) + last)


def _outside(hosts: pd.Series) -> pd.Series:
    """Per numeric host whether it is an address of the open net; what is no address at all isn't."""
    known = {h: (a := address(h)) is not None and a.is_global and not a.is_multicast for h in hosts.dropna().unique()}
    return hosts.map(known).fillna(False).astype(bool)


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased, without user, port, brackets and a last dot; null without one."""
    rest = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.lower(rest), "^.*@", ""), r"(?<=[^:\]]):[0-9]*$|(?<=\]):[0-9]*$", "")
    bare = F.when(F.startswith(plain, F.lit("[")), F.regexp_extract(plain, r"^\[([^\]]*)\]", 1)).when(F.size(F.split(plain, ":")) == 2, F.substring_index(plain, ":", 1)).otherwise(plain)
    return F.nullif(F.regexp_replace(bare, r"\.$", ""), F.lit(""))


def is_safe(url: Column) -> Column:
    """Whether an address may be fetched. Names are judged by columns; only hosts that may be IP addresses go through Arrow."""
    host, scheme = host_of(url), F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    numeric = host.rlike(NUMERIC)
    outside = F.pandas_udf(_outside, "boolean")(F.when(numeric, host))
    inside = host.isin(INSIDE) | F.exists(F.array(*map(F.lit, INSIDE_ENDINGS)), lambda x: F.endswith(host, x))
    # other names than numbers have a dot, and percent signs hide nothing
    name = ~inside & F.contains(host, F.lit(".")) & ~host.rlike(r"[%\s]")
    return F.coalesce(scheme.isin(SCHEMES) & F.when(numeric, outside).otherwise(name), F.lit(False))
