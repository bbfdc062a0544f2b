"""Addresses and error texts: IPv4 in SQL, IPv6 by Arrow functions over the rows that have it."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
V4_TEXT = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
CANONICAL_V4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"
HOST_MARK, ARG_MARK, ESC_MARK = "\x01", "\x02", "\x03"

# The address ranges that are not the public internet.
NOT_PUBLIC_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "255.255.255.255/32",
)
NOT_PUBLIC_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")
_V4 = [ipaddress.ip_network(n) for n in NOT_PUBLIC_V4]
_V6 = [ipaddress.ip_network(n) for n in NOT_PUBLIC_V6]


def is_public_v4(ip) -> Column:
    """Whether a dotted IPv4 text is on the public internet; false for anything else."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    part = F.split(ip, "[.]")
    n = sum((F.try_element_at(part, F.lit(i + 1)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    inside = [n.between(int(x.network_address), int(x.broadcast_address)) for x in _V4]
    reserved = inside[0]
    for x in inside[1:]:
        reserved = reserved | x
    return F.coalesce(ip.rlike(V4), F.lit(False)) & ~F.coalesce(reserved, F.lit(True))


def public_v6(text: str) -> bool:
    """The rule for IPv6 texts: mapped, NAT64, 6to4 and compatible forms by their IPv4."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    if isinstance(a, ipaddress.IPv6Address):
        if a.ipv4_mapped:
            a = a.ipv4_mapped
        elif any(a in n for n in _V6):
            return False
        elif a in ipaddress.ip_network("64:ff9b::/96") or a in ipaddress.ip_network("::/96"):
            a = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)
        elif a in ipaddress.ip_network("2002::/16"):
            a = ipaddress.IPv4Address(int(a) >> 80 & 0xFFFFFFFF)
        else:
            return True
    return not any(a in n for n in _V4)


@F.pandas_udf(T.BooleanType())
def is_public_v6(ip: pd.Series) -> pd.Series:
    return ip.map(lambda x: bool(x) and public_v6(x)).astype(bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def public_v6_of(ips: pd.Series) -> pd.Series:
    """The public ones of arrays of IPv6 texts."""
    return ips.map(lambda xs: None if xs is None else [x for x in xs if x and public_v6(x)])


def is_public_address(ip) -> Column:
    """IPv4 texts in SQL; texts with a colon by the Arrow function."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    return F.when(ip.contains(":"), is_public_v6(ip)).otherwise(is_public_v4(ip))


def _escaped(msg: Column) -> Column:
    return F.regexp_replace(msg, "([\x01\x02\x03])", "\x03$1")


def error_shape_v4(host, msg) -> Column:
    """``struct<shape, args>``: host and canonical IPv4 addresses lifted out of an error."""
    host, msg = (F.col(c) if isinstance(c, str) else c for c in (host, msg))
    masked = F.when(host == "", _escaped(msg)).otherwise(F.replace(_escaped(msg), host, F.lit(HOST_MARK)))
    return F.struct(F.regexp_replace(masked, CANONICAL_V4, ARG_MARK).alias("shape"), F.regexp_extract_all(masked, F.lit(f"({CANONICAL_V4})"), 1).alias("args"))


_CANDIDATE = re.compile(r"\[[0-9A-Fa-f:.]+\]|" + V4_TEXT, re.ASCII)


def shaped(host: str, msg: str) -> dict:
    """The whole rule, IPv6 included: an address moves only if it renders back as written."""
    msg = re.sub("([\x01\x02\x03])", "\x03\\1", msg)
    if host:
        msg = msg.replace(host, HOST_MARK)
    args: list[str] = []

    def lift(m: re.Match) -> str:
        text = m[0].strip("[]")
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return m[0]
        if str(a) != text or (a.version == 6 and a.ipv4_mapped):
            return m[0]
        args.append(text)
        return f"[{ARG_MARK}]" if m[0][0] == "[" else ARG_MARK

    return {"shape": _CANDIDATE.sub(lift, msg), "args": args}


@F.pandas_udf(T.StructType([T.StructField("shape", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))]))
def _error_shape_any(host: pd.Series, msg: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shaped(h or "", m or "") for h, m in zip(host, msg)], columns=["shape", "args"])


def error_shape(host, msg) -> Column:
    """As ``error_shape_v4``; messages with a bracketed address go through the Arrow function."""
    host, msg = (F.col(c) if isinstance(c, str) else c for c in (host, msg))
    return F.when(msg.rlike(r"\[[0-9A-Fa-f:.]+\]"), _error_shape_any(host, msg)).otherwise(error_shape_v4(host, msg))


def rendered(host: str, shape: str, args: list[str]) -> str:
    out, left, escaped = [], list(args), False
    for c in shape:
        if escaped:
            out.append(c)
            escaped = False
        elif c == ESC_MARK:
            escaped = True
        elif c == HOST_MARK:
            out.append(host)
        elif c == ARG_MARK:
            out.append(left.pop(0) if left else "?")
        else:
            out.append(c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def render_error(host: pd.Series, shape: pd.Series, args: pd.Series) -> pd.Series:
    """The inverse of ``error_shape``; a missing argument is ``?``."""
    return pd.Series([rendered(h or "", s or "", a if a is not None else []) for h, s, a in zip(host, shape, args)], dtype=object)
