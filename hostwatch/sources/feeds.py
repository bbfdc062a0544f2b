"""Feed messages and log entries to ``certs``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.functions.names import from_unix_float

MESSAGE = (
    "message_type string, data struct<leaf_cert:struct<subject:struct<CN:string>,issuer:struct<CN:string,O:string>,not_before:double,not_after:double,all_domains:array<string>>,"
    "source:struct<name:string>,seen:double>"
)
CERT = "source string, idx long, cn string, sans array<string>, issuer string, not_before timestamp, not_after timestamp"


def read_feed_json(messages: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """Messages (column ``value``) to certs.  Malformed ones, other kinds and certificates
    that name nothing are dropped.  Batch or stream."""
    m = messages.select(F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("m"), (seen_at if seen_at is not None else F.current_timestamp()).alias("seen_at"))
    c = F.col("m.data.leaf_cert")
    sans = F.coalesce(c["all_domains"], F.array().cast("array<string>"))
    rows = m.where(F.col("m.message_type") == "certificate_update").select(
        F.coalesce(c["subject"]["CN"], F.lit("")).alias("cn"), sans.alias("sans"),
        F.coalesce(F.nullif(c["issuer"]["CN"], F.lit("")), c["issuer"]["O"], F.lit("")).alias("issuer"),
        from_unix_float(c["not_before"]).alias("not_before"), from_unix_float(c["not_after"]).alias("not_after"), "seen_at", F.lit("certstream").alias("source"), F.lit(-1).cast("long").alias("idx"),
    )
    return rows.where((F.col("cn") != "") | (F.size("sans") > 0))


def _tlv(b: bytes, at: int) -> tuple[int, int, int]:
    """Tag, start and end of the value of the DER element at ``at``."""
    tag, n = b[at], b[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            raise ValueError("length")
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    if at + n > len(b):
        raise ValueError("short")
    return tag, at, at + n


def _children(b: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    while lo < hi:
        t, s, e = _tlv(b, lo)
        yield t, s, e
        lo = e


_CN, _O, _SAN = b"\x55\x04\x03", b"\x55\x04\x0a", b"\x55\x1d\x11"


def _name(b: bytes, lo: int, hi: int) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    for _, s, e in _children(b, lo, hi):
        for _, s2, e2 in _children(b, s, e):
            (_, a, z), (t, v, w) = list(_children(b, s2, e2))[:2]
            out[b[a:z]] = b[v:w].decode("utf-16-be" if t == 0x1E else "utf-8", "replace") if b[a:z] == _CN or b[a:z] not in out else out[b[a:z]]
    return out


def _time(tag: int, raw: bytes) -> datetime:
    return datetime.strptime(raw.decode("ascii"), "%y%m%d%H%M%SZ" if tag == 0x17 else "%Y%m%d%H%M%SZ").replace(tzinfo=UTC)


def certificate(der: bytes, tbs_only: bool) -> tuple[str, list[str], str, datetime, datetime] | None:
    """CN, DNS names, issuer and validity of a certificate or TBSCertificate; None if unreadable."""
    try:
        _, lo, hi = _tlv(der, 0)
        if not tbs_only:
            _, lo, hi = _tlv(der, lo)
        parts = list(_children(der, lo, hi))
        if parts[0][0] == 0xA0:
            parts = parts[1:]
        (_, *issuer), (_, *valid), (_, *subject) = parts[2:5]
        issuer, subject = _name(der, *issuer), _name(der, *subject)
        times = [_time(t, der[s:e]) for t, s, e in _children(der, *valid)]
        sans: list[str] = []
        for tag, s, e in parts[6:]:
            if tag != 0xA3:
                continue
            _, s, e = _tlv(der, s)
            for _, s2, e2 in _children(der, s, e):
                fields = list(_children(der, s2, e2))
                if der[fields[0][1] : fields[0][2]] == _SAN:
                    _, s3, e3 = _tlv(der, fields[-1][1])
                    sans += [der[a:z].decode("ascii") for t, a, z in _children(der, s3, e3) if t == 0x82]
        return subject.get(_CN, ""), sans, issuer.get(_CN) or issuer.get(_O, ""), *times
    except (ValueError, IndexError, UnicodeDecodeError):
        return None


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([r for r in found if r[2] or len(r[3])], columns=["source", "idx", "cn", "sans", "issuer", "not_before", "not_after"])


def decode_ct_entries(entries: DataFrame) -> DataFrame:
    """Landed entries ``(log, index, leaf_input, extra_data)``, base64, to certs; entries that
    can't be read or name nothing are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for log, i, leaf in zip(b["log"], b["index"], b["leaf"]):
                if leaf is None or len(leaf) < 15:
                    continue
                kind = int.from_bytes(leaf[10:12], "big")
                at = 12 + 32 * (kind == 1)
                n = int.from_bytes(leaf[at : at + 3], "big")
                c = certificate(bytes(leaf[at + 3 : at + 3 + n]), kind == 1) if kind in (0, 1) else None
                if c:
                    out.append((log, i, *c))
            yield _rows(out)

    return entries.select("log", "index", F.try_to_binary("leaf_input", F.lit("base64")).alias("leaf")).mapInPandas(run, CERT)


_PATH = re.compile(r"tile/data/((?:x\d{3}/)*\d{3})(?:\.p/(\d+))?$")


def tile_entries(tile: bytes) -> list[tuple[bytes, bool]]:
    """(DER, is a precertificate's TBS) of each entry; ValueError on broken framing."""
    out, at = [], 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(tile):
            raise ValueError(f"tile ends inside an entry, at byte {len(tile)} of {at + n}")
        at += n
        return tile[at - n : at]

    def vector(k: int) -> bytes:
        return take(int.from_bytes(take(k), "big"))

    while at < len(tile):
        take(8)
        kind = int.from_bytes(take(2), "big")
        if kind not in (0, 1):
            raise ValueError(f"entry type {kind}")
        take(32 * kind)
        out.append((vector(3), kind == 1))
        vector(2)
        if kind:
            vector(3)
        vector(2)
    return out


def read_data_tiles(spark: SparkSession, path: str) -> DataFrame:
    """A folder of data tiles to certs and ``error``: a broken tile is one row with its error
    and no cert; a bad certificate is skipped.  A tile a row, so tiles are read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for p, raw in zip(b["path"], b["content"]):
                m = _PATH.search(p)
                if not m:
                    continue
                first = 256 * int("".join(x.lstrip("x") for x in m[1].split("/")))
                try:
                    found = tile_entries(bytes(raw))[: int(m[2]) if m[2] else 256]
                    rows = _rows([(p, first + i, *c) for i, (der, tbs) in enumerate(found) if (c := certificate(der, tbs))]).assign(error=None)
                except ValueError as e:
                    rows = pd.DataFrame([(p, first, "", [], "", None, None, str(e))], columns=["source", "idx", "cn", "sans", "issuer", "not_before", "not_after", "error"])
                parts.append(rows)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return files.select("path", "content").mapInPandas(run, CERT + ", error string")
