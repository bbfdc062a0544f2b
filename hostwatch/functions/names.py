"""Scalar functions over names, as Column builders that stay in generated code."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VALID_HOST = r"^(?=.{1,253}\z)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:xn--(?:[a-z0-9-]{0,58}[a-z0-9])|(?!xn--)[a-z]{2,63})\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_host(c) -> Column:
    """Trim, lower, one trailing dot off, scheme off, path off, one trailing dot off again."""
    c = F.lower(F.regexp_replace(_col(c), r"(?s)^\s+|\s+\z", ""))
    c = F.regexp_replace(F.regexp_replace(c, r"\.\z", ""), r"(?s)^.*?://", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?s)[/?#].*\z", ""), r"\.\z", "")


def is_valid_host(c) -> Column:
    return _col(c).rlike(VALID_HOST)


def expand_name(c) -> Column:
    """``array<struct<host, from_wildcard>>``: a name as it is; a wildcard as apex and www."""
    n = normalize_host(c)
    wild = n.startswith("*.")
    host = F.when(wild, F.substring(n, 3, 1000)).otherwise(n)
    one = lambda h, w: F.struct(h.alias("host"), F.lit(w).alias("from_wildcard"))
    none = F.array().cast("array<struct<host:string,from_wildcard:boolean>>")
    return (
        F.when(~F.coalesce(is_valid_host(host), F.lit(False)), none).when(~wild, F.array(one(host, False)))
        .when(host.startswith("www."), F.array(one(host, True))).otherwise(F.array(one(host, True), one(F.concat(F.lit("www."), host), True)))
    )


def reverse_host(c) -> Column:
    """Labels in reverse; its own inverse, empty labels included."""
    return F.array_join(F.reverse(F.split(_col(c), "[.]", -1)), ".")


def cert_shape(host, cert_name) -> Column:
    """How a certificate's name relates to the host it gave."""
    host, name = _col(host), _col(cert_name)
    apex = F.regexp_replace(host, r"^www\.", "")
    return F.when(name == "", "empty").when(name == host, "host").when(name == F.concat(F.lit("*."), host), "wild_host").when(name == F.concat(F.lit("*."), apex), "wild_apex").otherwise("literal")


def is_redirected(host, final_url) -> Column:
    return (_col(final_url) != "") & (_col(final_url) != F.concat(F.lit("https://"), _col(host), F.lit("/")))


def body_hash(body, max_body: int = 2 << 20) -> Column:
    """SHA-256 of the first ``max_body`` bytes; empty without a body."""
    return F.coalesce(F.sha2(F.substring(_col(body).cast("binary"), 1, max_body), 256), F.lit(""))


def body_size(body, max_body: int = 2 << 20) -> Column:
    return F.least(F.coalesce(F.octet_length(_col(body).cast("binary")), F.lit(0)), F.lit(max_body)).cast("long")


def issuer_name(cn, orgs) -> Column:
    return F.coalesce(F.nullif(_col(cn), F.lit("")), F.get(_col(orgs), 0), F.lit(""))


def from_unix_float(c) -> Column:
    return F.when(_col(c) > 0, F.timestamp_micros((_col(c) * 1_000_000).cast("long")))


def to_seconds(ts) -> Column:
    """What a write keeps: whole seconds from 1970 to 2106."""
    s = F.unix_seconds(F.date_trunc("second", _col(ts).cast("timestamp")))
    return F.greatest(F.lit(0), F.least(s, F.lit((1 << 32) - 1))).cast("long")


def tld(host) -> Column:
    return F.substring_index(_col(host), ".", -1)


def note_origin(url) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(url), "^https://", ""), "^http://", ""), r"/+\z", "")


def parse_retention(text: str) -> timedelta:
    """``90d``, ``36h``, ``1d12h``: positive, at most 100,000 days."""
    m = re.fullmatch(r"(?:(\d+)d)?(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", text.strip())
    if not m or not text.strip():
        raise ValueError(f"not a duration: {text!r}")
    d, h, mi, s = (int(x or 0) for x in m.groups())
    seconds = ((d * 24 + h) * 60 + mi) * 60 + s
    if not 0 < seconds <= 100_000 * 86_400:
        raise ValueError(f"out of range: {text!r}")
    return timedelta(seconds=seconds)


def register(spark: SparkSession) -> None:
    """The scalar names for SQL, as SQL functions that the optimizer inlines."""
    from hostwatch.functions.addresses import ARG_MARK, CANONICAL_V4, ESC_MARK, HOST_MARK

    trimmed = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, r'(?s)^\s+|\s+\z', '')), r'\.\z', ''), r'(?s)^.*?://', '')"
    normal = rf"regexp_replace(regexp_replace({trimmed.format('c')}, r'(?s)[/?#].*\z', ''), r'\.\z', '')"
    names = "ARRAY<STRUCT<host: STRING, from_wildcard: BOOLEAN>>"
    bodies = {
        "normalize_host(c STRING) RETURNS STRING": rf"regexp_replace(regexp_replace({trimmed.format('c')}, r'(?s)[/?#].*\z', ''), r'\.\z', '')",
        "is_valid_host(c STRING) RETURNS BOOLEAN": f"c RLIKE r'{VALID_HOST}'",
        "reverse_host(c STRING) RETURNS STRING": "array_join(reverse(split(c, '[.]', -1)), '.')",
        "tld(c STRING) RETURNS STRING": "substring_index(c, '.', -1)",
        "cert_shape(host STRING, cert_name STRING) RETURNS STRING": r"CASE WHEN cert_name = '' THEN 'empty' WHEN cert_name = host THEN 'host' WHEN cert_name = concat('*.', host) THEN 'wild_host' WHEN cert_name = concat('*.', regexp_replace(host, r'^www\.', '')) THEN 'wild_apex' ELSE 'literal' END",
        # A name as a struct of its host and whether it is a wildcard; the apex and www of one.
        f"expand_name(c STRING) RETURNS {names}": f"""(SELECT CASE WHEN NOT coalesce(h RLIKE r'{VALID_HOST}', false) THEN cast(array() AS {names})
             WHEN NOT n LIKE '*.%' THEN array(named_struct('host', h, 'from_wildcard', false)) WHEN h LIKE 'www.%' THEN array(named_struct('host', h, 'from_wildcard', true))
             ELSE array(named_struct('host', h, 'from_wildcard', true), named_struct('host', concat('www.', h), 'from_wildcard', true)) END
             FROM (SELECT n, CASE WHEN n LIKE '*.%' THEN substring(n, 3) ELSE n END AS h FROM (SELECT {normal} AS n)))""",
        f"error_shape(host STRING, msg STRING) RETURNS STRUCT<shape: STRING, args: ARRAY<STRING>>": rf"""(SELECT named_struct('shape', regexp_replace(m, r'{CANONICAL_V4}', '{ARG_MARK}'), 'args', regexp_extract_all(m, r'({CANONICAL_V4})', 1))
             FROM (SELECT CASE WHEN host = '' THEN e ELSE replace(e, host, '{HOST_MARK}') END AS m FROM (SELECT regexp_replace(msg, '([{HOST_MARK}{ARG_MARK}{ESC_MARK}])', '{ESC_MARK}$1') AS e)))""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
