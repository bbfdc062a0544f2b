"""Certificates to names, names to one record per hostname, and merging of records.

``certs``: cert_id, cn, sans, issuer, source, idx, seen_at.  Order of arrival inside a
batch is (seen_at, source, idx); what is stored precedes a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.functions.names import expand_name, reverse_host
from hostwatch.operators.ranks import numbered

NAMES = ["cert_id", "host", "from_wildcard", "raw", "origin", "seen_at", "source", "issuer", "idx"]
ORDER = ("seen_at", "source", "idx")
PROBE = {"probed": "false", "probed_at": "cast(null AS timestamp_ntz)", "http_status": "0", "final_url": "''", "body_size": "cast(0 AS bigint)", "body_hash": "''", "prev_hash": "''", "changed_at": "cast(null AS timestamp_ntz)", "probe_count": "cast(0 AS bigint)", "probe_error": "''"}


def has_names(certs: DataFrame) -> DataFrame:
    """Certificates with a common name or a SAN."""
    return certs.where((F.coalesce("cn", F.lit("")) != "") | (F.coalesce(F.size("sans"), F.lit(0)) > 0))


def cert_names(cn: str, sans: str):
    """The array of a certificate's hostnames, once each: the CN's before the SANs', and of
    equal hosts the first."""
    of = lambda c, origin: F.struct(c.alias("raw"), F.lit(origin).alias("origin"))
    parts = F.concat(F.array(of(F.col(cn), "cn")), F.transform(F.coalesce(sans, F.array().cast("array<string>")), lambda s: of(s, "san")))
    made = F.flatten(F.transform(parts, lambda p: F.transform(expand_name(p["raw"]), lambda e: F.struct(e["host"].alias("host"), e["from_wildcard"].alias("from_wildcard"), p["raw"].alias("raw"), p["origin"].alias("origin")))))
    # One evaluation of the long expression: it is bound as the only element of an array.
    return F.flatten(F.transform(F.array(made), lambda ns: F.filter(ns, lambda n, i: F.array_position(ns["host"], n["host"]) == i + 1)))


def expand_cert(certs: DataFrame) -> DataFrame:
    """Each certificate's hostnames as rows, without a shuffle."""
    return certs.select("cert_id", "seen_at", "source", "issuer", "idx", F.explode(cert_names("cn", "sans")).alias("n")).select("cert_id", "n.*", "seen_at", "source", "issuer", "idx").select(*NAMES)


def dedupe_cert_names(names: DataFrame, pos: str = "pos") -> DataFrame:
    """The same rule over exploded names with their position."""
    w = Window.partitionBy("cert_id", "host").orderBy("origin", pos)
    return names.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fold_sightings(names: DataFrame) -> DataFrame:
    """One record per host.  All aggregates are partial, so a hot host costs a row a task."""
    rows = names.withColumn("ord", F.struct(*ORDER))
    return rows.groupBy("host").agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("seen_count"),
        F.min_by("from_wildcard", "ord").alias("from_wildcard"),
        F.expr("coalesce(min_by(raw, ord) FILTER (WHERE origin = 'cn'), min_by(raw, ord))").alias("cert_name"),
        F.expr("CASE WHEN count_if(origin = 'cn') > 0 THEN 'cn' ELSE 'san' END").alias("origin"),
        F.max_by("source", "ord").alias("source"),
        F.expr("coalesce(max_by(issuer, ord) FILTER (WHERE issuer <> ''), '')").alias("issuer"),
    )


def as_records(folded: DataFrame) -> DataFrame:
    """A fold's rows with the columns of a record that was never fetched."""
    return folded.withColumn("rev_host", reverse_host("host")).select("*", *(F.expr(e).alias(c) for c, e in PROBE.items()))


def merge_records(existing: DataFrame, batch: DataFrame, by_time: bool = False) -> DataFrame:
    """Stored records and a batch's fold to new records and ``is_new``: one shuffle on host.

    What is stored precedes the batch.  by_time: unless its times say otherwise, so that late
    sightings lower first_seen, and neither last_seen nor source go back."""
    e, b = existing.select(*(F.col(c).alias(f"e_{c}") for c in existing.columns)), batch
    both = e.join(b, e["e_host"] == b["host"], "full_outer")
    upgrade = F.col("host").isNotNull() & (F.col("e_host").isNull() | ((F.col("e_origin") != "cn") & (F.col("origin") == "cn")))
    issuer = F.coalesce(F.nullif("issuer", F.lit("")), "e_issuer", "issuer")
    out = {
        "host": F.coalesce("host", "e_host"), "first_seen": F.coalesce("e_first_seen", "first_seen"), "last_seen": F.coalesce("last_seen", "e_last_seen"),
        "seen_count": F.coalesce("seen_count", F.lit(0)) + F.coalesce("e_seen_count", F.lit(0)), "from_wildcard": F.coalesce("e_from_wildcard", "from_wildcard"),
        "cert_name": F.when(upgrade, F.col("cert_name")).otherwise(F.col("e_cert_name")), "origin": F.when(upgrade, F.col("origin")).otherwise(F.col("e_origin")),
        "source": F.coalesce("source", "e_source"), "issuer": issuer,
    }
    if by_time:
        newer = F.coalesce(F.col("last_seen") >= F.col("e_last_seen"), F.col("e_host").isNull())
        out |= {"first_seen": F.least("e_first_seen", "first_seen"), "last_seen": F.greatest("e_last_seen", "last_seen"), "source": F.when(newer, F.col("source")).otherwise(F.col("e_source"))}
    rest = [(F.coalesce(F.col(f"e_{c}"), b[c]) if c in batch.columns else F.col(f"e_{c}")).alias(c) for c in existing.columns if c not in out and c != "is_new"]
    return both.select(*(v.alias(k) for k, v in out.items()), *rest, F.col("e_host").isNull().alias("is_new"))


def lookup_records(hosts: DataFrame, records: DataFrame) -> DataFrame:
    """The records of those hosts that have one."""
    return records.join(hosts.select("host").distinct(), "host", "left_semi")


def get_record(records: DataFrame, host: str):
    """One record; KeyError where there is none."""
    row = records.where(F.col("host") == host.lower()).first()
    if row is None:
        raise KeyError(host)
    return row


def new_hosts(names: DataFrame, records: DataFrame) -> DataFrame:
    return names.join(records.select("host"), "host", "left_anti")


def known_hosts(names: DataFrame, records: DataFrame) -> DataFrame:
    return names.join(records.select("host"), "host", "left_semi")


def scan_records(records: DataFrame) -> DataFrame:
    """Every record in reversed-host order: a range-partitioned sort."""
    return records.orderBy("rev_host")


def build_dimension(records: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """``(id, value)``: '' is 0; existing ids stay, new values follow in their own order.

    Ranks come from a distributed sort: the place in a range partition plus the sizes of those
    before it, so that values that all begin alike spread over the tasks too.
    """
    values = records.select(F.col(column).alias("value")).where(F.col(column) != "").distinct()
    start = 0
    if existing is not None:
        values = values.join(existing.select("value"), "value", "left_anti")
        start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranked = numbered(values, "id", "value").select((F.col("id") + start + 1).cast("long").alias("id"), "value")
    zero = records.sparkSession.createDataFrame([(0, "")], "id long, value string")
    return (zero if existing is None else existing.select("id", "value")).unionByName(ranked)


def unused_dimension_rows(dimension: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """Rows that no record refers to, and their bytes; '' is never one."""
    used = records.select(F.col(column).alias("value"))
    return dimension.where("value <> ''").join(used, "value", "left_anti").select("id", "value", F.octet_length("value").cast("long").alias("bytes"))


def sweep_dimension(dimension: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """``dimension`` without its unused rows; ids stay as they are, and '' stays."""
    used = records.select(F.col(column).alias("value")).where(F.col(column) != "").distinct()
    return dimension.where("value = ''").unionByName(dimension.where("value <> ''").join(used, "value", "left_semi").select(*dimension.columns))
