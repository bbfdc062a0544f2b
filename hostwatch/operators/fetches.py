"""Fetch results: change detection, folding into records, funnels and groups of bodies.

``fetches``: fetch_id, host, fetched_at, status, final_url, body, error, deferred_reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.functions.addresses import error_shape, is_public_v4, public_v6_of
from hostwatch.functions.names import body_hash, body_size

RETRY = "30 seconds"


def finished(fetches: DataFrame) -> DataFrame:
    """Results that weren't deferred, with the hash and size of their bodies."""
    ok = fetches.where("deferred_reason = ''")
    good = F.col("error") == ""
    return ok.withColumns({"hash": F.when(good, body_hash("body")).otherwise(""), "size": F.when(good, body_size("body")).otherwise(F.lit(0)).cast("long")})


def detect_changes(fetches: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``(host, changed_at, prev_hash, body_hash)``: a success whose hash isn't that of the
    success before.  Failures between don't matter; a first hash is no change."""
    rows = finished(fetches).where("hash <> ''").select("host", "fetched_at", "fetch_id", "hash")
    if records is not None:
        seed = records.where("body_hash <> ''").select("host", F.lit(None).cast("timestamp_ntz").alias("fetched_at"), F.lit(None).cast("long").alias("fetch_id"), F.col("body_hash").alias("hash"))
        rows = rows.unionByName(seed)
    before = F.lag("hash").over(Window.partitionBy("host").orderBy("fetched_at", "fetch_id"))
    return rows.withColumn("prev_hash", before).where("prev_hash <> hash AND fetched_at IS NOT NULL").select("host", F.col("fetched_at").alias("changed_at"), "prev_hash", F.col("hash").alias("body_hash"), "fetch_id")


def fold_fetches(records: DataFrame, fetches: DataFrame) -> DataFrame:
    """Records with the batch's results; results of hosts without a record are dropped."""
    done = finished(fetches).join(records.select("host"), "host", "left_semi").withColumn("ord", F.struct("fetched_at", "fetch_id"))
    last = done.groupBy("host").agg(
        F.count("*").alias("n"), F.max("fetched_at").alias("at"), F.max_by("status", "ord").alias("status"), F.max_by("final_url", "ord").alias("url"), F.max_by("error", "ord").alias("err"),
        F.expr("max_by(size, ord) FILTER (WHERE error = '')").alias("size"), F.expr("max_by(hash, ord) FILTER (WHERE hash <> '')").alias("hash"),
    )
    changes = detect_changes(fetches, records).groupBy("host").agg(F.max_by("prev_hash", F.struct("changed_at", "fetch_id")).alias("prev"), F.max("changed_at").alias("when"), F.count("*").alias("changes"))
    both = records.join(last, "host", "left").join(changes, "host", "left")
    new = F.col("n").isNotNull()
    out = {
        "probed": F.col("probed") | new, "probed_at": F.coalesce("at", "probed_at"), "http_status": F.when(new, F.col("status")).otherwise(F.col("http_status")),
        "final_url": F.when(new, F.col("url")).otherwise(F.col("final_url")), "probe_error": F.when(new, F.col("err")).otherwise(F.col("probe_error")),
        "body_size": F.coalesce("size", "body_size"), "body_hash": F.coalesce("hash", "body_hash"), "prev_hash": F.coalesce("prev", "prev_hash"),
        "changed_at": F.coalesce("when", "changed_at"), "probe_count": F.col("probe_count") + F.coalesce("n", F.lit(0)),
    }
    return both.select(*(out[c].alias(c) if c in out else F.col(c) for c in records.columns))


def fetch_funnel(fetches: DataFrame, records: DataFrame, swept: DataFrame | None = None) -> DataFrame:
    """One row of counters over results of known hosts; ``backfilled``: hosts that sweeps of the
    queue (``swept``, see sweep_queue) gave to the fetchers."""
    known = fetches.join(records.select("host"), "host")
    counts = known.agg(
        F.count_if(F.col("deferred_reason") == "").alias("probed"), F.count_if((F.col("deferred_reason") == "") & (F.col("error") != "")).alias("probe_failed"),
        F.count_if(F.col("deferred_reason") == "address_budget").alias("throttled"), F.count_if(F.col("deferred_reason") == "no_dns_answer").alias("unresolved"), F.count_if(F.col("deferred_reason") != "").alias("deferred"),
    ).withColumn("__one", F.lit(1))
    changed = detect_changes(fetches, records).join(records.select("host"), "host", "left_semi").agg(F.count("*").alias("changed")).withColumn("__one", F.lit(1))
    rows = counts.join(changed, "__one")
    if swept is None:
        return rows.withColumn("backfilled", F.lit(0).cast("long")).drop("__one")
    return rows.join(swept.agg(F.count_if(F.col("action") == "to_fetch").alias("backfilled")).withColumn("__one", F.lit(1)), "__one").drop("__one")


def shared_bodies(records: DataFrame, min_hosts: int = 2) -> DataFrame:
    """Bodies that several hosts serve, with the number of hosts and the first and last host."""
    return records.where("body_hash <> ''").groupBy("body_hash").agg(F.count("*").alias("hosts"), F.min("host").alias("first_host"), F.max("host").alias("last_host")).where(F.col("hosts") >= min_hosts)


def shared_body_members(records: DataFrame, min_hosts: int = 2) -> DataFrame:
    """``(body_hash, host)`` of those groups: rows, so that a group of any size is no single value."""
    return records.where("body_hash <> ''").select("body_hash", "host").join(shared_bodies(records, min_hosts).select("body_hash"), "body_hash")


def error_shapes(records: DataFrame) -> DataFrame:
    """Error shape to its number of records."""
    rows = records.where("probe_error <> ''").select(error_shape("host", "probe_error").alias("e"))
    return rows.groupBy(F.col("e.shape").alias("shape")).agg(F.count("*").alias("records"))


def error_shape_summary(records: DataFrame) -> DataFrame:
    """One row: records with an error, their distinct texts and shapes, and shapes of one record."""
    rows = records.where("probe_error <> ''").select("probe_error", error_shape("host", "probe_error")["shape"].alias("shape"))
    texts = rows.groupBy("shape", "probe_error").agg(F.count("*").alias("n"))
    shapes = texts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return shapes.agg(total("n").alias("records"), total("texts").alias("texts"), F.count("*").alias("shapes"), F.count_if(F.col("n") == 1).alias("singletons"))


def fetchable_addresses(lookups: DataFrame) -> DataFrame:
    """``addrs`` cut to public ones in order; refused without one; the first is the budget key.

    In the row: IPv4 by its own arithmetic, and of the IPv6 texts, told apart by one Arrow call
    a row that has any, the public ones by membership.  No plan-time job and no join.
    """
    public = F.when(F.exists("addrs", lambda a: a.contains(":")), public_v6_of(F.filter("addrs", lambda a: a.contains(":")))).otherwise(F.array().cast("array<string>"))
    kept = lookups.withColumn("__v6", public)
    kept = kept.withColumn("addrs", F.filter("addrs", lambda a: F.when(a.contains(":"), F.array_contains("__v6", a)).otherwise(is_public_v4(a))))
    return kept.drop("__v6").withColumns({"refused": F.coalesce(F.size("addrs") <= 0, F.lit(True)), "budget_key": F.get("addrs", F.lit(0))})
