"""Noise filters over names, public suffixes, and the ingest funnel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostwatch.functions.names import expand_name
from hostwatch.operators.records import NAMES, cert_names, expand_cert

#: A rule table beyond this many rows is joined by shuffle.
BROADCAST_RULES = 200_000

# Parents that make many tenants' names.
DEFAULT_BLOCKLIST = (
    "workers.dev", "pages.dev", "vercel.app", "netlify.app", "herokuapp.com", "azurewebsites.net", "cloudfront.net", "r2.cloudflarestorage.com",
    "chatgpt.site", "zendesk.com", "myshopify.com", "squarespace.com", "wixsite.com",
    "quickconnect.to", "plex.direct", "devices.meraki.direct", "mcas.ms",
)


def bounded(df: DataFrame, most: int = BROADCAST_RULES) -> DataFrame:
    """With a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parse_suffixes(lines: DataFrame) -> DataFrame:
    """Lines (column ``value``) of suffixes, commas and # comments to distinct suffixes."""
    part = lines.select(F.explode(F.split(F.regexp_replace("value", "#.*", ""), ",")).alias("s"))
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("s")), r"^\*\.", ""), r"^\.+|\.+$", "")
    return part.select(clean.alias("suffix")).where("suffix <> ''").distinct()


def load_suffix_list(spark: SparkSession, inline: str = "", path: str | None = None, default: bool = True) -> DataFrame:
    """Default, inline and file suffixes together; a missing file is an error."""
    lines = spark.createDataFrame([(x,) for x in [*(DEFAULT_BLOCKLIST if default else ()), *inline.split("\n")]], "value string")
    if path:
        lines = lines.unionByName(spark.read.text(path))
    return parse_suffixes(lines)


def parse_public_suffixes(lines: DataFrame) -> DataFrame:
    """Lines of a public suffix file to ``(kind, base)``: e exact, w wildcard, x exception."""
    rule = F.lower(F.regexp_extract("value", r"^\s*([^\s/]\S*)", 1))
    kind = F.when(rule.startswith("!"), "x").when(rule.startswith("*."), "w").otherwise("e")
    return lines.where(~F.trim("value").startswith("//")).select(kind.alias("kind"), F.regexp_replace(rule, r"^(!|\*\.)", "").alias("base")).where("base <> ''").distinct()


def load_public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    return parse_public_suffixes(spark.read.text(path))


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, registrable, depth)`` of each distinct host; null where it is itself a suffix.

    Once per distinct host: its suffixes meet the rules in a broadcast join.
    """
    labels = hosts.select("host").distinct().withColumn("ls", F.split("host", "[.]", -1))
    parts = labels.select("host", F.size("ls").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("ls", i + 1, F.size("ls")), ".").alias("base")))).alias("p"))
    hit = parts.select("host", "n", "p.i", "p.base").join(bounded(rules), "base", "left")
    size = F.expr("CASE kind WHEN 'e' THEN n - i WHEN 'w' THEN IF(i > 0, n - i + 1, NULL) WHEN 'x' THEN n - i - 1 END")
    best = hit.withColumn("s", size).groupBy("host", "n").agg(F.expr("coalesce(max(s) FILTER (WHERE kind = 'x'), max(s) FILTER (WHERE kind <> 'x'), 1)").alias("k"))
    named = F.when(F.col("n") > F.col("k"), F.array_join(F.slice(F.split("host", "[.]", -1), F.col("n") - F.col("k"), F.col("k") + 1), "."))
    return best.select("host", named.alias("registrable"), F.when(F.col("n") > F.col("k"), F.col("n") - F.col("k") - 1).alias("depth"))


def with_registrable(names: DataFrame, rules: DataFrame) -> DataFrame:
    return names.join(registrable(names, rules), "host")


def apply_san_policy(certs: DataFrame, ignore: bool = False, most: int = 0) -> DataFrame:
    """SANs left out or cut to the first ``most``; ``sans_cut`` counts those cut."""
    sans = F.coalesce("sans", F.array().cast("array<string>"))
    if ignore:
        return certs.withColumns({"sans": F.array().cast("array<string>"), "sans_cut": F.lit(0).cast("long")})
    if most <= 0:
        return certs.withColumns({"sans": sans, "sans_cut": F.lit(0).cast("long")})
    return certs.withColumns({"sans_cut": F.greatest(F.size(sans) - most, F.lit(0)).cast("long"), "sans": F.slice(sans, 1, most)})


def filter_depth(names: DataFrame, max_depth: int = 1) -> DataFrame:
    """Names with ``depth``: those without a registrable domain always go."""
    kept = names.where("depth IS NOT NULL")
    return kept.where(F.col("depth") <= max_depth) if max_depth > 0 else kept


def filter_blocklist(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Names not equal to or under any suffix, on label boundaries."""
    return names.join(blocked_hosts(names, suffixes), "host", "left_anti")


def blocked_hosts(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The hosts equal to or under a suffix, once each."""
    ls = F.split("host", "[.]", -1)
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.array_join(F.slice(ls, i, F.size(ls)), "."))).alias("suffix")
    return names.select("host").distinct().select("host", up).join(bounded(suffixes), "suffix").select("host").distinct()


def filter_recent(names: DataFrame, window: str = "10 minutes") -> DataFrame:
    """The first sighting of each host in each epoch-aligned window.  One partial
    aggregation: a hot host costs a row a task and window, and nothing is joined."""
    order = F.struct(*ORDER_COLUMNS)
    first = names.groupBy("host", F.window(F.col("seen_at"), window)["start"].alias("w")).agg(F.min_by(F.struct(*names.columns), order).alias("x"))
    return first.select("x.*")


def flagged_names(certs: DataFrame) -> DataFrame:
    """``expand_cert`` that keeps certificates without names: a row without host.  ``head``
    marks one row a certificate, so that counts of certificates and of names come from one
    pass; ``skipped``: a common name that gives no host; ``sans_cut``: see apply_san_policy."""
    cut = F.col("sans_cut") if "sans_cut" in certs.columns else F.lit(0)
    rows = certs.select(*(c for c in ("cert_id", "seen_at", "source", "issuer", "idx")), cut.cast("long").alias("sans_cut"), ((F.col("cn") != "") & (F.size(expand_name("cn")) == 0)).alias("skipped"), cert_names("cn", "sans").alias("ns"))
    out = rows.select("*", F.posexplode_outer("ns").alias("at", "n"))
    return out.select(*(F.col(f"n.{c}") if c in ("host", "from_wildcard", "raw", "origin") else F.col(c) for c in NAMES), (F.coalesce("at", F.lit(0)) == 0).alias("head"), "skipped", "sans_cut")


ORDER_COLUMNS = ["seen_at", "source", "idx", "cert_id"]


def cap_per_parent(names: DataFrame, known: DataFrame | None = None, limit: int = 20, window_seconds: int = 600, align: str = "anchored") -> DataFrame:
    """At most ``limit`` new hosts per parent and window.  names: idx, seen_at, parent, host.

    The parent itself, hosts without parent and known hosts are free.  anchored: a window
    starts at the first charged sighting after the last one elapsed; that is a rule about
    one sequence per parent, followed row by row in sorted partitions with a state of two
    numbers and the accepted hosts.  epoch: aligned windows, ranks over first sightings.
    A limit of 0 or less lets all through.
    """
    if limit <= 0:
        return names
    free = F.coalesce(F.col("host") == F.col("parent"), F.lit(True))
    if known is not None:
        names = names.join(known.select(F.col("host").alias("__k")).distinct(), F.col("host") == F.col("__k"), "left").withColumn("__free", free | F.col("__k").isNotNull()).drop("__k")
    else:
        names = names.withColumn("__free", free)
    charged = names.where("NOT __free").drop("__free")
    if align == "epoch":
        first = charged.groupBy("parent", "host").agg(F.min(F.struct("seen_at", "idx")).alias("f"))
        rank = F.row_number().over(Window.partitionBy("parent", "w").orderBy("f.seen_at", "f.idx"))
        ok = first.withColumn("w", F.window("f.seen_at", f"{window_seconds} seconds")["start"]).withColumn("r", rank).where(F.col("r") <= limit).select("parent", "host")
        kept = charged.join(ok, ["parent", "host"], "left_semi")
    else:
        n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = charged.repartition(n, "parent").sortWithinPartitions("parent", "seen_at", "idx")
        kept = dealt.mapInPandas(_anchored(limit, window_seconds), dealt.schema)
    return kept.select(*kept.columns).unionByName(names.where("__free").drop("__free").select(*kept.columns))


def _anchored(limit: int, window_seconds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = pd.Timedelta(seconds=window_seconds)
        parent, start, n, accepted = None, None, 0, set()
        for b in batches:
            keep = []
            for p, h, t in zip(b["parent"], b["host"], b["seen_at"]):
                if p != parent:
                    parent, start, n, accepted = p, None, 0, set()
                if h in accepted:
                    keep.append(True)
                elif start is None or t - start >= span:
                    start, n = t, 1
                    accepted.add(h)
                    keep.append(True)
                elif n < limit:
                    n += 1
                    accepted.add(h)
                    keep.append(True)
                else:
                    keep.append(False)
            yield b[keep]

    return run


def verdicts(certs: DataFrame, rules: DataFrame, suffixes: DataFrame, records: DataFrame, max_depth: int = 1, recent: str = "10 minutes", limit: int = 20, window_seconds: int = 600) -> DataFrame:
    """Each name with its ``verdict``: too_deep, blocked, dup, capped, new or repeat, in the
    order of the stages; a stage sees only what the earlier ones let pass."""
    names = with_registrable(expand_cert(certs), rules).withColumnRenamed("registrable", "parent")
    deep = F.col("depth").isNull() | ((F.col("depth") > max_depth) if max_depth > 0 else F.lit(False))
    bad = blocked_hosts(names, suffixes).withColumn("bad", F.lit(True))
    stored = records.select("host").distinct().withColumn("stored", F.lit(True))
    rows = names.join(bad, "host", "left").join(stored, "host", "left")
    # One lineage from here: each stage ranks the rows that are still in, beside the others.
    rows = rows.withColumn("verdict", F.when(deep, "too_deep").when(F.col("bad"), "blocked"))
    inside, at = F.col("verdict").isNull(), [F.col(c) for c in ORDER_COLUMNS]
    again = F.row_number().over(Window.partitionBy(inside, "host", F.window("seen_at", recent)["start"]).orderBy(*at)) > 1
    rows = rows.withColumn("again", again).withColumn("verdict", F.when(inside & F.col("again"), "dup").otherwise(F.col("verdict")))
    if limit > 0:
        # A parent's hosts in the order of their first sightings; itself, hosts without parent and known hosts are free.
        charged = inside & (F.col("host") != F.col("parent")) & F.col("stored").isNull()
        rows = rows.withColumn("charged", F.coalesce(charged, F.lit(False)))
        rows = rows.withColumn("f", F.min(F.struct("seen_at", "idx")).over(Window.partitionBy("charged", "parent", "host")))
        turn = F.dense_rank().over(Window.partitionBy("charged", "parent", F.window("f.seen_at", f"{window_seconds} seconds")["start"]).orderBy("f.seen_at", "f.idx", "host"))
        rows = rows.withColumn("turn", turn).withColumn("verdict", F.when(F.col("charged") & (F.col("turn") > limit), "capped").otherwise(F.col("verdict")))
    first = F.col("stored").isNull() & (F.row_number().over(Window.partitionBy(inside, "host").orderBy(*at)) == 1)
    rows = rows.withColumn("first", first).withColumn("verdict", F.coalesce("verdict", F.when(F.col("first"), "new").otherwise("repeat")))
    return rows.select("cert_id", "host", "origin", "verdict")


def ingest_funnel(certs: DataFrame, rules: DataFrame, suffixes: DataFrame, records: DataFrame, max_depth: int = 1, recent: str = "10 minutes", limit: int = 20, window_seconds: int = 600) -> DataFrame:
    """One row of counters; names = too_deep + blocked + dup + capped + new + repeat.

    The counts of ``verdicts`` without its rows.  A host's sightings in a recent window are one
    row as soon as a task has seen them, and carry the counts of certificates along; what
    depends on the host alone is joined to these.  Of a parent's hosts in a window no task hands
    on more than ``limit``, so neither a hot host nor a hot parent gathers anywhere.
    """
    seen = flagged_names(certs)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    few = seen.groupBy("host", F.window("seen_at", recent)["start"].alias("w")).agg(
        F.count("*").alias("n"), F.min(F.struct("seen_at", "idx")).alias("f"), F.count_if((F.col("origin") == "san") & F.col("host").isNotNull()).alias("san"), F.count_if("head").alias("certs"),
        F.count_if(F.col("head") & F.col("skipped")).alias("skipped"), total(F.when(F.col("head"), F.col("sans_cut"))).alias("cut"),
    )
    hosts = seen.where("host IS NOT NULL").select("host").distinct()
    known = registrable(hosts, rules).withColumnRenamed("registrable", "parent").join(blocked_hosts(hosts, suffixes).withColumn("bad", F.lit(True)), "host", "left")
    known = known.join(records.select("host").distinct().withColumn("stored", F.lit(True)), "host", "left")
    # A row a host: its names, those that the recent filter lets pass, and the first of these.
    sums = few.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "san", "certs", "skipped", "cut")), F.count("*").alias("passed"), F.min("f").alias("f"))
    deep = F.col("depth").isNull() | ((F.col("depth") > max_depth) if max_depth > 0 else F.lit(False))
    rows = sums.join(known, "host", "left").withColumn("state", F.when(F.col("host").isNull(), "none").when(deep, "too_deep").when(F.col("bad"), "blocked").otherwise("in"))
    rows = rows.withColumn("charged", F.coalesce((F.col("state") == "in") & (F.col("host") != F.col("parent")) & F.col("stored").isNull(), F.lit(False)) & F.lit(limit > 0))
    of = lambda state, c="n": total(F.when(F.col("state") == state, F.col(c)))
    all_ = rows.agg(
        total("certs").alias("certs"), total("cut").alias("sans_cut"), total("skipped").alias("skipped_cn"), total(F.when(F.col("host").isNotNull(), F.col("n"))).alias("names"), total("san").alias("from_san"),
        of("too_deep").alias("too_deep"), of("blocked").alias("blocked"), (of("in") - of("in", "passed")).alias("dup"), of("in", "passed").alias("__passed"),
        total(F.when(F.col("charged"), F.col("passed"))).alias("__charged"), F.count_if((F.col("state") == "in") & ~F.col("charged") & F.col("stored").isNull()).alias("__free"),
    )
    turn = F.row_number().over(Window.partitionBy("parent", F.window("f.seen_at", f"{window_seconds} seconds")["start"]).orderBy("f.seen_at", "f.idx", "host"))
    taken = rows.where("charged").withColumn("turn", turn).where(F.col("turn") <= limit).agg(F.count("*").alias("__hosts"), total("passed").alias("__taken"))
    both = all_.withColumn("__one", F.lit(1)).join(taken.withColumn("__one", F.lit(1)), "__one")
    new = F.col("__free") + F.col("__hosts")
    return both.select("certs", "sans_cut", "skipped_cn", "names", "from_san", "too_deep", "blocked", "dup", (F.col("__charged") - F.col("__taken")).alias("capped"), new.alias("new"), (F.col("__passed") - F.col("__charged") + F.col("__taken") - new).alias("repeat"))
