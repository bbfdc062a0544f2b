"""Listing, statistics, coverage, export and retention."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwatch.functions.addresses import error_shape_v4
from hostwatch.functions.names import tld
from hostwatch.operators.queue import KEY
from hostwatch.operators.ranks import fixed
from hostwatch.operators.records import sweep_dimension


def under(df: DataFrame, parent: str | None) -> DataFrame:
    """A domain and all below it: a range of the sorted ``rev_host``, pushed to the scan."""
    if parent is None:
        return df
    name = parent.strip().strip(".").lower()
    if not name:
        raise ValueError(f"no domain in {parent!r}")
    r = ".".join(reversed(name.split(".")))
    return df.where((F.col("rev_host") == r) | F.col("rev_host").startswith(r + "."))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def unseen(cutoff: Column) -> Column:
    return F.col("last_seen") < cutoff


def failed(cutoff: Column) -> Column:
    return F.col("probed") & (F.col("probe_error") != "") & (F.col("body_hash") == "") & (F.col("first_seen") < cutoff) & (F.col("probed_at") < cutoff)


def list_records(records: DataFrame, now: Column | None = None, with_hash: bool = False, wildcard: bool = False, changed: bool = False, since_seconds: int = 0, parent: str | None = None, limit: int = 0, where: Column | None = None) -> DataFrame:
    """Records that meet all conditions, in reversed-host order."""
    preds = [p for p, on in ((F.col("body_hash") != "", with_hash), (F.col("from_wildcard"), wildcard), (F.col("prev_hash") != "", changed)) if on]
    if since_seconds > 0:
        preds.append(F.col("first_seen") >= now - F.make_dt_interval(secs=F.lit(since_seconds)))
    if where is not None:
        preds.append(where)
    rows = under(records, parent).where(all_of(*preds)).orderBy("rev_host")
    return rows.limit(limit) if limit > 0 else rows


def export_records(records: DataFrame, fmt: str = "tsv") -> DataFrame:
    """One text column ``value``: TSV lines, or JSON with empty optional fields left out."""
    seen = F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if fmt == "tsv":
        return records.select(F.concat_ws("\t", "host", F.col("http_status").cast("string"), F.when(F.col("body_hash") == "", "-").otherwise(F.col("body_hash")), seen).alias("value"))
    if fmt != "json":
        raise ValueError("fmt is tsv or json")
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    fields = ["host", "cert_name", "origin", "from_wildcard", "source", text("issuer"), time("first_seen"), time("last_seen"), "seen_count", "probed", time("probed_at"), number("http_status"), text("final_url"), number("body_size"), text("body_hash"), text("prev_hash"), time("changed_at"), number("probe_count"), text("probe_error")]
    return records.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def record_stats(records: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """One row of counts over the table, and the queue's."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    shape = F.when(F.col("probe_error") != "", error_shape_v4("host", "probe_error")["shape"])
    # One row a source, issuer and shape first: the distinct counts then expand those only.
    few = records.groupBy(some("source").alias("source"), some("issuer").alias("issuer"), shape.alias("shape")).agg(
        F.count("*").alias("domains"), F.count_if("probed").alias("probed"), F.count_if(F.col("body_hash") != "").alias("with_hash"), F.count_if("from_wildcard").alias("wildcards"),
        F.count_if(F.col("probe_error") != "").alias("errors"), F.count_if(F.col("prev_hash") != "").alias("changed"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    one = few.agg(*map(total, ("domains", "probed", "with_hash", "wildcards", "errors", "changed")), F.count_distinct("source").alias("sources"), F.count_distinct("issuer").alias("issuers"), F.count_distinct("shape").alias("error_shapes"))
    line = queue.agg(F.count("*").alias("queued"), F.min("due").alias("oldest_due"), F.count_if(F.col("due") <= now).alias("waiting"))
    return one.withColumn("__one", F.lit(1)).join(line.withColumn("__one", F.lit(1)), "__one").drop("__one")


def coverage_by_tld(records: DataFrame) -> DataFrame:
    return records.groupBy(tld("host").alias("tld")).agg(F.count("*").alias("hosts"), F.count_if("probed").alias("probed"), F.round(F.avg(F.col("probed").cast("int")), 6).alias("share"))


def coverage_by_age(records: DataFrame, now: Column) -> DataFrame:
    age = lambda s: F.col("first_seen") > now - F.make_dt_interval(secs=F.lit(s))
    bucket = F.when(age(3600), "hour").when(age(86_400), "day").otherwise("older")
    return records.groupBy(bucket.alias("age")).agg(F.count("*").alias("hosts"), F.round(F.avg(F.col("probed").cast("int")), 6).alias("share"))


def _doomed(unseen_before: Column | None, failed_before: Column | None, match: Column | None) -> Column:
    preds = [p for p in (None if unseen_before is None else unseen(unseen_before), None if failed_before is None else failed(failed_before), match) if p is not None]
    if not preds:
        raise ValueError("at least one rule is needed")
    return F.coalesce(all_of(*preds), F.lit(False))


def _in_scope(parent: str | None) -> Column:
    if parent is None:
        return F.lit(True)
    name = parent.strip().strip(".").lower()
    if not name:
        raise ValueError(f"no domain in {parent!r}")
    r = ".".join(reversed(name.split(".")))
    return (F.col("rev_host") == r) | F.col("rev_host").startswith(r + ".")


def prune_report(records: DataFrame, parent: str | None = None, unseen_before: Column | None = None, failed_before: Column | None = None, match: Column | None = None) -> DataFrame:
    """Dry run: rows in scope, and those that would go."""
    return under(records, parent).agg(F.count("*").alias("scanned"), F.count_if(_doomed(unseen_before, failed_before, match)).alias("matched"))


def prune_records(records: DataFrame, parent: str | None = None, unseen_before: Column | None = None, failed_before: Column | None = None, match: Column | None = None) -> DataFrame:
    """The survivors, by the predicate that the report counted."""
    return records.where(~(_in_scope(parent) & _doomed(unseen_before, failed_before, match)))


class Pruned(NamedTuple):
    """What a prune leaves; ``summary``: ``(part, before, kept, bytes)``, a row a table."""

    records: DataFrame
    queue: DataFrame
    dimensions: dict[str, DataFrame]
    summary: DataFrame


def prune_apply(records: DataFrame, queue: DataFrame, dimensions: dict[str, DataFrame], parent: str | None = None, unseen_before: Column | None = None, failed_before: Column | None = None, match: Column | None = None, values: dict[str, Column] | None = None) -> Pruned:
    """Prune records, then the queue and the dimensions of what no record refers to any more.

    The records are marked in one pass and stay, without the doomed ones, in one checkpoint, by
    which queue and dimensions are then swept; they are swept also where no record is doomed, so
    that a prune that was broken off leaves nothing for ever.  values: the Column that a
    dimension stands for, where it isn't the column of its name.
    """
    gone = _in_scope(parent) & _doomed(unseen_before, failed_before, match)
    marked = fixed(records.withColumn("__gone", gone))
    kept = marked.where("NOT __gone").drop("__gone")
    left = queue.join(kept.select("host"), "host", "left_semi").select(*KEY)
    swept = {name: sweep_dimension(d, kept.select((values or {}).get(name, F.col(name)).alias(name)), name) for name, d in dimensions.items()}
    n, none = F.count("*"), F.lit(None).cast("long").alias("bytes")
    size = F.coalesce(F.sum(F.octet_length("value")), F.lit(0))
    sums = [marked.agg(n.alias("before"), F.count_if(~F.col("__gone")).alias("kept")).select(F.lit("records").alias("part"), "before", "kept", none)]
    for part, old, new, b in [("queue", queue, left, None), *((name, dimensions[name], swept[name], size) for name in dimensions)]:
        both = [old.agg(n.alias("before"), *([b.alias("b")] if b is not None else [])).withColumn("one", F.lit(1)), new.agg(n.alias("kept"), *([b.alias("k")] if b is not None else [])).withColumn("one", F.lit(1))]
        sums.append(both[0].join(both[1], "one").select(F.lit(part).alias("part"), "before", "kept", none if b is None else (F.col("b") - F.col("k")).cast("long").alias("bytes")))
    return Pruned(kept, left, swept, reduce(DataFrame.unionByName, sums))
