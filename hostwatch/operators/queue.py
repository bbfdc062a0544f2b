"""The due-time-ordered work queue as a table of (due, host), a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_SECONDS = 30
KEY = ["due", "host"]


def enqueue(queue: DataFrame, items: DataFrame) -> DataFrame:
    return queue.select(*KEY).unionByName(items.select(*KEY)).dropDuplicates()


def release(queue: DataFrame, keys: DataFrame) -> DataFrame:
    return queue.join(keys.select(*KEY), KEY, "left_anti")


def lease_due(queue: DataFrame, now: Column, limit: int, lease_seconds: int) -> tuple[DataFrame, DataFrame]:
    """``(leased, new queue)``: the first ``limit`` distinct hosts due, in (due, host) order.

    Their entries before the cut leave the queue and each host comes back once at the end
    of its lease; later duplicates stay.  The order is found by a top-k over one row a host.
    """
    due = queue.where(F.col("due") <= now)
    first = due.groupBy("host").agg(F.min("due").alias("due")).orderBy("due", "host").limit(max(limit, 0))
    cut = first.agg(F.count("*").alias("n"), F.max(F.struct("due", "host")).alias("cut"))
    # One row; fewer hosts than the limit: no cut.  With limit 0 nothing is taken.
    taken = due.join(F.broadcast(cut), F.lit(limit > 0) & ((F.col("n") < limit) | (F.struct("due", "host") <= F.col("cut"))), "inner").select(*KEY)
    leased = first.select("host", "due")
    again = leased.select((now + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("due"), "host")
    return leased, enqueue(release(queue, taken), again)


def wants_fetch(records: DataFrame, now: Column, reprobe_seconds: int = 0) -> DataFrame:
    """Records never fetched, or fetched at least ``reprobe_seconds`` ago."""
    want = ~F.col("probed")
    if reprobe_seconds > 0:
        want = want | (F.col("probed_at") + F.make_dt_interval(secs=F.lit(reprobe_seconds)) <= now)
    return records.where(F.coalesce(want, F.lit(False)))


def sweep_queue(queue: DataFrame, records: DataFrame, now: Column, limit: int, lease_seconds: int, reprobe_seconds: int = 0) -> DataFrame:
    """``(host, due, action)`` of a leased batch: to_fetch or already_done."""
    leased, _ = lease_due(queue, now, limit, lease_seconds)
    want = wants_fetch(records, now, reprobe_seconds).select("host", F.lit(True).alias("__w"))
    return leased.join(want, "host", "left").select("host", "due", F.when(F.col("__w"), "to_fetch").otherwise("already_done").alias("action"))


def seed_queue(records: DataFrame, queue: DataFrame | None = None, reprobe_seconds: int = 0, due: Column | None = None) -> DataFrame:
    """Entries for records that have none: never fetched at first_seen, else at the refetch."""
    if due is None:
        again = F.col("probed_at") + F.make_dt_interval(secs=F.lit(reprobe_seconds)) if reprobe_seconds > 0 else F.lit(None).cast("timestamp_ntz")
        due = F.when(~F.col("probed"), F.col("first_seen")).otherwise(again)
    rows = records.select(due.alias("due"), "host").where("due IS NOT NULL")
    return rows if queue is None else rows.join(queue.select("host"), "host", "left_anti")


def requeue(fetches: DataFrame, reprobe_seconds: int = 0, due: Column | None = None) -> DataFrame:
    """What results put back: deferred ones soon, finished ones at the refetch; ``due``: a
    policy of one's own for the finished ones, null for never."""
    if due is not None:
        soon = F.col("fetched_at") + F.make_dt_interval(secs=F.lit(RETRY_SECONDS))
        return fetches.select(F.when(F.col("deferred_reason") != "", soon).otherwise(due).alias("due"), "host").where("due IS NOT NULL").dropDuplicates()
    seconds = F.when(F.col("deferred_reason") != "", F.lit(RETRY_SECONDS)).otherwise(F.lit(reprobe_seconds if reprobe_seconds > 0 else None).cast("int"))
    return fetches.select((F.col("fetched_at") + F.make_dt_interval(secs=seconds)).alias("due"), "host").where("due IS NOT NULL").dropDuplicates()


def orphan_queue_rows(queue: DataFrame, records: DataFrame) -> DataFrame:
    return queue.join(records.select("host"), "host", "left_anti").select(*KEY)


def prune_queue(queue: DataFrame, records: DataFrame) -> DataFrame:
    return queue.join(records.select("host"), "host", "left_semi").select(*KEY)
