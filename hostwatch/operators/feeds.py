"""Feed health: deliveries, quiet spells, sessions, answer rates and address budgets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.operators.ranks import before, fixed, placed

FEEDS = ("certstream", "ctlog", "tiled")


def union_feeds(feeds: dict[str, DataFrame], selection: str = "all") -> DataFrame:
    """The selected feeds as one; ``both`` is the two log feeds.  Unknown or none: an error."""
    names = list(feeds) if selection == "all" else ["certstream", "ctlog"] if selection == "both" else [x.strip() for x in selection.split(",") if x.strip()]
    if not names or any(n not in feeds for n in names):
        raise ValueError(f"no such feed in {selection!r}")
    return reduce(lambda a, b: a.unionByName(b), (feeds[n].withColumn("feed", F.lit(n)) for n in dict.fromkeys(names)))


def feed_counts(certs: DataFrame) -> DataFrame:
    return certs.groupBy("feed").agg(F.count("*").alias("delivered"))


def progress_counters(certs: DataFrame, every: str = "1 minute") -> DataFrame:
    """Deliveries per interval and feed; also a streaming aggregation."""
    return certs.groupBy(F.window("seen_at", every)["start"].alias("since"), "feed").agg(F.count("*").alias("delivered"))


def quiet_feeds(certs: DataFrame, every_seconds: int = 3600, n: int = 3, feeds: DataFrame | None = None) -> DataFrame:
    """Feeds with ``n`` empty checks in a row, once per spell; ``feeds``: those that should
    carry, so that one that never did is known.

    From each check with a delivery to the next one (or the last check of all) the silence
    between is arithmetic: rows grow with deliveries and feeds, not with feeds times checks.
    """
    slot = F.floor(F.unix_seconds(F.col("seen_at").cast("timestamp")) / every_seconds)
    counts = certs.groupBy("feed", slot.alias("b")).agg(F.lit(1).alias("one"))
    span = counts.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).withColumn("one", F.lit(1))
    every = counts.select("feed") if feeds is None else counts.select("feed").unionByName(feeds.select("feed"))
    # Each feed's time begins before the first check, with nothing carried yet.
    begins = every.distinct().select("feed", F.lit(None).cast("long").alias("b"), F.lit(1).alias("one"))
    after = F.lead("b").over(Window.partitionBy("feed").orderBy(F.asc_nulls_first("b")))
    gaps = counts.unionByName(begins).withColumn("after", after).join(F.broadcast(span), "one")
    told = F.coalesce("b", F.col("lo") - 1) + n
    quiet = gaps.where(told < F.coalesce("after", F.col("hi") + 1))
    return quiet.select("feed", F.timestamp_seconds(told * every_seconds).cast("timestamp_ntz").alias("checked_at"), F.when(F.col("b").isNull(), "never_carried").otherwise("gone_quiet").alias("kind"), F.lit((n - 1) * every_seconds).cast("long").alias("quiet_seconds"))


def feed_sessions(frames: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Connections: a gap of that length ends one; heartbeats keep it open but carry nothing."""
    s = frames.groupBy("feed", F.session_window(F.col("ts"), gap).alias("s")).agg(F.count("*").alias("frames"), F.count_if("is_cert").alias("certs"), F.max("ts").alias("last"))
    return s.select("feed", F.col("s.start").alias("start"), "last", "frames", "certs", F.when(F.col("certs") == 0, "sent_nothing").otherwise("went_quiet").alias("end_kind"))


def answer_rate(lookups: DataFrame, recent: int = 1024, least: int = 64, gap_seconds: int = 30) -> DataFrame:
    """Per lookup the resolver's share of answers over its recent ones since the last gap, and
    whether a failure is deferred (transient, at an unhealthy resolver) or recorded.

    All lookups stand in one order, cut into range partitions.  A partition numbers its rows
    and sums its answers; what the ones before it hold (rows, answers, the last row, the last
    gap) is a row a partition.  The share is then a difference of two running sums, the second
    found by its number.  So a resolver of any size spreads over all tasks.
    """
    rows = lookups.select("event_id", "resolver", "outcome", F.col("ts").cast("timestamp").alias("t"), F.col("outcome").isin("ok", "not_found").cast("long").alias("ok"))
    rows = placed(rows, "resolver", "t", "event_id")
    w = Window.partitionBy("part").orderBy("at")
    ends = rows.groupBy("part").agg(F.count("*").alias("c"), F.sum("ok").alias("a"), F.max_by(F.struct("resolver", "t"), "at").alias("end"))
    ends = before(ends, "c", "a").withColumn("end", F.lag("end").over(Window.orderBy("part")))
    last = F.coalesce(F.lag(F.struct("resolver", "t")).over(w), "end")
    gap = F.unix_micros("t") - F.unix_micros(last["t"]) > gap_seconds * 1_000_000
    rows = rows.join(F.broadcast(ends.select("part", "c_before", "a_before", "end")), "part")
    rows = rows.select("*", (F.col("c_before") + F.col("at")).alias("g"), (F.col("a_before") + F.sum("ok").over(w)).alias("sum"), F.coalesce(~last["resolver"].eqNullSafe(F.col("resolver")) | gap, F.lit(True)).alias("new"))
    # One more window in the same order, and a checkpoint: what follows reads the rows three times.
    rows = fixed(rows.withColumn("begin", F.max(F.when(F.col("new"), F.col("g"))).over(w)).select("event_id", "resolver", "ok", "part", "g", "sum", "begin"))
    begins = rows.groupBy("part").agg(F.max("begin").alias("begin"))
    carried = begins.select("part", F.max("begin").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.join(F.broadcast(carried), "part").withColumn("begin", F.coalesce("begin", "carried"))
    rows = rows.withColumn("samples", F.least(F.lit(recent), F.col("g") - F.col("begin") + 1))
    earlier = rows.select((F.col("g") + 1).alias("from"), F.col("sum").alias("sum_before"))
    rows = rows.join(earlier, F.col("g") - F.col("samples") + 1 == F.col("from"), "left")
    rate = (F.col("sum") - F.coalesce("sum_before", F.lit(0))) / F.col("samples")
    healthy = (F.col("samples") < least) | (rate >= 0.5)
    verdict = F.when(F.col("ok") == 1, "answered").when(~healthy, "deferred").otherwise("recorded")
    return rows.select("event_id", "resolver", "samples", F.round(rate, 6).alias("rate"), verdict.alias("verdict"))


def admit_per_address(requests: DataFrame, rate: float = 32.0, burst: float = 64.0) -> DataFrame:
    """``requests(req_id, ts, address)`` with ``admitted`` by a token bucket per address.

    One sequence per address, followed row by row in sorted partitions with two numbers of
    state, so an address of any size needs no memory.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = requests.select(F.col("req_id").cast("long"), F.col("ts").cast("timestamp_ntz"), "address").repartition(n, "address").sortWithinPartitions("address", "ts", "req_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        address, tokens, last = None, burst, None
        for b in batches:
            out = []
            for a, t in zip(b["address"], b["ts"]):
                if a != address:
                    address, tokens, last = a, burst, None
                if last is not None:
                    tokens = min(burst, tokens + (t - last).total_seconds() * rate)
                last = t
                ok = tokens >= 1
                tokens -= ok
                out.append(ok)
            yield b.assign(admitted=out)

    return dealt.mapInPandas(run, "req_id long, ts timestamp_ntz, address string, admitted boolean")
