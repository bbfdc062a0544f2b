"""Each stream against its batch form, with its state and its timers."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostwatch.operators import feeds, filters
from hostwatch.operators.records import expand_cert
from hostwatch.streaming import jobs

T0 = datetime(2024, 1, 1)


def source(spark, tmp_path, batches, schema, name="src"):
    """A stream that gives one of ``batches`` a time, in their order."""
    top = f"{tmp_path}/{name}"
    os.makedirs(top)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-{k}")
        (part,) = [f for f in os.listdir(f"{tmp_path}/{name}-{k}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/{name}-{k}/{part}", f"{top}/{k}.parquet")
        os.utime(f"{top}/{k}.parquet", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(top)


def run(stream, tmp_path, name="out", mode="append"):
    """All that a stream gives, to the end of its input."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


NAMES = "idx long, parent string, host string, seen_at timestamp"


def test_parent_cap(spark, tmp_path):
    rng = random.Random(4)
    rows, i = [], 0
    for w in range(3):  # three windows; a host stays in its own
        for k in range(60):
            p = f"p{rng.randrange(4)}.com"
            h = rng.choice([f"h{w}-{rng.randrange(12)}.{p}"] * 6 + [p])
            rows.append((i, rng.choice([p, p, p, None]), h, T0 + timedelta(seconds=w * 1000 + k * 5)))
            i += 1
    rows.append((i, "end.com", "x.end.com", T0 + timedelta(hours=2)))
    batches = [rows[k : k + 30] for k in range(0, len(rows), 30)]
    stream = jobs.stream_parent_cap(source(spark, tmp_path, batches, NAMES), limit=3, window_seconds=600)
    got = {r.idx for r in run(stream, tmp_path, "cap").collect()}
    whole = spark.createDataFrame(rows, NAMES)
    assert got == {r.idx for r in filters.cap_per_parent(whole, limit=3, window_seconds=600).collect()}
    assert 60 < len(got) < 150
    # What the timers left: the last window's parent alone, and none of the hosts before.
    state = spark.read.format("statestore").option("stateVarName", "accepted").load(f"file://{tmp_path}/cp-cap").selectExpr("key.parent AS parent")
    assert {r.parent for r in state.collect()} <= {"end.com"}
    free = filters.cap_per_parent(whole, limit=0).count()
    assert free == len(rows) == run(jobs.stream_parent_cap(source(spark, tmp_path, batches, NAMES, "again"), limit=0), tmp_path, "all").count()


def test_parent_cap_known(spark, tmp_path):
    known = spark.createDataFrame([("k.p.com",)], "host string")
    rows = [(0, "p.com", "a.p.com", T0), (1, "p.com", "k.p.com", T0), (2, "p.com", "b.p.com", T0), (3, "p.com", "a.p.com", T0)]
    out = run(jobs.stream_parent_cap(source(spark, tmp_path, [rows], NAMES), limit=1, known=known), tmp_path, "known")
    assert {r.idx for r in out.collect()} == {0, 1, 3}


def test_recent_dedup(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(0, "p", "a", at(0)), (1, "p", "a", at(1)), (2, "p", "b", at(2))], [(3, "p", "a", at(5))], [(4, "p", "c", at(60))], [(6, "p", "d", at(61))], [(5, "p", "a", at(62))]]
    got = {r.idx for r in run(jobs.stream_recent_dedup(source(spark, tmp_path, batches, NAMES)), tmp_path, "recent").collect()}
    assert got in ({0, 2, 4, 5, 6}, {1, 2, 4, 5, 6})  # of equal ones any


def test_quiet_feeds(spark, tmp_path):
    """Silences at the start, between, at the end; one feed that never carries, one not listed."""
    every, schema = 60, "feed string, seen_at timestamp"
    checks = {"steady": range(0, 60), "stops": range(0, 20), "twice": [0, 1, 9, 10, 30], "late-start": [12, 13, 14, 40], "short-gaps": range(0, 60, 3)}
    rows = sorted((T0 + timedelta(seconds=c * every + 7 * k), f) for f, cs in checks.items() for c in cs for k in range(2))
    rows = [(f, t) for t, f in rows]
    listed = spark.createDataFrame([(f, T0) for f in [*checks, "never"]], schema.replace("seen_at", "since"))
    whole = spark.createDataFrame(rows, schema)
    want = sorted((r.feed, r.checked_at, r.kind, r.quiet_seconds) for r in feeds.quiet_feeds(whole, every, 3, listed).collect())
    assert [w[0] for w in want] == ["late-start", "late-start", "late-start", "never", "stops", "twice", "twice", "twice"]
    assert {w[2] for w in want if w[0] in ("never", "late-start")} == {"never_carried", "gone_quiet"}
    end = [("steady", T0 + timedelta(hours=3))]  # moves the watermark past the last check
    size = len(rows) // 5 + 1
    stream = jobs.stream_quiet_feeds(source(spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)] + [end, [("steady", T0 + timedelta(hours=3, minutes=1))]], schema), every, 3, listed)
    limit = T0 + timedelta(seconds=60 * every)
    got = sorted((r.feed, r.checked_at, r.kind, r.quiet_seconds) for r in run(stream, tmp_path, "quiet").collect())
    assert [g for g in got if g[1] < limit] == [w for w in want if w[1] < limit]
    assert len(got) == len(set(got)) and all(g[0] in ("steady", "short-gaps") for g in got if g[1] >= limit)


def test_quiet_feeds_batch(spark):
    rows = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(hours=5))], "feed string, seen_at timestamp_ntz")
    got = {(r.feed, r.kind, r.checked_at.hour) for r in feeds.quiet_feeds(rows, 3600, 3).collect()}
    assert got == {("a", "gone_quiet", 3), ("b", "never_carried", 2)}
    assert feeds.quiet_feeds(rows.limit(0), 3600, 3, spark.createDataFrame([("a",)], "feed string")).count() == 0


@pytest.mark.parametrize("stalled, windows", [("wait", 0), ("pass", 2)])
def test_union_with_a_stalled_feed(spark, tmp_path, stalled, windows):
    schema = "cert_id long, seen_at timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    going = source(spark, tmp_path, [[(1, at(0))], [(2, at(10))], [(3, at(20))]], schema, "going")
    stopped = source(spark, tmp_path, [[(9, at(0))]], schema, "stopped")
    before = spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    try:
        both = jobs.stream_union({"ctlog": going, "tiled": stopped}, {"ctlog": "1 minute"}, stalled=stalled)
        counts = both.groupBy(F.window("seen_at", "5 minutes"), "feed").agg(F.count("*").alias("n"))
        got = run(counts, tmp_path, f"union_{stalled}")
        assert got.select("window").distinct().count() == windows
        with pytest.raises(ValueError):
            jobs.stream_union({"ctlog": going}, {}, "other")
    finally:
        spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", before)


def test_live_counters(spark, tmp_path):
    """One pass gives the names and the counters; they equal the batch funnel's."""
    from tests.test_ingest import CERTS, certs

    data = certs(200)
    stream = source(spark, tmp_path, [data[:120], data[120:]], CERTS)
    listener = jobs.FunnelListener()
    spark.streams.addListener(listener)
    try:
        got = run(jobs.counted_names(filters.apply_san_policy(stream, most=1)), tmp_path, "counted")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    whole = filters.apply_san_policy(spark.createDataFrame(data, CERTS), most=1)
    assert got.count() == expand_cert(whole).count()
    from hostwatch.plans.fixtures import RULES

    funnel = filters.ingest_funnel(whole, spark.createDataFrame(RULES, "kind string, base string"), spark.createDataFrame([("blocked.dev",)], "suffix string"), spark.createDataFrame([], "host string")).first().asDict()
    assert listener.totals == {k: funnel[k] for k in ("certs", "names", "from_san", "skipped_cn", "sans_cut")}
    assert len(listener.reports) == 2 and funnel["sans_cut"] > 0
