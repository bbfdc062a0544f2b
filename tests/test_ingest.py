"""The ingest job against the batch operators, its replays, late rows and counters."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostwatch.operators import filters
from hostwatch.operators.records import expand_cert, fold_sightings
from hostwatch.plans.fixtures import RULES
from hostwatch.streaming import ingest

CERTS = "cert_id long, cn string, sans array<string>, issuer string, source string, idx long, seen_at timestamp_ntz"
T0 = datetime(2024, 1, 1)
R = ["host", "first_seen", "last_seen", "seen_count", "from_wildcard", "cert_name", "origin", "source", "issuer"]


def certs(n, start=0, seed=1, minutes=0.25):
    """In the order of time: many tenants of one parent, repeats, deep, blocked and odd names."""
    rng = random.Random(seed)
    out = []
    for i in range(start, start + n):
        tenant = f"t{rng.randrange(60)}.platform.com"
        cn = rng.choice([tenant, tenant, tenant, f"*.s{rng.randrange(9)}.org", f"a.b.deep{rng.randrange(5)}.net", "x.blocked.dev", "Some CA", "", "platform.com"])
        sans = [rng.choice([tenant, f"api.s{rng.randrange(9)}.org", "nonsense", "co.uk"]) for _ in range(rng.randrange(3))]
        out.append((i, cn, sans, rng.choice(["", "A", "B"]), f"log{i % 2}", i, T0 + timedelta(minutes=i * minutes)))
    return out


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(RULES, "kind string, base string").cache(), spark.createDataFrame([("blocked.dev",)], "suffix string").cache()


def batch_form(frame, rules, suffixes, limit, window_seconds):
    names = filters.filter_blocklist(filters.filter_depth(filters.with_registrable(expand_cert(frame), rules).withColumnRenamed("registrable", "parent"), 1), suffixes)
    passed = filters.filter_recent(names)
    capped = filters.cap_per_parent(passed, limit=limit, window_seconds=window_seconds)
    return names, passed, capped


def rows(df):
    return sorted(map(str, df.select(*R).collect()))


@pytest.mark.parametrize("limit", [0, 3])
def test_stream_equals_batch(spark, made, tmp_path, limit):
    rules, suffixes = made
    data = certs(900)
    for k in range(4):  # one file a batch, in the order of time
        spark.createDataFrame(data[k * 225 : (k + 1) * 225], CERTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in os.listdir(f"{tmp_path}/in/{k}"):
            if f.startswith("part"):
                os.makedirs(f"{tmp_path}/src", exist_ok=True)
                os.rename(f"{tmp_path}/in/{k}/{f}", f"{tmp_path}/src/{k}.parquet")
                os.utime(f"{tmp_path}/src/{k}.parquet", (1000 + k, 1000 + k))
    stream = spark.readStream.schema(CERTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    path = f"file://{tmp_path}/out"
    query = ingest.run_ingest(stream, path, rules, suffixes, f"file://{tmp_path}/cp", limit=limit, window_seconds=1800, buckets=8)
    query.awaitTermination()
    whole = spark.createDataFrame(data, CERTS)
    names, passed, capped = batch_form(whole, rules, suffixes, limit, 1800)
    got = ingest.read_ingested(spark, path)
    assert rows(got) == rows(fold_sightings(capped))
    queued = {(r.due, r.host) for r in ingest.read_ingested(spark, path, "queue").collect()}
    assert queued == {(r.first_seen, r.host) for r in got.collect()}
    counts = ingest.read_ingested(spark, path, "counters")
    assert counts.count() == 4
    total = counts.agg(*(F.sum(c).alias(c) for c in ingest.COUNTERS)).first().asDict()
    every = expand_cert(whole).count()
    stored = got.count()
    assert total["certs"] == 900 and total["names"] == every and total["late"] == 0
    assert total["names"] == sum(total[c] for c in ("too_deep", "blocked", "dup", "capped", "new", "repeat"))
    assert total["dup"] == names.count() - passed.count() and total["capped"] == passed.count() - capped.count()
    assert total["new"] == stored and total["repeat"] == capped.count() - stored
    assert limit == 0 or total["capped"] > 50
    assert total["skipped_cn"] == sum(c[1] == "Some CA" for c in data)
    # Judged rows that no later name can meet aren't carried on.
    assert len(os.listdir(f"{tmp_path}/out/judged")) == 2
    last = spark.read.parquet(f"{path}/judged")
    assert last.where("verdict = 'open'").agg(F.min("seen_at")).first()[0] > T0 + timedelta(minutes=60)


def job(path, made, **options):
    return ingest.Ingest(path, *made, "s", **{"buckets": 16, "limit": 5, **options})


def stamps(tmp_path, table):
    top = f"{tmp_path}/out/{table}"
    return {d: sorted(os.listdir(f"{top}/{d}")) for d in os.listdir(top) if d.startswith("bucket=")}


def test_rewrites_only_what_it_touches(spark, made, tmp_path):
    path = f"file://{tmp_path}/out"
    j = job(path, made)
    j.batch(spark.createDataFrame([(i, f"h{i}.com", [], "", "l", i, T0) for i in range(400)], CERTS), 0)
    before, queue = stamps(tmp_path, "records"), stamps(tmp_path, "queue")
    assert len(before) == 16
    few = spark.createDataFrame([(500 + i, f"h{i}.com", [], "", "l", i, T0 + timedelta(hours=1)) for i in range(2)], CERTS)
    j.batch(few, 1)
    after = stamps(tmp_path, "records")
    touched = {r.b for r in spark.createDataFrame([("h0.com",), ("h1.com",)], "h string").select(ingest.bucket_of(F.col("h"), 16).alias("b")).collect()}
    assert {d for d in after if after[d] != before[d]} == {f"bucket={b}" for b in touched}
    assert stamps(tmp_path, "queue") == queue  # no new host, no new entry
    got = ingest.read_ingested(spark, path)
    assert got.count() == 400 and got.where("seen_count = 2").count() == 2


def test_replays_change_nothing(spark, made, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    j = job(path, made)
    data = certs(300)
    first, second = spark.createDataFrame(data[:150], CERTS), spark.createDataFrame(data[150:], CERTS)
    j.batch(first, 0)
    # The second batch fails after some of its partitions were swapped in.
    real = ingest.Ingest._replace

    def half(self, frame, name, order):
        if name == "records":
            frame = frame.where("bucket % 2 = 0")
            real(self, frame, name, order)
            raise OSError("lost")
        real(self, frame, name, order)

    monkeypatch.setattr(ingest.Ingest, "_replace", half)
    with pytest.raises(OSError):
        j.batch(second, 1)
    monkeypatch.setattr(ingest.Ingest, "_replace", real)
    even = {d: f for d, f in stamps(tmp_path, "records").items() if int(d[7:]) % 2 == 0}
    j.batch(second, 1)
    assert even.items() <= stamps(tmp_path, "records").items()
    want, files = rows(ingest.read_ingested(spark, path)), stamps(tmp_path, "records")
    j.batch(second, 1)
    assert rows(ingest.read_ingested(spark, path)) == want and stamps(tmp_path, "records") == files
    _, _, capped = batch_form(spark.createDataFrame(data, CERTS), *made, 5, 600)
    assert want == rows(fold_sightings(capped))
    # Another stream's batch of the same number is no replay.
    ingest.Ingest(path, *made, "other", buckets=16).batch(spark.createDataFrame([(9999, "else.net", [], "", "l", 0, T0 + timedelta(days=1))], CERTS), 1)
    assert ingest.read_ingested(spark, path).where("host = 'else.net'").count() == 1


def test_late_rows(spark, made, tmp_path):
    """A late row lowers first_seen; it isn't judged, and in the funnel it is late only."""
    path = f"file://{tmp_path}/out"
    j = job(path, made, limit=1, delay="10 minutes")
    at = lambda m: T0 + timedelta(minutes=m)
    cert = lambda i, cn, m: (i, cn, [], "", f"l{i}", i, at(m))
    j.batch(spark.createDataFrame([cert(0, "a.p.com", 60), cert(1, "b.p.com", 61)], CERTS), 0)
    j.batch(spark.createDataFrame([cert(2, "a.p.com", 5), cert(3, "c.p.com", 6), cert(4, "a.p.com", 62), cert(5, "d.q.com", 52)], CERTS), 1)
    got = {r.host: (r.first_seen, r.last_seen, r.seen_count, r.source) for r in ingest.read_ingested(spark, path).collect()}
    assert got == {"a.p.com": (at(5), at(60), 2, "l0"), "c.p.com": (at(6), at(6), 1, "l3"), "d.q.com": (at(52), at(52), 1, "l5")}
    c = ingest.read_ingested(spark, path, "counters").where("batch_id = 1").first()
    assert (c.late, c.dup, c.capped, c.new, c["repeat"], c.names) == (2, 1, 0, 1, 0, 4)


def test_empty_and_odd_batches(spark, made, tmp_path):
    path = f"file://{tmp_path}/out"
    j = job(path, made)
    j.batch(spark.createDataFrame([], CERTS), 0)
    j.batch(spark.createDataFrame([(1, None, None, None, None, None, T0), (2, "", [None, "x.com"], None, None, None, None), (3, "y.com", None, None, "l", 1, T0)], CERTS), 1)
    assert {r.host for r in ingest.read_ingested(spark, path).collect()} >= {"y.com"}
    assert ingest.read_ingested(spark, path, "counters").agg(F.sum("certs")).first()[0] == 3
