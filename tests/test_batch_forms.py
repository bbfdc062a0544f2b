"""Ranks, answer rates, prune apply, SQL names and other forms against plain models."""

import ipaddress
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from hostwatch.functions import names as P
from hostwatch.functions.addresses import error_shape_v4
from hostwatch.operators import feeds, fetches, filters, logs, queue, ranks, records, reports
from hostwatch.plans import fixtures as X
from hostwatch.plans import queries

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def test_numbered_spreads_a_shared_prefix(spark):
    rows = spark.createDataFrame([("an error that all begin with " * 3 + f"{i:06d}",) for i in range(4000)], "v string")
    placed = ranks.placed(rows.repartition(7), "v")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    got = ranks.numbered(rows.repartition(7), "n", F.desc("v")).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == sorted((r.v for r in got), reverse=True)
    assert sorted(r.n for r in got) == list(range(4000))
    assert ranks.numbered(rows.limit(0), "n", "v").count() == 0


def test_build_dimension_keeps_ids(spark):
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "source string")
    first = records.build_dimension(make(["b", "a", "", "b", "é"]), "source")
    assert {r.value: r.id for r in first.collect()} == {"": 0, "a": 1, "b": 2, "é": 3}
    more = records.build_dimension(make(["c", "a", "A", None, "zz"]), "source", first)
    assert {r.value: r.id for r in more.collect()} == {"": 0, "a": 1, "b": 2, "é": 3, "A": 4, "c": 5, "zz": 6}


def model_rate(rows, recent, least, gap):
    out = {}
    for resolver in {r[1] for r in rows}:
        window, last = [], None
        for event, _, t, outcome in sorted((r for r in rows if r[1] == resolver), key=lambda r: (r[2], r[0])):
            if last is not None and (t - last).total_seconds() > gap:
                window = []
            last = t
            window = [*window, outcome in ("ok", "not_found")][-recent:]
            rate = sum(window) / len(window)
            out[event] = (len(window), round(rate, 6), "answered" if window[-1] else "deferred" if len(window) >= least and rate < 0.5 else "recorded")
    return out


def test_answer_rate(spark):
    rng = random.Random(1)
    rows, t = [], T0
    for i in range(6000):
        t += timedelta(seconds=rng.choice([0, 0, 1, 1, 2, 40 if i % 50 == 0 else 0]))
        good = 0.8 if (i // 500) % 2 else 0.25
        rows.append((i, rng.choice(["busy"] * 8 + ["r2", "r3", None]), t, rng.choice(["ok", "not_found"]) if rng.random() < good else rng.choice(["timeout", None])))
    frame = spark.createDataFrame(rows, "event_id long, resolver string, ts timestamp_ntz, outcome string").repartition(9)
    known = [(*r[:3], r[3] or "timeout") for r in rows]
    for recent, least in ((1024, 64), (10, 5)):
        frame2 = frame.withColumn("outcome", F.coalesce("outcome", F.lit("timeout")))
        got = {r.event_id: (r.samples, r.rate, r.verdict) for r in feeds.answer_rate(frame2, recent, least).collect()}
        want = model_rate(known, recent, least, 30)
        assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert len({v[2] for v in got.values()}) == 3
    assert feeds.answer_rate(frame.limit(0)).count() == 0


def test_answer_rate_busy_resolver_spreads(spark):
    rows = spark.range(8000).select(F.col("id").alias("event_id"), F.lit("one").alias("resolver"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("t"))
    sizes = [r["count"] for r in ranks.placed(rows, "resolver", "t", "event_id").groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 4000


def test_prune_apply(spark):
    r, q = X.records(spark, SF), X.queue(spark, SF)
    dims = {"issuer": records.build_dimension(r, "issuer"), "cert_name": records.build_dimension(r, "cert_name")}
    cut = F.expr("timestamp_ntz'2024-01-01 01:40:00'")
    made = reports.prune_apply(r, q, dims, parent="example.com", unseen_before=cut)
    kept = {x.host for x in made.records.collect()}
    assert kept == {x.host for x in reports.prune_records(r, "example.com", unseen_before=cut).collect()}
    assert {x.host for x in made.queue.collect()} == {x.host for x in q.collect()} & kept
    names = {x.cert_name for x in made.records.collect()} | {""}
    assert {x.value for x in made.dimensions["cert_name"].collect()} == names
    told = {x.part: (x.before, x.kept) for x in made.summary.collect()}
    assert told["records"] == (r.count(), len(kept)) and told["cert_name"][1] == len(names) and told["records"][0] > len(kept)


def test_prune_apply_sweeps_when_nothing_matches(spark):
    """What a prune that was broken off left behind goes with the next one."""
    r = X.records(spark, SF)
    left = spark.createDataFrame([(T0, "gone.example.com")], "due timestamp_ntz, host string")
    dims = {"issuer": spark.createDataFrame([(0, ""), (1, "CA1"), (9, "of no record")], "id long, value string")}
    made = reports.prune_apply(r, left, dims, unseen_before=F.lit(T0 - timedelta(days=900)).cast("timestamp_ntz"))
    told = {x.part: (x.before, x.kept, x.bytes) for x in made.summary.collect()}
    n = r.count()
    assert told == {"records": (n, n, None), "queue": (1, 0, None), "issuer": (3, 2, 12)}
    with pytest.raises(ValueError):
        reports.prune_apply(r, left, dims)


def test_sql_names(spark):
    P.register(spark)
    cases = ["*.Example.com.", "www.example.com", "*.www.a.org", "https://x.org/p?q", "not a name", "", None, "a.1", "*.b.net", " c.xn--p1ai "]
    rows = spark.createDataFrame([(c, "b.net", f"dial b.net 46.1.2.{i}: x\x02\x03 10.0.0.300") for i, c in enumerate(cases)], "c string, host string, msg string")
    rows.createOrReplaceTempView("sql_names")
    got = spark.sql("SELECT expand_name(c) n, cert_shape(host, c) s, error_shape(host, msg) e, error_shape('', msg).shape f FROM sql_names").collect()
    want = rows.select(P.expand_name("c").alias("n"), P.cert_shape("host", "c").alias("s"), error_shape_v4("host", "msg").alias("e"), error_shape_v4(F.lit(""), "msg")["shape"].alias("f")).collect()
    assert got == want
    hosts = spark.sql("SELECT n.host FROM (SELECT explode(ns) n FROM (SELECT expand_name(c) ns FROM sql_names)) WHERE n.from_wildcard").collect()
    assert {r.host for r in hosts} == {"example.com", "www.example.com", "www.a.org", "b.net", "www.b.net"}
    assert sum(r.s == "wild_host" for r in got) == 1


def test_fetchable_addresses(spark):
    rows = [(1, ["10.0.0.1", "fd00::1", "2606:4700::1", "8.8.8.8"]), (2, ["::1"]), (3, []), (4, None), (5, ["8.8.4.4", "x", "", "2002:0a00:0001::"]), (6, ["2606:4700::1", "2606:4700::1"])]
    got = {r.id: (r.addrs, r.refused, r.budget_key) for r in fetches.fetchable_addresses(spark.createDataFrame(rows, "id int, addrs array<string>")).collect()}
    assert got == {1: (["2606:4700::1", "8.8.8.8"], False, "2606:4700::1"), 2: ([], True, None), 3: ([], True, None), 4: (None, True, None), 5: (["8.8.4.4"], False, "8.8.4.4"), 6: (["2606:4700::1"] * 2, False, "2606:4700::1")}


def test_fetchable_addresses_v6_of_large_ids(spark, tmp_path):
    """Ids of more than four hex digits, against the registered SQL."""
    ids = [0, 65535, 65536, 65537, 99999, 0xFFFFFFF, (1 << 32) + 1, (1 << 63) - 1]
    spark.createDataFrame([(i, 1, "view", T0) for i in ids], "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.Q["fetchable_addresses_v6"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = db.execute(queries.S["fetchable_addresses_v6"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_plan_log_reads_deals_long_logs(spark):
    """Two long logs in two rows: no range is lost, and no task unfolds more than its share."""
    n = 3 * 1_000_000
    heads = spark.createDataFrame([("a", "rfc6962", n * 64 - 1), ("b", "tiled", n * 256 - 1), ("c", "tiled", 10), ("d", "rfc6962", 10)], "log string, kind string, tree_size long").coalesce(1)
    was = spark.createDataFrame([("a", 5), ("b", 300), ("c", 10), ("d", 3)], "log string, pos long")
    plan = logs.plan_log_reads(heads, was)
    got = {r.log: tuple(r)[1:] for r in plan.groupBy("log").agg(F.count("*"), F.min("first"), F.max("last"), F.sum(F.col("last") - F.col("first") + 1), F.max_by("path", "first")).collect()}
    assert got == {
        "a": (n, 5, n * 64 - 2, n * 64 - 6, None), "b": (n - 1, 300, n * 256 - 2, n * 256 - 301, f"tile/data/x00{(n - 1) // 1_000_000}/x{(n - 1) // 1000 % 1000:03}/{(n - 1) % 1000:03}.p/255"), "d": (1, 3, 9, 7, None),
    }
    tasks = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 3 and max(tasks) < 3_000_000


def test_plan_log_reads_deals_like_places(spark, monkeypatch):
    """A task of long logs has the same stretch of many of them, so that its file names few places; no range is lost."""
    monkeypatch.setattr(logs, "TASK", 1 << 14)
    heads = spark.createDataFrame([(f"log{i}", "tiled" if i % 2 else "rfc6962", 8192 * (256 if i % 2 else 64) + i) for i in range(40)], "log string, kind string, tree_size long").coalesce(1)
    plan = logs.plan_log_reads(heads, spark.createDataFrame([], "log string, pos long"), from_start=True)
    tasks = plan.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("first").alias("places")).collect()
    assert sum(t.n for t in tasks) == 40 * 8192 + 39 and max(t.n for t in tasks) < 3 << 14
    assert max(t.places for t in tasks) <= 4 * 1024, tasks
    got = plan.groupBy("log").agg(F.count("*").alias("n"), F.count_distinct("first").alias("firsts"), F.sum(F.col("last") - F.col("first") + 1).alias("size"))
    assert {(r.log, r.n, r.firsts, r["size"]) for r in got.collect()} == {(f"log{i}", n, n, 8192 * (256 if i % 2 else 64) + i) for i in range(40) for n in [8192 + (i > 0)]}


def test_requeue_policy(spark):
    rows = spark.createDataFrame([("a", T0, ""), ("b", T0, "address_budget"), ("c", T0, "")], "host string, fetched_at timestamp_ntz, deferred_reason string")
    due = F.when(F.col("host") == "a", F.col("fetched_at") + F.expr("INTERVAL 1 DAY"))
    assert {(r.due, r.host) for r in queue.requeue(rows, due=due).collect()} == {(T0 + timedelta(days=1), "a"), (T0 + timedelta(seconds=30), "b")}


def test_fetch_funnel_backfilled(spark):
    f = spark.createDataFrame([(1, "a", T0, 200, "", "x", "", "")], "fetch_id long, host string, fetched_at timestamp_ntz, status int, final_url string, body string, error string, deferred_reason string")
    r = X.first_records(spark, SF)
    swept = spark.createDataFrame([("a", "to_fetch"), ("b", "already_done"), ("c", "to_fetch")], "host string, action string")
    assert fetches.fetch_funnel(f, r, swept).first().backfilled == 2 and fetches.fetch_funnel(f, r).first().backfilled == 0


def test_public_suffix_file(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// a comment\n\ncom\n co.uk \n*.ck\n!www.ck // told\nCOM\n")
    got = {(r.kind, r.base) for r in filters.load_public_suffixes(spark, f"file://{tmp_path}/rules.dat").collect()}
    assert got == {("e", "com"), ("e", "co.uk"), ("w", "ck"), ("x", "www.ck")}


def test_get_record(spark):
    rows = spark.createDataFrame([("a.com", 1)], "host string, n int")
    assert records.get_record(rows, "A.com").n == 1
    with pytest.raises(KeyError):
        records.get_record(rows, "b.com")


def test_public_ranges_by_the_registry(spark):
    """Truth from the standard library's registry, but for the ranges on which the rule differs:
    documentation and reserved blocks are public to it, and multicast is not."""
    from hostwatch.functions.addresses import is_public_address

    rng = random.Random(8)
    ips = {str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(3000)}
    ips |= {f"{a}.{b}.{c}.{d}" for a, b in ((10, 0), (100, 64), (100, 127), (100, 128), (127, 0), (169, 254), (172, 15), (172, 16), (172, 31), (172, 32), (192, 167), (192, 168), (198, 17), (198, 18), (198, 19), (198, 20), (1, 1)) for c in (0, 255) for d in (0, 255)}
    differs = [ipaddress.ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "192.88.99.0/24", "192.0.0.0/24")]
    want = {}
    for x in ips:
        a = ipaddress.ip_address(x)
        if not any(a in n for n in differs):
            want[x] = a.is_global and not a.is_multicast
    got = spark.createDataFrame([(x,) for x in want], "ip string").select("ip", is_public_address("ip").alias("p")).collect()
    assert {r.ip: r.p for r in got} == want


@pytest.mark.parametrize("options", [{}, {"limit": 2, "window_seconds": 1800}, {"limit": 0, "max_depth": 0}])
def test_funnel_counts_the_verdicts(spark, options):
    """The counters equal those of the rows' verdicts; a hot parent, stored hosts, names of none."""
    from tests.test_ingest import CERTS, certs

    frame = spark.createDataFrame(certs(600) + [(9000, None, None, None, None, None, T0)], CERTS)
    rules, bad = spark.createDataFrame(X.RULES, "kind string, base string"), spark.createDataFrame([("blocked.dev",)], "suffix string")
    stored = spark.createDataFrame([("t3.platform.com",), ("s1.org",)], "host string")
    one = filters.ingest_funnel(frame, rules, bad, stored, **options).first().asDict()
    rows = filters.verdicts(frame, rules, bad, stored, **options)
    kinds = ("too_deep", "blocked", "dup", "capped", "new", "repeat")
    want = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    assert {k: one[k] for k in kinds} == {k: want.get(k, 0) for k in kinds}
    assert one["names"] == sum(want.values()) and one["certs"] == 601
    assert options or one["dup"] > 20
