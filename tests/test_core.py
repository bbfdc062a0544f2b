"""Golden cases and laws of the hostname operators."""

import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostwatch.functions import names as P
from hostwatch.functions.addresses import error_shape, is_public_address, render_error
from hostwatch.operators import filters, queue, records, reports
from hostwatch.sources import feeds as sources
from hostwatch.sources import tables


#: Made by rule: labels of every allowed kind joined under two ends, and one fault at a time put into a good name.
LABELS = ["q", "k7", "zeta-9", "x" * 63]
GOOD = [f"{a}.{b}.{end}" for a in LABELS for b in LABELS[:2] for end in ("museum", "xn--j6w193g")]
FAULTS = [lambda n: "-" + n, lambda n: n.replace(".", "-.", 1), lambda n: n.replace(".", "..", 1), lambda n: n + ":81", lambda n: "me@" + n, lambda n: n.replace(".", " of ", 1), lambda n: n + ".4", lambda n: "y" + "x" * 63 + "." + n, lambda n: ".".join(["abcdefg"] * 32) + "." + n, lambda n: n.replace(".", "_.", 1)]


def test_expand_name(spark):
    cases = {n: [n] for n in GOOD} | {f" {n.upper()}.": [n] for n in GOOD[:6]} | {f"ftp://{n}/x?y": [n] for n in GOOD[:6]}
    cases |= {"*." + n: [n, "www." + n] for n in GOOD} | {"*.www." + n: ["www." + n] for n in GOOD[:6]} | {"*.*." + n: [] for n in GOOD[:3]}
    cases |= {fault(n): [] for n in GOOD[:5] for fault in FAULTS} | dict.fromkeys(["", " ", "*", ".", "museum", "Some Root Authority", "203.0.113.77", "2001:db8:7::5"], [])
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", P.expand_name("c").alias("n")).collect()
    assert {r.c: [x.host for x in r.n] for r in got} == cases


def test_registrable(spark):
    from hostwatch.plans.fixtures import RULES

    cases = {"example.com": 0, "a.b.example.com": 2, "www.example.co.uk": 1, "example.com.br": 0, "example.somenewtld": 0, "co.uk": None, "com": None, "a.foo.ck": 0, "www.ck": 0}
    got = filters.registrable(spark.createDataFrame([(h,) for h in cases], "host string"), spark.createDataFrame(RULES, "kind string, base string"))
    assert {r.host: r.depth for r in got.collect()} == cases


def test_reverse_host(spark):
    for h in ("a.b.c", "..a", "a..", "", "x"):
        r = spark.createDataFrame([(h,)], "h string").select(P.reverse_host("h").alias("r"), P.reverse_host(P.reverse_host("h")).alias("b")).first()
        assert r.b == h and r.r == ".".join(reversed(h.split(".")))


def test_public_addresses(spark):
    # The edges of every range, from the ranges; the same addresses inside IPv6 forms.
    import ipaddress as ip

    from hostwatch.functions.addresses import NOT_PUBLIC_V4, NOT_PUBLIC_V6

    def edges(texts, size):
        nets = [ip.ip_network(n) for n in texts]
        kind = type(nets[0][0])
        points = {int(n[0]) + d for n in nets for d in (-1, 0)} | {int(n[-1]) + d for n in nets for d in (0, 1)}
        return {str(a): not any(a in n for n in nets) for a in (kind(i) for i in points if 0 <= i < 1 << size)}

    v4, v6 = edges(NOT_PUBLIC_V4, 32), edges(NOT_PUBLIC_V6, 128)
    forms = {}
    for a, public in v4.items():
        n = int(ip.IPv4Address(a))
        forms |= {f"::ffff:{a}": public, str(ip.IPv6Address((0x64FF9B << 96) + n)): public, str(ip.IPv6Address((0x2002 << 112) + (n << 80))): public}
    alone = {k: v for k, v in v6.items() if int(ip.IPv6Address(k)) >> 32}  # others are IPv4 in the compatible form
    cases = v4 | alone | forms | dict.fromkeys(["", "x", "7.7.7", "7.7.7.256", "7.7.7.7.7", "g::"], False)
    got = spark.createDataFrame([(k,) for k in cases], "ip string").select("ip", is_public_address("ip").alias("p")).collect()
    assert {r.ip: r.p for r in got} == cases


def test_public_addresses_beside_the_registries(spark):
    # Both ends of every IPv4 /16 and every 16th IPv6 /16, with the standard library's view of the registries.
    import ipaddress as ip

    counted_public = [ip.ip_network(n) for n in ("240.0.0.0/4", "100::/64", "2001::/23")]  # reserved, discard-only, protocol assignments
    nets = [ip.ip_network((n << 16, 16)) for n in range(1 << 16)] + [ip.ip_network((n << 112, 16)) for n in range(0, 1 << 16, 16)]
    ends = {a for n in nets for a in (n[0], n[-1])}
    public = lambda a: a != ip.ip_address("255.255.255.255") and (any(a in n for n in counted_public) or a.is_global and not a.is_multicast)
    got = spark.createDataFrame([(str(a),) for a in ends], "ip string").select("ip", is_public_address("ip").alias("p")).collect()
    assert {r.ip for r in got if r.p != public(ip.ip_address(r.ip))} == set()


def test_errors_round_trip(spark):
    h, public, private = "q.zeta.museum", ["46.1.2.3", "[2a02:7::9]", "199.7.8.9"], ["10.20.30.40"]
    cases = [(h, f"open {h}: " + " via ".join(f"{a}:99" for a in (public + private)[:k]) + f" after {k} tries", k) for k in range(5)]
    cases += [(public[0], f"open {public[0]}:99", 0), (h, "\x03kept\x02as\x01it stands 46.1.2.3", 1), (h, "[2A02:7::9] [::ffff:46.1.2.3] 046.1.2.3", 0), (h, "", 0)]
    rows = spark.createDataFrame(cases, "host string, msg string, n int").withColumn("e", error_shape("host", "msg"))
    for r in rows.withColumn("back", render_error("host", "e.shape", "e.args")).collect():
        assert r.back == r.msg
        assert "::ffff" in r.msg or len(r.e.args) == r.n, r


def test_retention_text():
    assert P.parse_retention("1d12h") == timedelta(hours=36)
    for bad in ("", "0d", "x", "100001d"):
        with pytest.raises(ValueError):
            P.parse_retention(bad)


def _names(spark, rows):
    return spark.createDataFrame([(i, h, False, f"raw{i}", o, datetime(2024, 1, 1, 0, i), "s", f"i{i % 2}", i) for i, (h, o) in enumerate(rows)], "cert_id long, host string, from_wildcard boolean, raw string, origin string, seen_at timestamp_ntz, source string, issuer string, idx long")


def test_merge_is_fold(spark):
    n = _names(spark, [("a.com", "san"), ("b.com", "cn"), ("a.com", "san"), ("a.com", "cn"), ("c.com", "san"), ("b.com", "san")])
    fold = lambda x: records.as_records(records.fold_sightings(x))
    whole = fold(n)
    merged = records.merge_records(fold(n.where("cert_id < 3")), fold(n.where("cert_id >= 3")))
    assert sorted(map(tuple, merged.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert {r.host for r in merged.where("is_new").collect()} == {"c.com"}


def test_lease_hides_and_returns(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    q = spark.createDataFrame([(t(1), "a"), (t(2), "b"), (t(3), "a"), (t(9), "c"), (t(2), "d")], "due timestamp_ntz, host string")
    leased, left = queue.lease_due(q, F.lit(t(5)), 2, 60)
    assert {r.host for r in leased.collect()} == {"a", "b"}
    assert sorted(map(tuple, left.collect())) == [(t(2), "d"), (t(3), "a"), (t(6), "a"), (t(6), "b"), (t(9), "c")]
    assert queue.lease_due(q, F.lit(t(5)), 0, 60)[0].count() == 0


def test_scope_errors(spark):
    with pytest.raises(ValueError):
        reports.under(spark.createDataFrame([("a",)], "rev_host string"), " . ")
    with pytest.raises(ValueError):
        reports.prune_records(spark.createDataFrame([("a",)], "rev_host string"))


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        tables.read_records(spark, path)
    rows = records.as_records(records.fold_sightings(_names(spark, [("b.com", "cn"), ("a.com", "cn")])))
    q = spark.createDataFrame([(datetime(2024, 1, 1), "a.com")], "due timestamp_ntz, host string")
    assert tables.write_tables(path, rows, q, 0) == 1 and tables.write_tables(path, rows.limit(0), q, 0) == 1
    assert tables.read_records(spark, path).count() == 2 and tables.read_queue(spark, path).count() == 1
    tables.compact_table(spark, path)
    tables.snapshot_table(spark, path, f"file://{tmp_path}/copy")
    assert [r.host for r in tables.read_records(spark, f"file://{tmp_path}/copy").orderBy("rev_host").collect()] == ["a.com", "b.com"]


def test_tile_framing():
    entry = bytes(8) + struct.pack(">H", 0) + b"\x00\x00\x03abc" + b"\x00\x00" + b"\x00\x00"
    assert sources.tile_entries(entry * 3) == [(b"abc", False)] * 3
    with pytest.raises(ValueError):
        sources.tile_entries(entry + b"\x00")
    assert sources.certificate(b"not der", False) is None


def test_entry_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
