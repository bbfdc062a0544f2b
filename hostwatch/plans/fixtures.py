"""The engine's inputs derived from the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.operators.fetches import fold_fetches
from hostwatch.operators.queue import seed_queue
from hostwatch.operators.records import as_records, expand_cert, fold_sightings

#: The url's host for a third of the pages, which stay few and hot; the others have one of their own.
HOST = "concat(CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('n', cast(page_id AS string), '.') END, regexp_replace(regexp_replace(url, '^.*?://', ''), '[/?#].*$', ''))"
RULES = [("e", x) for x in ("com", "net", "org", "test", "dev", "uk", "co.uk", "br", "com.br")] + [("w", "ck"), ("x", "www.ck")]
BLOCKED = ["cheap-pills.example.com", "spam-farm.example.org", "workers.dev"]
NOW = "2024-01-02 03:00:00"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def certs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").withColumn("h", F.expr(HOST)).selectExpr(
        "page_id AS cert_id", "CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 3 = 0 THEN concat('*.', h) ELSE url END AS cn",
        "array(h, concat('*.', h), concat('api.', h), 'DigiCert Root CA', '192.0.2.1') AS sans", "CASE WHEN page_id % 7 = 0 THEN '' ELSE concat('CA', cast(page_id % 4 AS string)) END AS issuer",
        "concat('log', cast(page_id % 3 AS string)) AS source", "page_id AS idx", "timestampadd(MINUTE, page_id, timestamp_ntz'2024-01-01 00:00:00') AS seen_at",
    )


def fetches(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").withColumn("h", F.expr(HOST)).selectExpr(
        "page_id AS fetch_id", "h AS host", "timestampadd(MINUTE, page_id, timestamp_ntz'2024-01-02 00:00:00') AS fetched_at",
        "CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status",
        "CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 4 = 0 THEN concat('https://', h, '/landing') ELSE concat('https://', h, '/') END AS final_url",
        "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 2 = 0 THEN concat('tpl', cast(page_id % 6 AS string)) ELSE html END AS body",
        "CASE WHEN page_id % 11 = 0 THEN concat('Get \"https://', h, '/\": dial tcp 46.28.109.', cast(page_id % 200 AS string), ':443: connect: connection refused') ELSE '' END AS error",
        "CASE WHEN page_id % 13 = 0 THEN 'address_budget' WHEN page_id % 17 = 0 THEN 'no_dns_answer' ELSE '' END AS deferred_reason",
    )


def names(spark: SparkSession, d: str) -> DataFrame:
    return expand_cert(certs(spark, d))


def first_records(spark: SparkSession, d: str) -> DataFrame:
    return as_records(fold_sightings(names(spark, d)))


def records(spark: SparkSession, d: str) -> DataFrame:
    return fold_fetches(first_records(spark, d), fetches(spark, d))


def queue(spark: SparkSession, d: str) -> DataFrame:
    return seed_queue(records(spark, d), reprobe_seconds=3600)


def events(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def feed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id", "event_type AS feed", "ts AS seen_at")


def sparse_feed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id", "concat('feed', cast(user_id AS string)) AS feed", "ts AS seen_at")


def lookups(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id", "concat('r', cast(user_id % 4 AS string)) AS resolver", "ts", "CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'not_found' ELSE 'ok' END AS outcome")


def requests(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id AS req_id", "ts", "concat('203.0.113.', cast(user_id % 10 AS string)) AS address")


def parent_hosts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id AS idx", "ts AS seen_at", "concat('p', cast(user_id % 20 AS string), '.com') AS parent",
        "CASE WHEN event_id % 10 = 0 THEN concat('p', cast(user_id % 20 AS string), '.com') ELSE concat('h', cast(event_id % 97 AS string), '.p', cast(user_id % 20 AS string), '.com') END AS host")


def heads(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").selectExpr("concat('https://ct.example/', cast(s_suppkey AS string)) AS log", "CASE WHEN s_suppkey % 2 = 0 THEN 'rfc6962' ELSE 'tiled' END AS kind", "cast(s_suppkey * 100 + 37 AS bigint) AS tree_size")


def positions(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").where("s_suppkey % 5 <> 0").selectExpr("concat('https://ct.example/', cast(s_suppkey AS string)) AS log", "cast(CASE s_suppkey % 5 WHEN 1 THEN s_suppkey * 100 + 37 WHEN 2 THEN s_suppkey * 100 + 99 ELSE s_suppkey * 50 END AS bigint) AS pos")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "kind string, base string")


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in BLOCKED], "suffix string")


# --- The same in DuckDB, as common table expressions. ---

_VALID = r"regexp_full_match({0}, '(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:xn--(?:[a-z0-9-]{{0,58}}[a-z0-9])|[a-z]{{2,63}})') AND length({0}) <= 253"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\.$', ''), '^.*?://', ''), '[/?#].*$', ''), '\.$', '')"
S_CERTS = f"""certs AS (SELECT page_id cert_id, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 3 = 0 THEN '*.' || h ELSE url END cn, [h, '*.' || h, 'api.' || h, 'DigiCert Root CA', '192.0.2.1'] sans,
 CASE WHEN page_id % 7 = 0 THEN '' ELSE 'CA' || (page_id % 4) END issuer, 'log' || (page_id % 3) source, page_id idx, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) seen_at FROM (SELECT *, {HOST} h FROM pages))"""
S_NAMES = f"""{S_CERTS}, raws AS (SELECT cert_id, seen_at, source, issuer, idx, cn raw, 'cn' origin, 0 pos FROM certs UNION ALL SELECT cert_id, seen_at, source, issuer, idx, sans[i], 'san', i FROM certs, range(1, 6) t(i)),
 normed AS (SELECT *, CASE WHEN n LIKE '*.%' THEN n[3:] ELSE n END b, n LIKE '*.%' w FROM (SELECT *, {_NORM.format("raw")} n FROM raws)),
 spread AS (SELECT *, b host, 0 k FROM normed WHERE {_VALID.format("b")} UNION ALL SELECT *, 'www.' || b, 1 FROM normed WHERE w AND b NOT LIKE 'www.%' AND {_VALID.format("b")}),
 names AS (SELECT cert_id, host, w from_wildcard, raw, origin, seen_at, source, issuer, idx, pos FROM (SELECT *, row_number() OVER (PARTITION BY cert_id, host ORDER BY origin, pos, k) r FROM spread) WHERE r = 1)"""
S_FOLD_OF = """folded AS (SELECT host, min(seen_at) first_seen, max(seen_at) last_seen, count(*) seen_count, min_by(from_wildcard, ord) from_wildcard,
 coalesce(min_by(raw, ord) FILTER (WHERE origin = 'cn'), min_by(raw, ord)) cert_name, CASE WHEN count(*) FILTER (WHERE origin = 'cn') > 0 THEN 'cn' ELSE 'san' END origin, max_by(source, ord) source,
 coalesce(max_by(issuer, ord) FILTER (WHERE issuer <> ''), '') issuer FROM (SELECT *, struct_pack(a := seen_at, b := source, c := idx) ord FROM {0}) GROUP BY host)"""
S_FOLD = f"{S_NAMES}, {S_FOLD_OF.format('names')}"
S_FETCHES = f"""fetches AS (SELECT page_id fetch_id, h host, TIMESTAMP '2024-01-02 00:00:00' + to_minutes(page_id) fetched_at, CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 9 = 0 THEN 404 ELSE 200 END status,
 CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 4 = 0 THEN 'https://' || h || '/landing' ELSE 'https://' || h || '/' END final_url, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'tpl' || (page_id % 6) ELSE html END body,
 CASE WHEN page_id % 11 = 0 THEN 'Get "https://' || h || '/": dial tcp 46.28.109.' || (page_id % 200) || ':443: connect: connection refused' ELSE '' END error,
 CASE WHEN page_id % 13 = 0 THEN 'address_budget' WHEN page_id % 17 = 0 THEN 'no_dns_answer' ELSE '' END deferred_reason FROM (SELECT *, {HOST} h FROM pages))"""
S_CHANGES = f"""{S_FETCHES}, done AS (SELECT *, CASE WHEN error = '' THEN coalesce(sha256(body), '') ELSE '' END hash, CASE WHEN error = '' THEN coalesce(strlen(body), 0) ELSE 0 END size FROM fetches WHERE deferred_reason = ''),
 changes AS (SELECT host, fetched_at changed_at, prev prev_hash, hash body_hash, fetch_id FROM (SELECT *, lag(hash) OVER (PARTITION BY host ORDER BY fetched_at, fetch_id) prev FROM done WHERE hash <> '') WHERE prev <> hash)"""
S_RECORDS = f"""{S_FOLD}, {S_CHANGES}, lasts AS (SELECT host, count(*) n, max(fetched_at) last_at, max_by(status, ord) status, max_by(final_url, ord) url, max_by(error, ord) err, max_by(size, ord) FILTER (WHERE error = '') size,
 max_by(hash, ord) FILTER (WHERE hash <> '') hash FROM (SELECT *, struct_pack(a := fetched_at, b := fetch_id) ord FROM done) GROUP BY host),
 lastchange AS (SELECT host, max_by(prev_hash, struct_pack(a := changed_at, b := fetch_id)) prev, max(changed_at) last_at FROM changes GROUP BY host),
 records AS (SELECT f.host, f.first_seen, f.last_seen, f.seen_count, f.from_wildcard, f.cert_name, f.origin, f.source, f.issuer, array_to_string(list_reverse(string_split(f.host, '.')), '.') rev_host, l.n IS NOT NULL probed, l.last_at probed_at,
 coalesce(l.status, 0) http_status, coalesce(l.url, '') final_url, coalesce(l.size, 0) body_size, coalesce(l.hash, '') body_hash, coalesce(c.prev, '') prev_hash, c.last_at changed_at, coalesce(l.n, 0) probe_count, coalesce(l.err, '') probe_error
 FROM folded f LEFT JOIN lasts l ON l.host = f.host LEFT JOIN lastchange c ON c.host = f.host)"""
S_QUEUE = f"""{S_RECORDS}, queue AS (SELECT CASE WHEN NOT probed THEN first_seen ELSE probed_at + INTERVAL 3600 SECOND END due, host FROM records)"""
S_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{b}')" for k, b in RULES) + ") t(kind, base))"
S_BLOCK = "blocklist AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}')" for b in BLOCKED) + ") t(suffix))"
S_REG = f"""{S_NAMES}, {S_RULES}, labels AS (SELECT DISTINCT host, string_split(host, '.') ls FROM names), parts AS (SELECT host, len(ls) n, i, array_to_string(ls[i + 1:], '.') base FROM labels, range(0, 12) t(i) WHERE i < len(ls)),
 sizes AS (SELECT host, n, kind, CASE kind WHEN 'e' THEN n - i WHEN 'w' THEN CASE WHEN i > 0 THEN n - i + 1 END WHEN 'x' THEN n - i - 1 END s FROM parts LEFT JOIN rules USING (base)),
 ks AS (SELECT host, n, coalesce(max(s) FILTER (WHERE kind = 'x'), max(s) FILTER (WHERE kind <> 'x'), 1) k FROM sizes GROUP BY 1, 2),
 reg AS (SELECT host, CASE WHEN n > k THEN array_to_string(string_split(host, '.')[n - k:], '.') END registrable, CAST(CASE WHEN n > k THEN n - k - 1 END AS INT) depth FROM ks)"""
S_EVENTS = """feed AS (SELECT event_id, event_type feed, CAST(ts AS TIMESTAMP) seen_at FROM events), sparse AS (SELECT event_id, 'feed' || user_id feed, CAST(ts AS TIMESTAMP) seen_at FROM events),
 lookups AS (SELECT event_id, 'r' || (user_id % 4) resolver, CAST(ts AS TIMESTAMP) ts, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'not_found' ELSE 'ok' END outcome FROM events),
 requests AS (SELECT event_id req_id, CAST(ts AS TIMESTAMP) ts, '203.0.113.' || (user_id % 10) address FROM events),
 parents AS (SELECT event_id idx, CAST(ts AS TIMESTAMP) seen_at, 'p' || (user_id % 20) || '.com' parent, CASE WHEN event_id % 10 = 0 THEN 'p' || (user_id % 20) || '.com' ELSE 'h' || (event_id % 97) || '.p' || (user_id % 20) || '.com' END host FROM events),
 heads AS (SELECT 'https://ct.example/' || s_suppkey log, CASE WHEN s_suppkey % 2 = 0 THEN 'rfc6962' ELSE 'tiled' END kind, CAST(s_suppkey * 100 + 37 AS BIGINT) tree_size FROM supplier),
 positions AS (SELECT 'https://ct.example/' || s_suppkey log, CAST(CASE s_suppkey % 5 WHEN 1 THEN s_suppkey * 100 + 37 WHEN 2 THEN s_suppkey * 100 + 99 ELSE s_suppkey * 50 END AS BIGINT) pos FROM supplier WHERE s_suppkey % 5 <> 0)"""
