"""Versioned Parquet tables behind a one-line pointer, and importing older records.

A version is a set of immutable Parquet folders; the pointer, swapped by rename, names
one version of records and queue together, so readers see the old pair or the new one.
Files are reached through Hadoop's file system, wherever the table lies.
"""

from __future__ import annotations

import json
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.functions.names import reverse_host

TARGET_BYTES = 128 << 20
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> dict:
    """The pointer's content; FileNotFoundError where there is no table."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/{POINTER}")):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(f"{path}/{POINTER}").first()[0])


def _swap(spark: SparkSession, path: str, state: dict) -> None:
    fs, at = _fs(spark, path)
    new = at(f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if new.toUri().getScheme() else spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, at(f"{path}/{POINTER}"), options)


def _sorted(records: DataFrame, files: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by rev_host, so that a domain is a few row groups."""
    n = files or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartitionByRange(n, "rev_host").sortWithinPartitions("rev_host")


def write_tables(path: str, records: DataFrame, queue: DataFrame | None = None, batch_id: int | None = None, files: int | None = None) -> int:
    """A new version of both tables in one swap; returns its number.  With ``batch_id`` a
    batch that the pointer already names is not written again."""
    spark = records.sparkSession
    try:
        old = current(spark, path)
    except FileNotFoundError:
        old = {"version": 0}
    if batch_id is not None and old.get("batch_id") is not None and old["batch_id"] >= batch_id:
        return old["version"]
    version, tag = old["version"] + 1, uuid.uuid4().hex[:8]
    state = {"version": version, "records": f"records-v{version}-{tag}", "batch_id": old.get("batch_id") if batch_id is None else batch_id}
    _sorted(records, files).write.parquet(f"{path}/{state['records']}")
    if queue is not None:
        state["queue"] = f"queue-v{version}-{tag}"
        queue.write.parquet(f"{path}/{state['queue']}")
    elif "queue" in old:
        state["queue"] = old["queue"]
    _swap(spark, path, state)
    return version


def write_records(records: DataFrame, path: str) -> int:
    return write_tables(path, records)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)['records']}")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    state = current(spark, path)
    if "queue" not in state:
        raise FileNotFoundError(f"{path}: no queue")
    return spark.read.parquet(f"{path}/{state['queue']}")


def snapshot_table(spark: SparkSession, path: str, to: str) -> int:
    """A copy of one version, landed by its pointer; the source may go on changing."""
    fs, at = _fs(spark, to)
    if fs.exists(at(f"{to}/{POINTER}")):
        raise FileExistsError(to)
    state = current(spark, path)
    queue = spark.read.parquet(f"{path}/{state['queue']}") if "queue" in state else None
    return write_tables(to, spark.read.parquet(f"{path}/{state['records']}"), queue)


def _bytes(spark: SparkSession, folder: str) -> int:
    fs, at = _fs(spark, folder)
    return fs.getContentSummary(at(folder)).getLength()


def compact_table(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rewrite into full files in key order; bytes before and after."""
    state = current(spark, path)
    before = _bytes(spark, f"{path}/{state['records']}")
    write_tables(path, read_records(spark, path), files=max(1, ceil(before / TARGET_BYTES)))
    return before, _bytes(spark, f"{path}/{current(spark, path)['records']}")


LEGACY = "host string, cn string, cert_name string, origin string, from_wildcard boolean, source string, issuer string, first_seen timestamp_ntz, last_seen timestamp_ntz, seen_count long, probed boolean, http_status int, body_hash string, _corrupt_record string"


def legacy_records(rows: DataFrame) -> DataFrame:
    """``(key, json)`` to records with ``skipped``: unreadable rows are flagged, not lost."""
    j = rows.select("key", F.from_json("json", LEGACY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    bad = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    text = lambda c: F.coalesce(F.nullif(F.col(f"j.{c}"), F.lit("")), F.lit(""))
    host = F.coalesce(F.nullif(F.col("j.host"), F.lit("")), "key")
    return j.select(
        host.alias("host"), reverse_host(host).alias("rev_host"), F.coalesce(F.nullif(F.col("j.cert_name"), F.lit("")), F.nullif(F.col("j.cn"), F.lit("")), F.lit("")).alias("cert_name"),
        text("origin").alias("origin"), F.coalesce("j.from_wildcard", F.lit(False)).alias("from_wildcard"), text("source").alias("source"), text("issuer").alias("issuer"),
        F.col("j.first_seen").alias("first_seen"), F.col("j.last_seen").alias("last_seen"), F.coalesce("j.seen_count", F.lit(0)).cast("long").alias("seen_count"), bad.alias("skipped"),
    )


def migrate_json_records(rows: DataFrame, path: str) -> tuple[int, int]:
    """Write the readable rows as a new table; (migrated, skipped).  Nothing readable, or a
    table already there, is an error."""
    spark = rows.sparkSession
    fs, at = _fs(spark, path)
    if fs.exists(at(path)):
        raise FileExistsError(path)
    made = legacy_records(rows)
    n, bad = made.agg(F.count_if(~F.col("skipped")), F.count_if("skipped")).first()
    if not n and bad:
        raise ValueError(f"none of {bad} records could be read")
    write_records(made.where("NOT skipped").drop("skipped"), path)
    return n, bad
