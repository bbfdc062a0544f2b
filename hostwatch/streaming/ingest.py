"""The ingest job: a stream of certificates into records and the queue, judged on the way.

Both tables are Parquet partitioned by a hash of the host, so a batch reads and rewrites the
partitions of its own hosts and no others.  A batch that comes again after a failure changes
nothing more: partitions name the last batch folded into them, records the batch that made
them, and the judgement depends on what was there before the batch alone.  Under ``path``:

* ``records/bucket=b``: records with ``first_batch`` and ``batch_id``; ``queue/bucket=b``.
* ``judged/seq=n``: the batch's names with their verdicts, and the rows of earlier batches that
  still bear on later ones.  Rows of windows that the watermark has passed are not carried on.
* ``names/seq=n``, while a batch runs: its names that aren't too deep or blocked.
* ``counters/seq=n``: one row a batch: the funnel, late names and the greatest seen_at.

Late data: a name older than the watermark (the greatest seen_at of earlier batches less
``delay``) is folded into its record, whose first_seen it may lower, but not judged: it neither
opens nor fills a window, and is counted as late and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostwatch.operators.filters import ORDER_COLUMNS, blocked_hosts, flagged_names, registrable
from hostwatch.operators.records import NAMES, as_records, fold_sightings, merge_records

BUCKETS = 256
COUNTERS = ("certs", "names", "from_san", "skipped_cn", "sans_cut", "too_deep", "blocked", "dup", "capped", "new", "repeat", "late")
_CARRIED = [*NAMES, "parent", "anchor"]


def bucket_of(host: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(buckets)).cast("int")


def _cap(limit: int, span: pd.Timedelta):
    """Rows sorted by parent, those of earlier batches first: ``ok``, and the window that a
    host was charged to.  State: a window's start and count, and the parent's accepted hosts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent, start, n, accepted = None, None, 0, set()
        for b in batches:
            oks, anchors = [], []
            for p, h, t, before, anchor in zip(b["parent"], b["host"], b["seen_at"], b["before"], b["anchor"]):
                if p != parent:
                    parent, start, n, accepted = p, None, 0, set()
                charged = None
                if before:
                    start, n = anchor, n + 1 if anchor == start else 1
                    accepted.add(h)
                elif h not in accepted:
                    if start is None or t - start >= span:
                        start, n = t, 0
                    if n < limit:
                        n, charged = n + 1, start
                        accepted.add(h)
                oks.append(h in accepted)
                anchors.append(charged)
            yield b.assign(ok=oks, anchor=pd.Series(anchors, index=b.index, dtype=b["anchor"].dtype))[~b["before"].astype(bool)]

    return run


def judge(names: DataFrame, carried: DataFrame, known: DataFrame, late_before=None, recent: str = "10 minutes", limit: int = 20, window_seconds: int = 600) -> DataFrame:
    """``names`` (NAMES and parent) to the rows that count, with ``verdict`` (late, dup, capped,
    new, repeat), ``times`` (names that the row stands for) and ``anchor``.

    carried: rows of earlier batches (with anchor, null where not charged).  known: hosts that
    had a record before the batch.  A host costs a row a task and window, however often it is
    seen; of the cap's rows a parent's go one by one through a task, in their order.
    """
    columns, none = [*NAMES, "parent"], F.lit(None).cast("timestamp_ntz")
    late = F.lit(False) if late_before is None else F.col("seen_at") < F.lit(late_before)
    seen = names.where(~late).select(*columns, F.lit(False).alias("before")).unionByName(carried.select(*columns, F.lit(True).alias("before")))
    first = seen.groupBy("host", F.window("seen_at", recent)["start"].alias("w")).agg(F.min_by(F.struct(*columns), F.struct(~F.col("before"), *ORDER_COLUMNS)).alias("x"), F.bool_or("before").alias("before"), F.count_if(~F.col("before")).alias("n")).where("n > 0")
    dups = first.select("x.*", none.alias("anchor"), F.lit("dup").alias("verdict"), (F.col("n") - F.when(F.col("before"), 0).otherwise(1)).alias("times")).where("times > 0")
    rows = first.where("NOT before").select("x.*").join(known.select("host").distinct().withColumn("known", F.lit(True)), "host", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    free = F.coalesce(F.col("host") == F.col("parent"), F.lit(True)) | F.col("known") | F.lit(limit <= 0)
    passed = rows.where(free).withColumns({"anchor": none, "ok": F.lit(True)})
    if limit > 0:
        n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        charged = rows.where(~free).withColumns({"anchor": none, "before": F.lit(False)})
        open_ = carried.where("anchor IS NOT NULL").withColumns({"known": F.lit(True), "before": F.lit(True)}).select(*charged.columns)
        dealt = charged.unionByName(open_).repartition(n, "parent").withColumn("order", F.when(F.col("before"), F.col("anchor")).otherwise(F.col("seen_at"))).sortWithinPartitions("parent", F.desc("before"), "order", "seen_at", "idx", "host").drop("order")
        judged = dealt.mapInPandas(_cap(limit, pd.Timedelta(seconds=window_seconds)), T.StructType([*dealt.schema, T.StructField("ok", T.BooleanType())]))
        passed = passed.unionByName(judged.drop("before").select(*passed.columns))
    again = F.row_number().over(Window.partitionBy("host", "ok").orderBy(*ORDER_COLUMNS)) > 1  # a row a recent window
    verdict = F.when(~F.col("ok"), "capped").when(F.col("known") | again, "repeat").otherwise("new")
    counted = passed.select(*columns, "anchor", verdict.alias("verdict"), F.lit(1).cast("long").alias("times"))
    old = names.where(late).select(*columns, none.alias("anchor"), F.lit("late").alias("verdict"), F.lit(1).cast("long").alias("times"))
    return reduce(DataFrame.unionByName, (counted, dups, old))


def still_open(rows: DataFrame, watermark, recent: str, window_seconds: int) -> DataFrame:
    """Judged and carried rows that bear on names from the watermark on: firsts of a recent
    window, and charges of a cap's window, that hasn't ended."""
    alive = (F.window("seen_at", recent)["end"] > F.lit(watermark)) | F.coalesce(F.col("anchor") + F.make_dt_interval(secs=F.lit(window_seconds)) > F.lit(watermark), F.lit(False))
    return rows.where(alive).select(*_CARRIED)


def _metrics(seen: Observation) -> dict:
    """The metrics; none where no row came: a plan found empty is cut away with what it observes."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "AssertionError" in str(e):
            return {}
        raise


class Ingest:
    """The tables under ``path`` and the rules of judging; ``batch`` is for foreachBatch."""

    def __init__(self, path: str, rules: DataFrame, suffixes: DataFrame, stream: str, max_depth: int = 1, recent: str = "10 minutes", limit: int = 20, window_seconds: int = 600, delay: str | timedelta = timedelta(minutes=10), buckets: int = BUCKETS, queue_new: bool = True):
        self.path, self.rules, self.suffixes, self.stream = path.rstrip("/"), rules, suffixes, stream
        self.max_depth, self.recent, self.limit, self.span = max_depth, recent, limit, window_seconds
        self.delay = delay if isinstance(delay, timedelta) else pd.Timedelta(delay).to_pytimedelta()
        self.buckets, self.queue_new = buckets, queue_new

    def _fs(self, spark: SparkSession, name: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def _seqs(self, spark: SparkSession, name: str) -> list[int]:
        fs, at = self._fs(spark, name)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(at) if fs.exists(at) else ()) if "=" in s.getPath().getName())

    def _of(self, spark: SparkSession, name: str, buckets: list[int], schema: T.StructType) -> DataFrame:
        """The table's rows in those partitions; the others aren't read."""
        fs, at = self._fs(spark, name)
        schema = T.StructType([f for f in schema if f.name != "bucket"]).add("bucket", T.IntegerType())
        if not fs.exists(at):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets))

    def _replace(self, rows: DataFrame, name: str, order: str) -> None:
        """The partitions that ``rows`` have, each in one file sorted by ``order``."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(n, "bucket").sortWithinPartitions("bucket", order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _stateless(self, certs: DataFrame) -> tuple[DataFrame, Observation]:
        """Names that are neither too deep nor blocked, counted as they pass."""
        flagged = flagged_names(certs)
        seen = Observation()
        rows = flagged.observe(
            seen, F.count_if("head").alias("certs"), F.count("host").alias("names"), F.count_if((F.col("origin") == "san") & F.col("host").isNotNull()).alias("from_san"),
            F.count_if(F.col("head") & F.col("skipped")).alias("skipped_cn"), F.coalesce(F.sum(F.when(F.col("head"), F.col("sans_cut"))), F.lit(0)).alias("sans_cut"),
        ).where("host IS NOT NULL")
        plain = flagged.where("host IS NOT NULL").select("host")
        rows = rows.join(registrable(plain, self.rules).withColumnRenamed("registrable", "parent"), "host")
        rows = rows.join(blocked_hosts(plain, self.suffixes).withColumn("bad", F.lit(True)), "host", "left")
        deep = F.col("depth").isNull() | (F.col("depth") > self.max_depth if self.max_depth > 0 else F.lit(False))
        return rows.withColumn("verdict", F.when(deep, "too_deep").when(F.col("bad"), "blocked")), seen

    def batch(self, certs: DataFrame, batch_id: int) -> None:
        spark = certs.sparkSession
        done = self._seqs(spark, "counters")
        last = spark.read.parquet(f"{self.path}/counters/seq={done[-1]}").first() if done else None
        again = last is not None and (last.stream, last.batch_id) == (self.stream, batch_id)
        seq = (done[-1] if again else done[-1] + 1) if done else 0
        before = done.index(seq) - 1 if again else len(done) - 1
        prior = spark.read.parquet(f"{self.path}/counters/seq={done[before]}").first() if before >= 0 else None
        if not again:
            self._judge(certs, batch_id, seq, prior)
        self._fold(spark, seq)
        for name, keep in (("names", 0), ("judged", 2)):  # what came before can't be asked for again
            for old in self._seqs(spark, name)[: -keep or None]:
                fs, at = self._fs(spark, f"{name}/seq={old}")
                fs.delete(at, True)

    def _judge(self, certs: DataFrame, batch_id: int, seq: int, prior) -> None:
        """Writes the batch's judged rows and its counters; the counters, last, make it final."""
        spark = certs.sparkSession
        names, seen = self._stateless(certs)
        columns = [*NAMES, "parent"]
        stated = Observation()
        places = f"{self.path}/names/seq={seq}"
        names.observe(stated, F.count_if(F.col("verdict") == "too_deep").alias("too_deep"), F.count_if(F.col("verdict") == "blocked").alias("blocked"), F.max("seen_at").alias("max_seen")).where("verdict IS NULL").select(*columns).write.mode("overwrite").parquet(places)
        names = spark.read.parquet(places)
        watermark = None if prior is None or prior.max_seen is None else prior.max_seen - self.delay
        kinds = names.withColumn("anchor", F.lit(None).cast("timestamp_ntz")).select(*_CARRIED)
        if prior is None:
            carried = spark.createDataFrame([], kinds.schema)
        else:
            carried = spark.read.parquet(f"{self.path}/judged/seq={prior.seq}").where("verdict IN ('open', 'new', 'repeat', 'capped')").select(*_CARRIED)
            carried = carried if watermark is None else still_open(carried, watermark, self.recent, self.span)
        touched = self._buckets(names)
        known = self._of(spark, "records", touched, T.StructType().add("host", T.StringType()).add("first_batch", T.LongType())).where(F.col("first_batch") < seq)
        judged = judge(names, carried, known.select("host"), watermark, self.recent, self.limit, self.span)
        told = Observation()
        of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("times"))), F.lit(0)).cast("long").alias(v)
        judged = judged.observe(told, *(of(v) for v in ("dup", "capped", "new", "repeat", "late")))
        kept = judged.where("verdict <> 'dup'").unionByName(carried.withColumns({"verdict": F.lit("open"), "times": F.lit(0).cast("long")}))
        kept.write.mode("overwrite").parquet(f"{self.path}/judged/seq={seq}")
        counts = _metrics(seen) | _metrics(stated) | _metrics(told)
        highest = max((x for x in (counts.get("max_seen"), prior.max_seen if prior else None) if x is not None), default=None)
        row = {"seq": seq, "stream": self.stream, "batch_id": batch_id, "max_seen": highest, **{c: int(counts.get(c) or 0) for c in COUNTERS}}
        schema = "seq long, stream string, batch_id long, max_seen timestamp_ntz, " + ", ".join(f"{c} long" for c in COUNTERS)
        spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counters/seq={seq}")

    def _buckets(self, rows: DataFrame) -> list[int]:
        """The partitions of the rows' hosts: at most ``buckets`` numbers."""
        return [r.bucket for r in rows.select(bucket_of(F.col("host"), self.buckets).alias("bucket")).distinct().collect()]

    def _fold(self, spark: SparkSession, seq: int) -> None:
        """The batch's rows into queue and records; partitions that have them are left alone."""
        rows = spark.read.parquet(f"{self.path}/judged/seq={seq}").where("verdict IN ('new', 'repeat', 'late')")
        fold = as_records(fold_sightings(rows)).withColumns({"first_batch": F.lit(seq).cast("long"), "batch_id": F.lit(seq).cast("long"), "bucket": bucket_of(F.col("host"), self.buckets)})
        touched = self._buckets(rows)
        stored = self._of(spark, "records", touched, fold.schema)
        had = {r.bucket: r.at for r in stored.groupBy("bucket").agg(F.max("batch_id").alias("at")).collect()}
        if self.queue_new and touched:
            items = fold.join(stored.where(F.col("first_batch") < seq).select("host"), "host", "left_anti").select(F.col("first_seen").alias("due"), "host", "bucket")
            # A set: entries that are there already stay one.
            full = [r.bucket for r in items.select("bucket").distinct().collect()]
            if full:
                self._replace(self._of(spark, "queue", full, items.schema).select(*items.columns).unionByName(items).dropDuplicates(), "queue", "due")
        pending = [b for b in touched if had.get(b, -1) < seq]
        if pending:
            part = F.col("bucket").isin(pending)
            merged = merge_records(stored.where(part), fold.where(part), by_time=True).drop("is_new")
            self._replace(merged.withColumn("batch_id", F.lit(seq).cast("long")), "records", "rev_host")


def run_ingest(certs: DataFrame, path: str, rules: DataFrame, suffixes: DataFrame, checkpoint: str, **options):
    """Start the job over all that is there (availableNow); ``certs.seen_at`` is a timestamp_ntz."""
    job = Ingest(path, rules, suffixes, checkpoint, **options)
    return certs.writeStream.foreachBatch(job.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str, table: str = "records") -> DataFrame:
    """``records``, ``queue`` or ``counters`` of an ingest."""
    return spark.read.parquet(f"{path.rstrip('/')}/{table}")
