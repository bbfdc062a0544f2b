"""Certificate logs: which to follow, what to read of each, and how far it was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwatch.functions.names import note_origin

LOG_LIST = (
    "operators array<struct<name:string,logs:array<struct<url:string,key:string,state:map<string,struct<timestamp:string>>,temporal_interval:struct<start_inclusive:timestamp,end_exclusive:timestamp>>>,"
    "tiled_logs:array<struct<monitoring_url:string,submission_url:string,key:string,state:map<string,struct<timestamp:string>>,temporal_interval:struct<start_inclusive:timestamp,end_exclusive:timestamp>>>>>"
)
TILE = 256
#: Ranges that one row unfolds to at most, and about so many in a task.
PIECE, TASK = 1 << 10, 1 << 21


def select_logs(log_list: DataFrame, now: Column, lookahead_seconds: int = 0) -> DataFrame:
    """Log lists (columns of LOG_LIST) to the logs worth following: ``(uri, key, origin, kind)``."""
    ops = log_list.select(F.explode("operators").alias("o"))
    plain = ops.select(F.explode("o.logs").alias("l")).select(F.col("l.url").alias("uri"), "l.key", F.lit("").alias("origin"), F.lit("rfc6962").alias("kind"), "l.state", "l.temporal_interval")
    tiled = ops.select(F.explode("o.tiled_logs").alias("l")).select(F.col("l.monitoring_url").alias("uri"), "l.key", note_origin("l.submission_url").alias("origin"), F.lit("tiled").alias("kind"), "l.state", "l.temporal_interval")
    opens = now + F.make_dt_interval(secs=F.lit(max(lookahead_seconds, 0)))
    ti = F.col("temporal_interval")
    live = ti.isNull() | ((now < ti["end_exclusive"]) & (ti["start_inclusive"] <= opens))
    return plain.unionByName(tiled).where(F.map_contains_key("state", "usable") & live).select("uri", "key", "origin", "kind")


def require_logs(logs: DataFrame) -> DataFrame:
    """An error if a list gave no log at all."""
    if logs.isEmpty():
        raise ValueError("the log list has no log that accepts certificates now")
    return logs


def dedupe_log_prefixes(logs: DataFrame) -> DataFrame:
    """Tiled prefixes without trailing slashes; one row a URI, the least (key, origin)."""
    uri = F.when(F.col("kind") == "tiled", F.regexp_replace("uri", r"/+$", "")).otherwise(F.col("uri"))
    one = logs.withColumn("uri", uri).groupBy("uri").agg(F.min(F.struct("key", "origin", "kind")).alias("l"))
    return one.select("uri", "l.key", "l.origin", "l.kind")


def reconcile_logs(current: DataFrame, listed: DataFrame) -> DataFrame:
    """``(uri, change)``: joined, left, rekeyed or unchanged; an empty listing changes nothing."""
    c = current.select("uri", F.struct("key", "origin").alias("c"))
    n = listed.select("uri", F.struct("key", "origin").alias("n"))
    some = listed.agg((F.count("*") > 0).alias("some"))
    both = c.join(n, "uri", "full_outer").withColumn("one", F.lit(1)).join(F.broadcast(some.withColumn("one", F.lit(1))), "one")
    change = F.when(~F.col("some"), "unchanged").when(F.col("c").isNull(), "joined").when(F.col("n").isNull(), "left").when(F.col("c") != F.col("n"), "rekeyed").otherwise("unchanged")
    return both.select("uri", change.alias("change"))


def _tile_path(n: Column) -> Column:
    """Three digits a level, all but the last marked x."""
    last = F.lpad((n % 1000).cast("string"), 3, "0")
    mid = F.concat(F.lit("x"), F.lpad((F.floor(n / 1000) % 1000).cast("string"), 3, "0"), F.lit("/"))
    top = F.concat(F.lit("x"), F.lpad((F.floor(n / 1_000_000) % 1000).cast("string"), 3, "0"), F.lit("/"))
    return F.concat(F.lit("tile/data/"), F.when(n >= 1_000_000, top).otherwise(""), F.when(n >= 1000, mid).otherwise(""), last)


def log_starts(heads: DataFrame, positions: DataFrame, from_start: bool = False, max_lag: int = 0) -> DataFrame:
    """``(log, kind, tree_size, pos, skipped)``: where each log's reading goes on."""
    both = heads.join(positions.withColumnRenamed("pos", "was"), "log", "left")
    size, was = F.col("tree_size"), F.col("was")
    behind = F.lit(max_lag > 0) & (size - was > max_lag)
    pos = F.when(was.isNull(), F.lit(0).cast("long") if from_start else size).when(was > size, size).when(behind, size).otherwise(was)
    return both.select("log", "kind", "tree_size", pos.cast("long").alias("pos"), F.when(was.isNotNull() & behind, size - was).otherwise(F.lit(0)).cast("long").alias("skipped"))


def plan_log_reads(heads: DataFrame, positions: DataFrame, batch: int = 64, from_start: bool = False, max_lag: int = 0) -> DataFrame:
    """Ranges of indexes to read; for tiled logs the tile, its width and its path.

    A plan is as long as its logs, however few rows they are in.  So the ranges are counted first, each log
    becomes pieces of at most PIECE ranges, and those are dealt to tasks of about TASK ranges each.  Whole pieces
    go by their place, so that a task has the same stretch of many logs: where they are read from like
    positions its files name few indexes and paths, each many times, and are small.  The rest of each log is dealt evenly.
    """
    size, pos, tiled = F.col("tree_size"), F.col("pos"), F.col("kind") == "tiled"
    at = log_starts(heads, positions, from_start, max_lag).where(pos < size).where("kind IS NOT NULL")
    lo = F.when(tiled, F.floor(pos / TILE)).otherwise(F.lit(0).cast("long"))
    hi = F.when(tiled, F.floor((size - 1) / TILE)).otherwise(F.floor((size - 1 - pos) / batch))
    at = at.select("log", "kind", "tree_size", "pos", lo.alias("lo"), hi.alias("hi"))
    n = F.col("hi") - F.col("lo") + 1
    total, whole = at.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(n - n % PIECE), F.lit(0))).first()
    pieces = at.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(PIECE).cast("long"))))
    if total > TASK:
        full = F.col("lo") + PIECE - 1 <= F.col("hi")
        rest = pieces.where(~full).repartition(-(-(total - whole) // TASK) or 1)
        pieces = pieces.where(full).repartitionByRange(-(-whole // TASK) or 1, "kind", "lo", "log").unionByName(rest)
    at = pieces.withColumn("at", F.explode(F.sequence("lo", F.least(F.col("lo") + PIECE - 1, "hi"))))
    start = F.when(tiled, F.col("at") * TILE).otherwise(pos + F.col("at") * batch)
    width = F.least(F.when(tiled, F.lit(TILE)).otherwise(batch), size - start)
    at = at.select("log", "kind", tiled.alias("tiled"), F.greatest("pos", start).alias("first"), (start + width - 1).alias("last"), F.when(tiled, F.col("at")).alias("tile"), F.when(tiled, width.cast("int")).alias("width"))
    path = F.concat(_tile_path(F.col("tile")), F.when(F.col("width") < TILE, F.concat(F.lit(".p/"), F.col("width").cast("string"))).otherwise(""))
    return at.select("log", "kind", "first", "last", "tile", "width", F.when(F.col("tiled"), path).alias("path"))


def advance_positions(positions: DataFrame, read_counts: DataFrame) -> DataFrame:
    """Positions moved by what was actually read; ``read_counts``: (log, base, n)."""
    moved = read_counts.groupBy("log").agg(F.max(F.col("base") + F.col("n")).alias("to"))
    return positions.join(moved, "log", "full_outer").select("log", F.greatest("pos", "to").cast("long").alias("pos"))
