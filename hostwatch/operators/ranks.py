"""Places in a global order, found in range partitions: no task holds a key or the whole table."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.  Only where that
    setting is absent, on one machine, a folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hostwatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the shared folder, so that all that reads
    it sees the same partitions."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def placed(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` sorted into range partitions: ``part`` and the place ``at`` in it.  A key that many
    rows share is cut where the later columns of ``order`` differ."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    mask = (1 << 33) - 1
    return fixed(rows.withColumns({"part": F.shiftright("__m", 33).cast("int"), "at": F.col("__m").bitwiseAND(F.lit(mask))}).drop("__m"))


def before(totals: DataFrame, *columns: str) -> DataFrame:
    """``totals``, a row a part, with each of ``columns`` summed over the parts before: as many
    rows as there are partitions, whatever the table."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in columns})


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2... in the order."""
    rows = placed(df, *order)
    totals = before(rows.groupBy("part").agg(F.count("*").alias("c")), "c")
    return rows.join(F.broadcast(totals.select("part", "c_before")), "part").withColumn(name, F.col("c_before") + F.col("at")).drop("part", "at", "c_before")
