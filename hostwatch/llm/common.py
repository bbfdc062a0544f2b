"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's ``bytes.split()`` and the pattern below agree on these separators.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a local temporary
    folder is made and kept for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hostwatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files go when the query that made them ends: its output is in the shared folder, and no
#: later query reads them.
_NO_SHUFFLE_LEFT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: For groupings of many groups a task: the map that is compiled for them holds a million, not 65,536.
LARGE_MAPS = {"spark.sql.codegen.aggregate.fastHashMap.capacityBit": "20"}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings for one query, set back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation of all that led here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, _NO_SHUFFLE_LEFT):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folders that ``written`` or ``by_key`` made for ``df``, when nothing reads them any more.

    Only folders right under ``shared_dir``; a DataFrame that reads any other file is refused.
    """
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    root = path(shared_dir(spark))
    root = root.getFileSystem(conf).makeQualified(root)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if other := [f for f in folders if not path(f).getParent().equals(root)]:
        raise ValueError(f"not written in the shared folder: {other[:3]}")
    for name in folders:
        made = name.rsplit("/", 1)[1]
        if "-" not in made:  # by_key names the folder like the table
            spark.sql(f"DROP TABLE IF EXISTS `{made}`")
        path(name).getFileSystem(conf).delete(path(name), True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with their bits spread."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole documents takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else, unlike ``lower``, which follows Unicode."""
    return F.translate(c, UPPER, LOWER)


def by_key(df: DataFrame, key: str, name: str, distinct: bool = False, dealt: bool = False) -> DataFrame:
    """``df`` written once in the shared folder, bucketed by ``key``; distinct: one row a key;
    dealt: ``df`` is dealt by ``key`` to as many partitions as shuffles have.

    Later joins and groupings on ``key`` read the bucket files and move only their other
    side, so that whole texts cross the network once however often they are joined.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "false")
    rows = df if dealt else df.repartition(n, key)
    rows = rows.dropDuplicates([key]) if distinct else rows
    with settings(spark, _NO_SHUFFLE_LEFT):
        rows.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{made}").option("compression", "zstd").saveAsTable(made)
    return spark.table(made)
