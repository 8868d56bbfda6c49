"""Shared plan helpers: checked broadcasts, lineage cuts, key handling."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# A lookup side is broadcast only if Spark's size estimate of its plan is within
# this. The estimate follows the sizes of compressed files; a hash table of the
# rows that come from them was measured at 70 to 90 times as much (384 MB for
# the stops of a part file of 5 MB), so this stands for some 64 MB of memory.
BROADCAST_MAX_BYTES = 640 << 10


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its plan's size estimate is at most
    ``max_bytes``; otherwise for a sort-merge join, whose tasks hold a partition
    each and spill, as Spark's own choice would go by the same estimate. No job
    is run, and nothing is remembered between calls."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= max_bytes else df.hint("merge")


def merged_if_large(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` for a join that Spark plans as it likes, but by sort-merge if its
    size estimate is above ``max_bytes``: Spark would broadcast it up to 10 MB of
    that same estimate."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size <= max_bytes else df.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint directory for lineage cuts. Uses the cluster's
    ``spark.checkpoint.dir``; only a local session without one gets a fresh
    folder under the system temp directory (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
        configured = tempfile.mkdtemp(prefix="tapflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_TABLES: dict[str, tuple[SparkSession, str]] = {}


def table_path(spark: SparkSession) -> str:
    """A fresh path under the shared checkpoint folder, which ``drop_tables``
    removes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tapflow-tables/{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(drop_tables)
    _TABLES[path] = (spark, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    return a DataFrame reading it. The lineage is cut (a lost executor costs
    a re-read, not a recomputation), the plan runs once (a reliable RDD
    checkpoint of a DataFrame computes it twice), and the reader carries
    real size statistics, so later joins against small results broadcast.
    The tables of a session are removed by ``drop_tables``, at the latest
    when the driver's Python exits."""
    spark, path = df.sparkSession, table_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    table._written_at = path  # for drop_table
    return table


def drop_table(table: DataFrame) -> None:
    """Remove a table that ``cut_lineage`` returned and nothing reads any more;
    iterations keep their disk bounded by it."""
    spark, path = _TABLES.pop(table._written_at)
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


_SHARED: dict[tuple, str] = {}


def shared_table(spark: SparkSession, key: tuple, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build`` written once and read by all callers of the
    session that give the same ``key`` and input files. The files' names,
    sizes and times are part of the key, so changed inputs are computed anew;
    so are tables that ``drop_tables`` removed."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime").collect()
    key = (spark.sparkContext.applicationId, key, tuple(sorted(map(tuple, files))))
    if _SHARED.get(key) not in _TABLES:
        path = table_path(spark)
        build().write.mode("overwrite").parquet(path)
        _SHARED[key] = path
    return spark.read.parquet(_SHARED[key])


def drop_tables() -> None:
    """Remove all tables that ``cut_lineage`` wrote, once the results that
    read them have been written."""
    while _TABLES:
        spark, path = _TABLES.popitem()[1]
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """L3: the first ``n`` rows in the order of ``order``, whatever the
    partitions; every task sends its own first ``n`` only."""
    return df.orderBy(*order).limit(n)


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (presentation for comparisons)."""
    cols = [F.round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double"
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)
