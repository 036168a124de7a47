"""Cutting lineage through files that every executor can read.

A plain ``DataFrame.checkpoint`` runs a map-only plan twice (once to count, once
to write), so intermediate results are written once as Parquet below the
directory named by ``spark.checkpoint.dir``.  Nothing is kept in executors'
memory or local folders, so a lost executor never loses a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tessera-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def free(df: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``df``; for tables of earlier rounds, which no later plan reads."""
    path = getattr(df, "durable_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


atexit.register(_remove)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` has it (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate, used to choose partition counts; at least 1."""
    return max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Enough partitions for ``bytes_each`` of input each; the session's number at least, and where the size is unknown."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return least if size >= 1 << 60 else max(least, size // bytes_each)
