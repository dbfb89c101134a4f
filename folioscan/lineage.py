"""Cutting lineage with tables written to the folder that all executors share.

Intermediate results that several later stages read are written once as Parquet
below ``spark.checkpoint.dir`` and read back.  A lost executor then costs a
re-read, never a recomputation of the whole chain, and Catalyst sees the true
size of the table.  Only where the session names no folder (tests, laptops) a
temporary one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: The temporary folder of an application whose session names no shared one.
_temporary: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset a temporary folder, but on one machine only."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (named := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = named.get()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _temporary.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="folioscan-")
        _temporary[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a plain table scan.

    The table is removed by :func:`drop`, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver's interpreter ends."""
    _written.append((spark, path))
    return path


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that no later step reads (columns may have been renamed or left out since)."""
    for table in tables:
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            for _, path in list(_written):
                if folder.endswith(path.rpartition("/")[2]):
                    forget(path)


def forget(path_or_none: str | None = None) -> None:
    """Delete the tables written by :func:`cut` (all of them, or one)."""
    for spark, path in [x for x in _written if path_or_none in (None, x[1])]:
        _written.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already be gone
            pass


atexit.register(forget)
