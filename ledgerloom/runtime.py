"""Session services shared by every operator: the cluster's shared folder, written tables, code shipping."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
#: Seconds between two forced collections of garbage, and when the last one was.
COLLECT_S, _collected = 2.0, 0.0
#: By application, what results that were handed out still read: paths of written tables and names of catalog tables.
_LATER: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where it is unset (local tests) an own one."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", "") or _OWN_DIRS.get(app)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN_DIRS[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ledgerloom-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read again, and has Spark drop the shuffle files of finished queries.

    Spark drops a shuffle's files when the driver's objects about it are collected as garbage, which an idle driver puts off for long;
    hence the collection here, between two jobs, but not more often than every COLLECT_S seconds.
    """
    global _collected
    for t in tables:
        if t is not None and getattr(t, "_written_path", None):
            delete_path(spark, t._written_path)
    if time.monotonic() - _collected >= COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def later(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Notes written tables (or catalog tables by name) that a result still reads, for sweep()."""
    _LATER.setdefault(spark.sparkContext.applicationId, []).extend(t if isinstance(t, str) else t._written_path for t in tables)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that results handed out before have read. Those results must have been written or dropped."""
    for t in _LATER.pop(spark.sparkContext.applicationId, []):
        if "/" in t:
            delete_path(spark, t)
        else:
            where = spark.sql(f"DESCRIBE TABLE EXTENDED {t}").filter("col_name = 'Location'").first()[1]
            spark.sql(f"DROP TABLE IF EXISTS {t}")
            delete_path(spark, where)
    forget(spark)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder on whatever file system holds it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-code-"), "ledgerloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
