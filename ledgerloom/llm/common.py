"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.runtime import ship

#: Rows and bytes of an Arrow batch: texts are long, so batches stay far below the default of 10,000 rows.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Ships the code to executors and bounds the Arrow batches that Python workers hold."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs) or of a local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}" if not uri.startswith("file:") else uri)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns of a batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
