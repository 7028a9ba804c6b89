"""The previous row in one global order, without one task that holds all rows.

Rows are range-partitioned and sorted; each task takes its previous rows by itself. The only rows that need another task's are the
first of each partition: they get the last row of the nearest non-empty partition before, of which there is one per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import written


def previous_in(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with prev_<column> of the row before of the same keys; without keys, of the row before in the global order."""
    if not keys:
        return with_previous(rows, order, columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def with_previous(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """rows with prev_<column> of the row before in the global order (null for the first)."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    placed = written(spark, placed, "ordered")  # partition numbers must not change between the two readings
    w = Window.partitionBy("__part").orderBy(*order)
    local = placed.withColumn("__first", F.row_number().over(w) == 1).withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    last = placed.groupBy("__part").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    # one row per partition: the only rows that meet in one task
    edge = last.select((F.lead("__part").over(Window.orderBy("__part"))).alias("__part"), "__last").filter("__part IS NOT NULL")
    joined = local.join(F.broadcast(edge), "__part", "left")
    fill = {f"prev_{c}": F.when(F.col("__first"), F.col(f"__last.{c}")).otherwise(F.col(f"prev_{c}")) for c in columns}
    return joined.withColumns(fill).drop("__part", "__first", "__last")
