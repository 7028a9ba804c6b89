"""Joins that a hot key cannot overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of all rows (and more than LEAST rows) go by broadcast: at most 1 / HOT_SHARE of them exist, some 10 MB.
HOT_SHARE, LEAST = 1e-5, 1000


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left LEFT JOIN right on key. right has unique keys and, in count, each key's rows in left; total is the rows of left.

    Hot keys are looked up by a broadcast of at most 1 / HOT_SHARE rows; their rows skip the shuffle join's key (they get a key of
    their own that matches nothing), so the shuffle join never sees a hot key.
    """
    least = max(LEAST, int(total * HOT_SHARE))
    values = [c for c in right.columns if c not in (key, count)]
    hot = right.filter(F.col(count) > least).select(F.col(key).alias("__hot"), F.struct(*values).alias("__hot_values"))
    cold = right.filter(F.col(count) <= least).select(F.col(key).alias("__cold"), F.struct(*values).alias("__cold_values"))
    first = left.join(F.broadcast(hot), left[key].eqNullSafe(hot["__hot"]), "left").drop("__hot")
    spread = F.when(F.col("__hot_values").isNull(), F.col(key))
    salt = F.when(F.col("__hot_values").isNotNull(), F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])).otherwise(F.lit(0).cast("long"))
    first = first.withColumn("__key", spread).withColumn("__salt", salt)
    cold = cold.withColumn("__zero", F.lit(0).cast("long"))
    joined = first.join(cold, (first["__key"] == cold["__cold"]) & (first["__salt"] == cold["__zero"]), "left")
    found = F.coalesce("__hot_values", "__cold_values")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[found[v].alias(v) for v in values])
