"""Lookup joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of all rows and more than this many rows.
HOT_SHARE = 1 / 1000
HOT_ROWS = 100_000
SALTS = 64


def hot_keys(counts: DataFrame, key: str, weight: str) -> DataFrame | None:
    """The hot keys of ``counts(key, weight)`` as a table of at most 1 / HOT_SHARE rows, or None."""
    top = counts.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()
    limit = max((top["total"] or 0) * HOT_SHARE, HOT_ROWS)
    if (top["most"] or 0) <= limit:
        return None
    keys = counts.filter(F.col(weight) > limit).select(key)
    return counts.sparkSession.createDataFrame(keys.collect(), keys.schema)


def lookup(
    many: DataFrame,
    one: DataFrame,
    key: str,
    counts: DataFrame | None = None,
    weight: str = "n",
    how: str = "inner",
) -> DataFrame:
    """Join ``many`` (hot keys allowed) with ``one`` (one row per key) on ``key``.

    Rows of hot keys are spread over SALTS partitions and the matching row is repeated that
    often; every other key joins plainly. ``counts(key, weight)`` saves the counting pass.
    """
    if counts is None:
        counts = many.groupBy(key).agg(F.count(F.lit(1)).alias(weight))
    hot = hot_keys(counts, key, weight)
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(SALTS)).cast("int")
    left = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.drop("_hot").join(right, [key, "_salt"], how).drop("_salt")
