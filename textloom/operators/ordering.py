"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import pin, scalar


def row_index(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """1-based position of each row in the total order of ``order``.

    Range-partitions, sorts inside the partitions, pins the result, then adds per-partition
    offsets. The offsets table has one row per partition. Pass narrow rows: they are written.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = pin(placed, "row-index")
    part = F.shiftrightunsigned("_mid", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + in_part + 1)
        .drop("_part", "_off", "_mid")
    )


def head_flag(df: DataFrame, key: list[str], ratio: float) -> Column:
    """True for the first ``int(n * ratio)`` rows in key order.

    Only the key is sorted; the wide rows are compared with the boundary key and never move.
    """
    keys = df.select(F.struct(*key).alias("_k"))
    indexed = row_index(keys, "_k")
    cut = scalar(indexed.agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio))).alias("c")), F.col("c"))
    boundary = scalar(indexed.filter(F.col("row_index") == cut), F.col("_k"))
    return F.coalesce(F.struct(*key) <= boundary, F.lit(False))


def head_split(df: DataFrame, key: list[str], ratio: float = 0.8) -> DataFrame:
    """Add ``split``: the first share of rows is ``train``, the rest ``eval``."""
    return df.withColumn("split", F.when(head_flag(df, key, ratio), "train").otherwise("eval"))


def row_batches(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """Add ``batch_id`` so that consecutive rows in key order form batches of ``size``."""
    indexed = row_index(df, *key)
    return indexed.withColumn("batch_id", F.floor((F.col("row_index") - 1) / size).cast("bigint"))
