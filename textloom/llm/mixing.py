"""Mix sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import WORD_PATTERN
from textloom.operators.skew import lookup
from textloom.session import pin

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix-1"
# A table of sources up to this size is sent to every task; a larger one is joined with its hot keys spread.
SHIPPED_SOURCES = 20_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """(source, source_size, n, target, rate) from ``sizes(source, source_size, n)``, one row per source.

    Sources in code point order, null last, get the weights in turn. What a target would exceed of
    ``most`` times its source's size is shared again by weight. That ends where the targets are
    min(most * size, level * weight) with one level for all: in the order of most * size / weight the
    cut sources come first, so running sums give the level. The window runs over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    rising = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("level", level)
    # The level is the first at which the source in turn is not full.
    final = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull(), "source", "level"))).over(everything)
    rows = rows.withColumn("level", final["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "n", "target", "rate")


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) that follows from the seed and the doc_id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED
) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with size, source_size, target and copies; no row is dropped.

    A document is taken floor(rate) times, and once more if its draw is below the rate's fraction;
    rate = target / size of its source, ``most`` at most. The draw depends on the seed and doc_id
    only, so reruns agree and rows that share a doc_id share their draw. A null text has size 0; a
    null source is a source of its own, the last; a source without words has target 0 and no copies.
    Columns of these names in the input are replaced, others are kept. An empty table gives no rows.
    """
    clash = ("size", "source_size", "target", "copies", "rate", "n", "_source")
    rows = docs.drop(*clash).withColumn("size", word_count())
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # "x" + source, or "" for null: a key that joins null with null.
    key = F.coalesce(F.concat(F.lit("x"), F.col("source").cast("string")), F.lit(""))
    targets = pin(source_targets(sums, weights, share, most).withColumn("_source", key).drop("source"), "mix-targets")
    rows = rows.withColumn("_source", key)
    one = targets.drop("n")
    if targets.count() <= SHIPPED_SOURCES:
        rows = rows.join(F.broadcast(one), "_source")
    else:
        rows = lookup(rows, one, "_source", counts=targets.select("_source", "n"))
    extra = (draw(seed) < F.col("rate") - F.floor("rate")).cast("int")
    return rows.withColumn("copies", (F.floor("rate") + extra).cast("int")).drop("_source", "rate")


def repeated(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mix.withColumn("_copy", F.explode(F.expr("array_repeat(0, copies)"))).select(*columns)
