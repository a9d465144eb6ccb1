"""Class word frequencies, Naive Bayes and the three-feature logistic model, as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.features import word_sums
from textloom.session import MAX_SHIPPED_ROWS, pin, scalar


def doc_words(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, word, c): words of each row with their count in the row.

    Rows are placed by key first, so counting needs no further shuffle and a frequent word
    stays spread over the rows it occurs in.
    """
    placed = df.select(key, tokens.alias("_t")).repartition(key)
    exploded = placed.select(key, F.explode("_t").alias("word"))
    return exploded.groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))


def class_word_freqs(df: DataFrame, tokens: Column, label: str) -> DataFrame:
    """(word, label, n)."""
    words = df.select(F.col(label).alias("label"), F.explode(tokens).alias("word"))
    return words.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))


def pos_neg(freqs: DataFrame) -> DataFrame:
    """(word, positive, negative, ratio) with the add-one ratio."""
    wide = freqs.groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("negative"),
    )
    return wide.withColumn("ratio", (F.col("positive") + 1) / (F.col("negative") + 1))


def word_pos_neg_table(freqs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Counts and log coordinates, for all or for chosen words."""
    wide = pos_neg(freqs if words is None else freqs.filter(F.col("word").isin(words)))
    return wide.select(
        "word", "positive", "negative", F.log1p("positive").alias("log_pos"), F.log1p("negative").alias("log_neg")
    )


def words_by_threshold(freqs: DataFrame, label: int, threshold: float) -> DataFrame:
    rated = pos_neg(freqs)
    return rated.filter(F.col("ratio") >= threshold if label == 1 else F.col("ratio") <= threshold)


def nb_train(df: DataFrame, tokens: Column, label: str) -> DataFrame:
    """(word, n, loglikelihood, logprior). ``n`` is the word's training count."""
    freqs = pin(pos_neg(class_word_freqs(df, tokens, label)), "word-classes")
    totals = freqs.agg(F.count(F.lit(1)).alias("v"), F.sum("positive").alias("np"), F.sum("negative").alias("nn"))
    t = scalar(totals, F.col("v"), F.col("np"), F.col("nn"))
    classes = df.agg(
        F.log(F.count_if(F.col(label) == 1) / F.count_if(F.col(label) == 0)).alias("p")
    )
    positive = (F.col("positive") + 1) / (t["np"] + t["v"])
    negative = (F.col("negative") + 1) / (t["nn"] + t["v"])
    return freqs.select(
        "word",
        (F.col("positive") + F.col("negative")).alias("n"),
        F.log(positive / negative).alias("loglikelihood"),
        scalar(classes, F.col("p")).alias("logprior"),
    )


def nb_predict(df: DataFrame, key: str, tokens: Column, model: DataFrame) -> DataFrame:
    """(key, score): prior plus the log likelihood of every known word, repeats counted."""
    prior = scalar(model.agg(F.max("logprior").alias("p")), F.col("p"))
    sums = word_sums(df, key, tokens, model, ["loglikelihood"]).withColumnRenamed("loglikelihood", "s")
    return df.select(key).join(sums, key, "left").select(key, (prior + F.coalesce("s", F.lit(0.0))).alias("score"))


def nb_accuracy(scored: DataFrame, label: str) -> DataFrame:
    wrong = F.abs((F.col("score") > 0).cast("int") - F.col(label))
    return scored.agg((1 - F.avg(wrong)).alias("accuracy"))


def nb_errors(scored: DataFrame, label: str) -> DataFrame:
    return scored.filter(F.col(label) != (F.col("score") > 0).cast("int"))


def freq_features(df: DataFrame, key: str, tokens: Column, freqs: DataFrame) -> DataFrame:
    """(key, x0, x1, x2): bias, summed positive and negative counts of the row's words."""
    wide = pin(pos_neg(freqs).withColumn("n", F.col("positive") + F.col("negative")), "word-classes")
    sums = word_sums(df, key, tokens, wide, ["positive", "negative"]).withColumnsRenamed({"positive": "x1", "negative": "x2"})
    joined = df.select(key).join(sums, key, "left")
    return joined.select(
        key, F.lit(1.0).alias("x0"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x1", "x2")]
    )


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _margin(theta: list[float], columns: list[str]) -> Column:
    z = F.lit(0.0)
    for t, c in zip(theta, columns):
        z = z + F.lit(float(t)) * F.col(c)
    return z


def gd_logistic(
    examples: DataFrame, columns: list[str], label: str, alpha: float = 1e-9, num_iters: int = 1500
) -> tuple[float, list[float]]:
    """(cost, theta) of batch gradient descent from zero.

    Equal examples are counted first: a step is a weighted sum over the different ones. Up to
    MAX_SHIPPED_ROWS of these, the steps run on them as one matrix. More stay a pinned table of blocks,
    and in every step each task sends back a few sums over its blocks. The plan of a step holds no
    numbers of it, so nothing is compiled again.
    """
    rows = examples.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("y"))
    rows = pin(rows.groupBy(*columns, "y").agg(F.count(F.lit(1)).alias("m")), "examples")
    if rows.count() <= MAX_SHIPPED_ROWS:
        return _matrix_steps(rows.toPandas(), columns, alpha, num_iters)
    return _block_steps(rows, columns, alpha, num_iters)


def _block_steps(rows: DataFrame, columns: list[str], alpha: float, num_iters: int) -> tuple[float, list[float]]:
    width = len(columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*columns, "y", "m"]])
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])

    blocks = pin(rows.select(*columns, "y", "m").mapInArrow(packed, "block binary"), "example-blocks")
    theta, cost = np.zeros(width), float("nan")

    def sums(theta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + 2)
            for batch in batches:
                for data in batch.column("block"):
                    block = np.frombuffer(data.as_buffer()).reshape(width + 2, -1)
                    x, y, m = block[:width], block[width], block[width + 1]
                    loss, slope = _loss_and_slope(theta @ x, y)
                    total += [m.sum(), m @ loss, *(x @ (m * slope))]
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

        return np.array(blocks.mapInArrow(run, "sums array<double>").toArrow()["sums"].to_pylist()).sum(axis=0)

    for _ in range(num_iters):
        n, loss, *slope = sums(theta)
        cost = float(loss / n)
        theta = theta - alpha / n * np.array(slope)
    return cost, theta.tolist()


def _loss_and_slope(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log loss, written so that no logarithm of zero arises, and its slope."""
    return np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))), 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y


def _matrix_steps(rows: pd.DataFrame, columns: list[str], alpha: float, num_iters: int) -> tuple[float, list[float]]:
    x, y, m = rows[columns].to_numpy(), rows["y"].to_numpy(), rows["m"].to_numpy(float)
    theta, n, cost = np.zeros(len(columns)), m.sum(), float("nan")
    for _ in range(num_iters if n else 0):
        loss, slope = _loss_and_slope(x @ theta, y)
        cost = float((m * loss).sum() / n)
        theta = theta - alpha / n * (x.T @ (m * slope))
    return cost, theta.tolist()


def logistic_predict(features: DataFrame, columns: list[str], theta: list[float]) -> DataFrame:
    """Adds ``probability`` and ``predicted`` (probability over one half)."""
    scored = features.withColumn("probability", sigmoid(_margin(theta, columns)))
    return scored.withColumn("predicted", (F.col("probability") > 0.5).cast("int"))
