"""Scores of predictions: classification, regression, sequence and question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.models import argmax
from textloom.session import scalar


def predicted_label(df: DataFrame, prediction: str) -> Column:
    """A column of logits becomes its arg-max; anything else is the label itself."""
    if isinstance(df.schema[prediction].dataType, T.ArrayType):
        return argmax(F.col(prediction))
    return F.col(prediction)


def confusion_counts(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """(label, predicted, n): the only pass over the data; one row per cell that occurs."""
    pairs = df.select(F.col(label).alias("label"), predicted_label(df, prediction).alias("predicted"))
    return pairs.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _zero_div(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def class_scores(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """(class, precision, recall, f1, support), 0 where undefined."""
    cells = confusion_counts(df, prediction, label)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col("predicted").cast("string").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed")),
    )
    sums = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed")
    )
    precision, recall = _zero_div(F.col("tp"), F.col("guessed")), _zero_div(F.col("tp"), F.col("support"))
    scored = sums.select("class", "tp", "support", precision.alias("precision"), recall.alias("recall"))
    f1 = _zero_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def classification_metrics(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, f1."""
    per_class = class_scores(df, prediction, label)

    def weighted(c: str) -> Column:
        return _zero_div(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    return per_class.agg(
        _zero_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1_score"),
    )


def classification_report(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """(class, precision, recall, f1, support) plus macro and weighted averages."""
    per_class = class_scores(df, prediction, label).drop("tp")
    scores = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[_zero_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores], F.sum("support").alias("support")
    )
    return (
        per_class.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def binary_scores(df: DataFrame, prediction: str, label: str, positive: str = "1") -> DataFrame:
    """One row: precision, recall and f1 of the positive class, zeros when it never occurs."""
    row = class_scores(df, prediction, label).filter(F.col("class") == positive)
    return row.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def simple_accuracy(df: DataFrame, prediction: str, label: str) -> DataFrame:
    same = (F.col(prediction) == F.col(label)).cast("double")
    return df.agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("accuracy"))


def confusion_matrix(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """(label, predicted, n) with zero cells; the classes are few and come from the cells."""
    cells = confusion_counts(df, prediction, label)
    classes = cells.select(F.explode(F.array("label", "predicted")).alias("label")).distinct()
    listed = scalar(classes.agg(F.array_sort(F.collect_set("label")).alias("all")), F.col("all"))
    grid = classes.withColumn("_all", listed).select("label", F.explode("_all").alias("predicted"))
    return grid.join(cells, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def regression_metrics(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row: mse, rmse, mae, r2 (0 without variance)."""
    error = F.col(prediction) - F.col(label)
    sums = df.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(F.col(label)).alias("var"),
    )
    r2 = F.when(F.col("var") != 0, 1 - F.col("mse") / F.col("var")).otherwise(0.0)
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"), F.avg(loss).alias("avg_loss"))


def token_overlap(left: Column, right: Column) -> dict[str, Column]:
    """Set sizes of two token arrays and of their intersection."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    return {"n_left": F.size(a), "n_right": F.size(b), "n_common": F.size(F.array_intersect(a, b))}


def qa_scores(prediction: Column, reference: Column, pred_tokens: Column, ref_tokens: Column) -> dict[str, Column]:
    """Exact match and set-token F1 per row."""
    o = token_overlap(pred_tokens, ref_tokens)
    precision, recall = F.try_divide(o["n_common"], o["n_left"]), F.try_divide(o["n_common"], o["n_right"])
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"exact_match": (prediction == reference).cast("double"), "f1": f1}


def qa_em_f1(df: DataFrame, prediction: str, reference: str, tokens) -> DataFrame:
    s = qa_scores(F.col(prediction), F.col(reference), tokens(F.col(prediction)), tokens(F.col(reference)))
    return df.agg(F.avg(s["exact_match"]).alias("exact_match"), F.avg(s["f1"]).alias("f1_score"))
