"""Aggregates over job, worker, epoch and method logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import scalar


def preprocess_stats(df: DataFrame, config) -> DataFrame:
    """One row: original, cleaned, de-duplicated and entity row counts, observed in one pass of the chain."""
    from dataclasses import replace

    from textloom.operators.clean import extract_entities
    from textloom.plans.preprocess import preprocess

    counters: dict = {}
    survivors = preprocess(df, replace(config, extract_entities=False), counters)
    row = extract_entities(survivors).agg(
        F.count(F.lit(1)).alias("deduped_count"),
        F.coalesce(F.sum(F.size("entities")), F.lit(0)).cast("bigint").alias("entity_count"),
    ).first()
    counts = {name: obs.get["rows"] for name, obs in counters.items()}
    return df.sparkSession.createDataFrame(
        [(counts["original"], counts["cleaned"], row["deduped_count"], row["entity_count"])],
        "original_count bigint, cleaned_count bigint, deduped_count bigint, entity_count bigint",
    )


def job_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    rows_in = scalar(before.agg(F.count(F.lit(1)).alias("n")), F.col("n"))
    counts = after.agg(F.count(F.lit(1)).alias("output_rows")).withColumn("input_rows", rows_in)
    removed = F.col("input_rows") - F.col("output_rows")
    ratio = F.coalesce(F.try_divide(removed.cast("double"), F.col("input_rows")), F.lit(0.0))
    return counts.select("input_rows", "output_rows", removed.alias("removed_rows"), F.round(ratio, 6).alias("compression_ratio"))


def status_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status and a ``total`` row in one aggregation; a missing status stays null."""
    grouped = jobs.rollup(status).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_total"))
    return grouped.withColumn(status, F.when(F.col("_total") == 1, "total").otherwise(F.col(status))).drop("_total")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 1e6


def avg_duration(jobs: DataFrame, user_id=None) -> DataFrame:
    """Mean seconds of completed jobs; 0 when there are none."""
    done = jobs.filter(F.col("status") == "completed")
    if user_id is not None:
        done = done.filter(F.col("user_id") == user_id)
    return done.agg(F.coalesce(F.avg(seconds_between("started_at", "completed_at")), F.lit(0.0)).alias("average_duration"))


def worker_rollup(jobs: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return jobs.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("jobs_processed"),
        F.count_if(failed).alias("jobs_failed"),
        F.avg("seconds").alias("avg_processing_time"),
    )


def progress_points(status: str = "status", progress: str = "progress") -> Column:
    return F.when(F.col(status) == "completed", 100.0).when(F.col(status) == "running", F.col(progress)).otherwise(0.0)


def overall_progress(jobs: DataFrame, by: str) -> DataFrame:
    return jobs.groupBy(by).agg(F.avg(progress_points()).alias("overall_progress"))


def epoch_rollup(batches: DataFrame) -> DataFrame:
    """Mean loss and accuracy per run, epoch and split from batch rows."""
    accuracy = F.coalesce(F.try_divide(F.sum("correct").cast("double"), F.sum("seen")), F.lit(0.0))
    return batches.groupBy("run", "epoch", "split").agg(F.avg("loss").alias("loss"), accuracy.alias("accuracy"))


def method_rollup(epochs: DataFrame) -> DataFrame:
    """Per method: last accuracy, total and mean time, efficiency from the trainable share."""
    return epochs.groupBy("method").agg(
        F.max_by("accuracy", F.struct("epoch", "row_id")).alias("final_accuracy"),
        F.sum("seconds").alias("total_training_time"),
        F.avg("seconds").alias("avg_epoch_time"),
        (1 - F.max("trainable_percentage") / 100).alias("efficiency"),
    )


def optimization_rollup(batches: DataFrame) -> DataFrame:
    """Per variant: accuracy, size of float32 weights in MB, samples per second."""
    return batches.groupBy("variant").agg(
        F.coalesce(F.try_divide(F.sum("correct").cast("double"), F.sum("seen")), F.lit(0.0)).alias("accuracy"),
        (F.max("param_count") * 4 / F.lit(1024.0 * 1024.0)).alias("model_size_mb"),
        F.coalesce(F.try_divide(F.sum("seen").cast("double"), F.sum("seconds")), F.lit(0.0)).alias("throughput"),
    )


def training_speed(samples: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, samples / seconds).otherwise(0.0)


# Metrics that can name the best epoch, in order of preference; of perplexity less is better.
EPOCH_METRICS = (("accuracy", 1), ("f1", 1), ("perplexity", -1))


def best_epoch(history: DataFrame, score: str | None = None, higher_is_better: bool = True) -> DataFrame:
    """Per run the epoch with the best score, the earliest on ties.

    Without a score column each run is judged by the first of accuracy, f1 and perplexity that it has.
    """
    if score is not None:
        choice = [(score, 1 if higher_is_better else -1)]
    else:
        choice = [(m, sign) for m, sign in EPOCH_METRICS if m in history.columns]
        if not choice:
            raise ValueError("no metric column to judge epochs by")
    best = lambda m, sign: F.max_by(
        F.when(F.col(m).isNotNull(), F.struct("epoch", F.col(m).cast("double").alias("score"))),
        F.when(F.col(m).isNotNull(), F.struct((sign * F.col(m)).alias("s"), (-F.col("epoch")).alias("e"))),
    )
    found = history.groupBy("run").agg(F.coalesce(*[best(m, sign) for m, sign in choice]).alias("m"))
    return found.select("run", F.col("m.epoch").alias("best_epoch"), F.col("m.score").alias("best_score"))


def early_stop(history: DataFrame, patience: int = 3, threshold: float = 0.01) -> DataFrame:
    """Per run: enough epochs seen, and the last score below the best by the threshold.

    Needs only a count, a maximum and the last score, so no per-run sort.
    """
    last = F.max_by("score", "epoch")
    return history.groupBy("run").agg(
        ((F.count(F.lit(1)) > patience) & (last < F.max("score") - threshold)).alias("stop")
    )


def running_best(history: DataFrame) -> DataFrame:
    """Best score so far per run and epoch."""
    so_far = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_so_far", F.max("score").over(so_far))


def list_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0, **equals) -> DataFrame:
    """Newest first, filtered, one page, with the total before paging."""
    for name, value in equals.items():
        if value is not None:
            jobs = jobs.filter(F.col(name) == value)
    total = scalar(jobs.agg(F.count(F.lit(1)).alias("n")), F.col("n"))
    page = jobs.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)
    return page.withColumn("total", total)


def tail_logs(logs: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """Last ``n`` lines, oldest first."""
    return logs.orderBy(F.desc(ts), F.desc(tie)).limit(n).orderBy(ts, tie)
