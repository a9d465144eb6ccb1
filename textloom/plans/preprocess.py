"""The preprocessing chain: one plan, one action, counters read from the same pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions import text as tx
from textloom.operators import clean as cl
from textloom.operators.dedup import exact_dedup, near_dup_dedup
from textloom.session import fresh_path
from textloom.sources.readers import read_corpus
from textloom.sources.writers import publish, write_corpus


@dataclass(frozen=True)
class PreprocessConfig:
    clean_method: str = "standard"
    dedup_threshold: float = 0.9
    near_duplicates: bool = False
    extract_entities: bool = True
    normalize_text: bool = True
    remove_stopwords: bool = False
    min_doc_length: int = 50
    max_doc_length: int = 10_000
    language: str | None = None
    output_format: str = "parquet"
    id_col: str = "id"
    order: tuple[str, ...] = ("timestamp", "id")


def preprocess(df: DataFrame, config: PreprocessConfig, counters: dict[str, Observation] | None = None) -> DataFrame:
    """Filter by length, clean, normalise, de-duplicate, extract entities."""

    def counted(step: DataFrame, name: str) -> DataFrame:
        if counters is None:
            return step
        counters[name] = Observation(name)
        return step.observe(counters[name], F.count(F.lit(1)).alias("rows"))

    cl.require_columns(df, "content")
    df = counted(df, "original")
    df = cl.length_filter(df, "content", config.min_doc_length, config.max_doc_length)
    if config.language is not None:
        df = cl.language_filter(df, config.language)
    df = cl.clean(df, config.clean_method)
    if config.normalize_text:
        df = cl.normalize_whitespace(df)
    if config.remove_stopwords:
        kept = tx.drop_stop_words(tx.words(F.col("content_clean")))
        df = cl.drop_empty(df.withColumn("content_clean", F.array_join(kept, " ")))
    df = counted(df, "cleaned")
    if config.dedup_threshold < 1.0:
        cl.require_columns(df, *config.order)
        if config.near_duplicates:
            df = near_dup_dedup(df, config.id_col, "content_clean", config.dedup_threshold, order=config.order)
        else:
            df = exact_dedup(df, "content_clean", config.order)
        df = counted(df, "deduped")
    if config.extract_entities:
        df = counted(cl.explode_entities(cl.extract_entities(df)), "entities")
    return df


def run_preprocess(
    spark: SparkSession, source: str, target: str, config: PreprocessConfig, schema: StructType | str | None = None
) -> dict[str, float]:
    """Read, preprocess, write; publish only when every step kept at least one row."""
    counters: dict[str, Observation] = {}
    result = preprocess(read_corpus(spark, source, schema), config, counters)
    staging = fresh_path(spark, "preprocess")
    write_corpus(result, staging, config.output_format)
    counts = {name: obs.get["rows"] for name, obs in counters.items()}
    for name, rows in counts.items():
        if rows == 0:
            raise ValueError(f"step {name} left no rows")
    publish(spark, staging, target)
    rows_in = counts["original"]
    rows_out = list(counts.values())[-1]
    return {
        **counts,
        "input_rows": rows_in,
        "output_rows": rows_out,
        "removed_rows": rows_in - rows_out,
        "compression_ratio": (rows_in - rows_out) / rows_in,
    }
