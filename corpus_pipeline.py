"""From raw documents to packed training sequences, in five stages over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import minhash, mixing, packing, quality, secrets
from textloom.llm.common import small_batches, table, without_ids
from textloom.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity passes their language's limit. A doc_id goes if any of its rows fails."""
    small_batches(spark)
    verdicts = quality.judged(docs, table(spark, sf_dir, "labels"))
    return without_ids(docs.select(*COLUMNS), verdicts.filter("NOT kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    groups = minhash.near_duplicates(docs, k=5, percent=80)
    return without_ids(docs.select(*COLUMNS), groups.filter("NOT kept"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced; n_chars follows the new text."""
    rows = secrets.secret_spans(docs.select(*COLUMNS), secrets.fitted(docs))
    rows = rows.withColumn("text", secrets.without_secrets(F.col("text"), F.col("found")))
    length = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", length).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.repeated(mixing.mixed(docs.select(*COLUMNS)), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of gapless windows of 1024 tokens, with their token ids."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good_text),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scan", blot_secrets),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

# A fitted model and a tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
