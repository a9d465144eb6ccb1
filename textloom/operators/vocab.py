"""Word, character and pair counts; vocabularies as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.ordering import row_index
from textloom.session import fresh_path

# Special tokens in id order.
WORDPIECE_SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
SEQUENCE_SPECIALS = ["<sos>", "<eos>", "<unk>", "<pad>"]


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, n): combined before the shuffle, so frequent words cost one row per task."""
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _specials(df: DataFrame, column: str, rows: list[tuple[str, int]]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, f"{column} string, id bigint")


def char_vocab(df: DataFrame, text: str) -> DataFrame:
    """(token, id): five specials, then the distinct characters by code point."""
    # Characters are deduplicated inside each row first; few distinct ones leave a task.
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("token")).filter("token != ''").distinct()
    first = len(WORDPIECE_SPECIALS)
    chars = row_index(chars, "token").select("token", (F.col("row_index") - 1 + first).alias("id"))
    return _specials(df, "token", [(t, i) for i, t in enumerate(WORDPIECE_SPECIALS)]).unionByName(chars)


def word_vocab(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, id): distinct lower-case words in order, then four specials."""
    distinct = df.select(F.explode(F.transform(tokens, F.lower)).alias("word")).distinct()
    words = row_index(distinct, "word").select("word", (F.col("row_index") - 1).alias("id"))
    size = words.count()
    return words.unionByName(_specials(df, "word", [(t, size + i) for i, t in enumerate(SEQUENCE_SPECIALS)]))


def min_freq_vocab(df: DataFrame, key: str, tokens: Column, min_freq: int = 5) -> DataFrame:
    """(word, n, id): words seen often enough, numbered by first occurrence."""
    seen = df.select(key, F.posexplode(tokens).alias("pos", "word"))
    first = F.struct(key, "pos")
    if isinstance(df.schema[key].dataType, T.IntegralType):
        # One number in the same order, a missing key first: a smallest struct would sort all words of a task.
        first = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    stats = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).filter(F.col("n") >= min_freq)
    return row_index(stats, "first").select("word", "n", (F.col("row_index") - 1).alias("id"))


def pair_counts(words: DataFrame, symbols: Column, weight: str = "n") -> DataFrame:
    """(left, right, n) over a word table whose rows weigh ``weight``."""
    pairs = F.arrays_zip(symbols.alias("l"), F.slice(symbols, F.lit(2), F.size(symbols)).alias("r"))
    zipped = words.filter(F.size(symbols) > 1).select(F.explode(pairs).alias("p"), weight)
    zipped = zipped.select(F.col("p.l").alias("left"), F.col("p.r").alias("right"), weight)
    return zipped.filter("right IS NOT NULL").groupBy("left", "right").agg(F.sum(weight).alias("n"))


def next_token_pairs(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, next_token, n)."""
    pairs = df.withColumn("_t", tokens).filter(F.size("_t") > 1)
    each = F.transform(
        F.slice("_t", F.lit(1), F.size("_t") - 1),
        lambda t, i: F.struct(t.alias("token"), F.get(F.col("_t"), i + 1).alias("next_token")),
    )
    return pairs.select(F.inline(each)).groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("n"))


def save_vocab(vocab: DataFrame, path: str, config: dict | None = None) -> None:
    """The table below ``path``/tokens and its settings as JSON below ``path``/config."""
    vocab.write.mode("overwrite").parquet(f"{path}/tokens")
    row = vocab.sparkSession.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_vocab(spark, path: str, by_id: bool = False) -> DataFrame:
    """The saved table; with ``by_id`` as the inverse map (id, token)."""
    table = spark.read.parquet(f"{path}/tokens")
    return table.select("id", *[c for c in table.columns if c != "id"]) if by_id else table


def load_vocab_config(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/config").first()["value"])


def saved_and_loaded(vocab: DataFrame, by_id: bool = False) -> DataFrame:
    path = fresh_path(vocab.sparkSession, "vocab")
    save_vocab(vocab, path)
    return load_vocab(vocab.sparkSession, path, by_id)


def tokenizer_type(path: Column) -> Column:
    """Guess the tokenizer from its path."""
    p = F.lower(path)
    return (
        F.when(F.contains(p, F.lit("bpe")), "bpe")
        .when(F.contains(p, F.lit("wordpiece")) | F.contains(p, F.lit("word_piece")), "wordpiece")
        .when(F.contains(p, F.lit("sentencepiece")) | F.contains(p, F.lit("sp")), "sentencepiece")
        .otherwise("bpe")
    )
