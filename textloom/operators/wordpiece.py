"""WordPiece: vocabulary by frequency times length, greedy longest-match encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.encoding import MAX_VOCAB, decode_column, encode_column, vocab_dict
from textloom.operators.ordering import row_index
from textloom.session import pin, scalar

SHORT = 16


def _ranked(pieces: DataFrame, n: int) -> DataFrame:
    return pieces.orderBy(F.desc("score"), F.desc(F.length("token")), "token").limit(n)


def piece_scores(counts: DataFrame, n: int) -> DataFrame:
    """(token, score): the ``n`` best substrings of at least two characters.

    The score of a substring is its length times the count of words that contain it. Substrings up
    to SHORT characters are scored directly. A longer one occurs in at most as many words as the
    SHORT characters it starts with, so it is only generated where that bound still reaches the
    n-th best short score. Nothing is lost, and a word of thousands of characters stays cheap.
    """
    length = F.length("word")
    starts = F.sequence(F.lit(1), length - 1)

    def from_start(i: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(F.lit(SHORT), length - i + 1))
        return F.transform(sizes, lambda size: F.substring("word", i, size))

    inside = F.array_distinct(F.flatten(F.transform(starts, from_start)))
    words = counts.filter(length >= 2)
    short = words.select("n", F.explode(inside).alias("token")).groupBy("token").agg(F.sum("n").alias("words"))
    short = pin(short.withColumn("score", F.col("words") * F.length("token")), "short-pieces")
    best = _ranked(short, n)
    floor = scalar(best.agg(F.when(F.count(F.lit(1)) == n, F.min("score")).otherwise(F.lit(0)).alias("m")), F.col("m"))

    left = length - F.col("start") + 1
    long_words = words.filter(length > SHORT)
    grams = long_words.select("word", "n", F.explode(F.sequence(F.lit(1), length - SHORT)).alias("start"))
    grams = grams.withColumn("token", F.substring("word", F.col("start"), F.lit(SHORT)))
    bound = short.filter(F.length("token") == SHORT).select("token", F.col("words").alias("seen"))
    open_ends = grams.join(bound, "token").filter(F.col("seen") * left >= floor)
    least = F.greatest(F.lit(SHORT + 1), F.ceil(floor / F.col("seen")).cast("int"))
    sizes = F.when(least <= left, F.sequence(least, left))
    long = open_ends.select("word", "n", "start", F.explode(sizes).alias("size"))
    long = long.select("word", "n", F.substring("word", F.col("start"), F.col("size")).alias("token")).distinct()
    long = long.groupBy("token").agg(F.sum("n").alias("words"))
    long = long.withColumn("score", F.col("words") * F.length("token"))
    return _ranked(best.select("token", "score").unionByName(long.select("token", "score")), n)


def wordpiece_train(counts: DataFrame, chars: DataFrame, vocab_size: int) -> DataFrame:
    """(token, id): specials and characters from ``chars``, then the best substrings."""
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"at most {MAX_VOCAB} tokens")
    chars = pin(chars, "chars")
    size = chars.count()
    if vocab_size <= size:
        return chars
    best = piece_scores(counts, vocab_size - size)
    ranked = row_index(best.withColumn("len", F.length("token")), F.desc("score"), F.desc("len"), "token")
    return chars.unionByName(ranked.select("token", (F.col("row_index") - 1 + size).alias("id")))


def _word_encoder(vocab: dict[str, int]):
    unknown = vocab["[UNK]"]
    longest = max(len(t) for t in vocab)

    def encode(word: str) -> list[int]:
        if word in vocab:
            return [vocab[word]]
        ids, at = [], 0
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                piece = word[at:end]
                found = vocab.get(piece, vocab.get("##" + piece))
                if found is not None:
                    ids.append(found)
                    at = end
                    break
            else:
                ids.append(unknown)
                at += 1
        return ids

    return encode


def wordpiece_encode(text: Column, vocab: DataFrame, max_length: int | None = None) -> Column:
    """[CLS], greedy longest matches per word, [SEP]."""
    table = vocab_dict(vocab)
    return encode_column(text, _word_encoder(table), [table["[CLS]"]], [table["[SEP]"]], max_length)


def wordpiece_decode(ids: Column, vocab: DataFrame) -> Column:
    tokens = {i: t for t, i in vocab_dict(vocab).items()}
    dropped = {"[CLS]", "[SEP]", "[PAD]"}

    def join(parts: list[str]) -> str:
        return " ".join(p for p in parts if p not in dropped).replace(" ##", "").strip()

    return decode_column(ids, tokens, join, "[UNK]")
