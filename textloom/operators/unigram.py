"""Unigram language-model tokenizer (Kudo 2018): EM over the distinct-word table."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.encoding import MAX_VOCAB, decode_column, encode_column
from textloom.operators.ordering import row_index
from textloom.session import collect_bounded, pin

MARK = "▁"
# Special pieces in id order.
SPECIALS = ["<pad>", "<unk>", "<s>", "</s>"]
UNKNOWN_SCORE = -20.0
MAX_SEEDS = 1_000_000
# Cells (word, start, length) of a lattice that is worked on at once.
CELLS = 1_000_000


def normalized_words(counts: DataFrame) -> DataFrame:
    """NFKC-normalised words with the boundary mark in front; normalising may split a word."""

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (MARK + part, n)
                for word, n in zip(pdf["word"], pdf["n"])
                for part in unicodedata.normalize("NFKC", word).split()
            ]
            yield pd.DataFrame(rows, columns=["word", "n"])

    marked = counts.select("word", "n").mapInPandas(normalise, "word string, n bigint")
    return marked.groupBy("word").agg(F.sum("n").alias("n"))


def _segment_scores(word: str, scores: dict[str, float], longest: int) -> list[list[tuple[int, float]]]:
    """For every end position the (start, score) of the pieces that end there."""
    ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
    for start in range(len(word)):
        for end in range(start + 1, min(len(word), start + longest) + 1):
            score = scores.get(word[start:end])
            if score is not None:
                ends[end].append((start, score))
            elif end == start + 1:
                ends[end].append((start, UNKNOWN_SCORE))
    return ends


def lattice(words: list[str], places: dict[str, int], longest: int) -> np.ndarray:
    """Piece numbers (word, start, length - 1) of words of any lengths; -1 where no piece stands."""
    width = max(map(len, words))
    ids = np.full((len(words), width, longest), -1, np.int32)
    get = places.get
    for w, word in enumerate(words):
        n = len(word)
        for start in range(n):
            for end in range(start + 1, min(n, start + longest) + 1):
                place = get(word[start:end])
                if place is not None:
                    ids[w, start, end - start - 1] = place
    return ids


def _log_sums(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=1)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(values - top[:, None]).sum(axis=1))


def expected_counts(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Posterior expected count of every piece over weighted words (forward-backward), all words of a lattice at once.

    ``scores`` of pieces that are out are minus infinity; a character without a piece costs UNKNOWN_SCORE.
    """
    count, width, longest = ids.shape
    costs = np.append(scores, -np.inf)[ids]
    inside = np.arange(width)[None, :] < lengths[:, None]
    costs[:, :, 0] = np.where(inside & ~np.isfinite(costs[:, :, 0]), UNKNOWN_SCORE, costs[:, :, 0])
    forward = np.full((count, width + 1), -np.inf)
    forward[:, 0] = 0.0
    for end in range(1, width + 1):
        sizes = np.arange(1, min(longest, end) + 1)
        forward[:, end] = _log_sums(forward[:, end - sizes] + costs[:, end - sizes, sizes - 1])
    backward = np.full((count, width + 1), -np.inf)
    backward[np.arange(count), lengths] = 0.0
    for start in range(width - 1, -1, -1):
        sizes = np.arange(1, min(longest, width - start) + 1)
        onward = _log_sums(backward[:, start + sizes] + costs[:, start, sizes - 1])
        backward[:, start] = np.where(start < lengths, onward, backward[:, start])
    total = forward[np.arange(count), lengths]
    out = np.zeros(len(scores))
    for size in range(1, min(longest, width) + 1):
        place = ids[:, : width - size + 1, size - 1]
        share = np.exp(forward[:, : width - size + 1] + costs[:, : width - size + 1, size - 1] + backward[:, size:] - total[:, None]) * weights[:, None]
        known = place >= 0
        out += np.bincount(place[known], share[known], len(scores))
    return np.where(np.isfinite(scores), out, 0.0)


def _batches(lengths: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Row numbers in order of length, so many at a time that their lattice has CELLS cells at most (or one word)."""
    order, start = np.argsort(lengths, kind="stable"), 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * lengths[order[end]] * longest <= CELLS:
            end += 1
        yield order[start:end]
        start = end


def best_pieces(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """Most probable segmentation (Viterbi)."""
    ends = _segment_scores(word, scores, longest)
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = max((best[start][0] + p, start) for start, p in ends[end])
    pieces, at = [], len(word)
    while at > 0:
        start = best[at][1]
        pieces.append(word[start:at])
        at = start
    return pieces[::-1]


def required_chars(words: DataFrame, coverage: float) -> DataFrame:
    """(token, n): the most frequent characters that cover the given share of the text."""
    chars = words.select(F.explode(F.split("word", "")).alias("token"), "n").filter("token != ''")
    rows = collect_bounded(chars.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token"), 200_000, "characters")
    total, covered, kept = sum(r["n"] for r in rows), 0, []
    for r in rows:
        if covered >= coverage * total:
            break
        covered += r["n"]
        kept.append((r["token"], r["n"]))
    return words.sparkSession.createDataFrame(kept, "token string, n bigint")


def seed_pieces(words: DataFrame, seeds: int, longest: int) -> DataFrame:
    """(token, n): frequent substrings, ranked by count times length."""
    length = F.length("word")

    def from_start(i: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(F.lit(longest), length - i + 1))
        return F.transform(sizes, lambda size: F.substring("word", i, size))

    inside = F.flatten(F.transform(F.sequence(F.lit(1), length - 1), from_start))
    pieces = words.filter(length >= 2).select("n", F.explode(inside).alias("token"))
    # The boundary mark may only open a piece.
    pieces = pieces.filter(F.instr(F.substring("token", 2, longest), MARK) == 0)
    counted = pieces.groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 2")
    # A sort with a limit would send that many rows of every partition to the driver; positions are found on the cluster.
    placed = row_index(counted, F.desc(F.col("n") * F.length("token")), "token", name="_place")
    return placed.filter(F.col("_place") <= seeds).drop("_place")


def unigram_train(
    counts: DataFrame, vocab_size: int, seeds: int = MAX_SEEDS, longest: int = 16, coverage: float = 0.9995,
    shrink: float = 0.6, steps: int = 2,
) -> DataFrame:
    """(token, score, id) learned from ``counts(word, n)``; pad, unk, bos, eos are 0 to 3.

    Seeds are the substrings that occur twice or more, the best MAX_SEEDS by count times length. The pieces inside each
    word are numbered once, in a pinned table; the E-step runs over it on the cluster with one array of scores shipped along
    (8 bytes a seed), the M-step is one aggregation. Rare pieces are pruned until the size fits.
    """
    if vocab_size > MAX_VOCAB or seeds > MAX_SEEDS:
        raise ValueError("vocabulary or seed table too large")
    spark = counts.sparkSession
    words = pin(normalized_words(counts), "unigram-words")
    chars = {r["token"]: float(r["n"]) for r in required_chars(words, coverage).collect()}
    weights = {r["token"]: float(r["n"]) for r in collect_bounded(seed_pieces(words, seeds, longest), seeds, "seeds")}
    weights.update({c: n for c, n in chars.items()})
    target = max(vocab_size - len(SPECIALS), len(chars))
    tokens = sorted(weights)
    places = {t: i for i, t in enumerate(tokens)}
    weight = np.array([weights[t] for t in tokens])
    fixed = np.array([t in chars for t in tokens])
    shipped = spark.sparkContext.broadcast(places)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every word with its lattice, which stays the same while scores change."""
        for pdf in batches:
            for rows in _batches(pdf["word"].str.len().to_numpy(), longest):
                part = pdf.iloc[rows]
                ids = lattice(list(part["word"]), shipped.value, longest)
                sizes = part["word"].str.len().to_numpy()
                yield pd.DataFrame({"n": part["n"].to_numpy(), "ids": [ids[i, :size].ravel() for i, size in enumerate(sizes)]})

    # A word is work proportional to its length, so the small table is spread over all cores.
    spread_words = words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    lattices = pin(spread_words.mapInPandas(numbered, "n bigint, ids array<int>"), "unigram-lattices", compression="zstd")
    shipped.unpersist()
    while True:
        for _ in range(steps):
            with np.errstate(divide="ignore"):
                scores = spark.sparkContext.broadcast(np.log(weight) - math.log(weight.sum()))

            def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = np.zeros(len(scores.value))
                for batch in batches:
                    sizes = np.diff(batch.column("ids").offsets.to_numpy()) // longest
                    flat = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
                    ends = np.cumsum(sizes) * longest
                    n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                    for rows in _batches(sizes, longest):
                        ids = np.full((len(rows), sizes[rows].max(), longest), -1, np.int32)
                        for i, r in enumerate(rows):
                            ids[i, : sizes[r]] = flat[ends[r] - sizes[r] * longest : ends[r]].reshape(-1, longest)
                        found += expected_counts(ids, sizes[rows], n[rows], scores.value)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["piece", "w"])

            summed = lattices.mapInArrow(expect, "piece long, w double").groupBy("piece").agg(F.sum("w").alias("w")).toArrow()
            fresh = np.zeros(len(tokens))
            fresh[summed.column("piece").to_numpy()] = summed.column("w").to_numpy()
            weight = np.where(weight > 0, np.maximum(fresh, np.where(fixed, 0.5, 0.0)), 0.0)
            scores.unpersist()
        alive = int((weight > 0).sum())
        if alive <= target:
            break
        keep = max(target, int(alive * shrink))
        # Tokens are in order, so a stable sort breaks ties by token.
        ranked = np.lexsort((-weight, ~fixed))
        weight[ranked[keep:]] = 0.0
    total = math.log(weight.sum())
    ranked = [i for i in np.argsort(-weight, kind="stable") if weight[i] > 0]
    rows = [(t, 0.0, i) for i, t in enumerate(SPECIALS)]
    rows += [(tokens[p], math.log(weight[p]) - total, i + len(SPECIALS)) for i, p in enumerate(ranked)]
    return spark.createDataFrame(rows, "token string, score double, id bigint")


def _tables(vocab: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    rows = collect_bounded(vocab, MAX_VOCAB, "vocabulary")
    ids = {r["token"]: int(r["id"]) for r in rows}
    return {r["token"]: r["score"] for r in rows if r["token"] not in SPECIALS}, ids


def unigram_encode(text: Column, vocab: DataFrame, max_length: int | None = None) -> Column:
    scores, ids = _tables(vocab)
    longest = max(len(t) for t in scores)

    def encode(word: str) -> list[int]:
        parts = unicodedata.normalize("NFKC", word).split()
        return [ids.get(p, 1) for part in parts for p in best_pieces(MARK + part, scores, longest)]

    return encode_column(text, encode, max_length=max_length)


def unigram_decode(ids: Column, vocab: DataFrame) -> Column:
    _, table = _tables(vocab)
    tokens = {i: t for t, i in table.items() if t not in ("<pad>", "<s>", "</s>")}
    return decode_column(ids, tokens, lambda parts: "".join(parts).replace(MARK, " ").strip(), "")


