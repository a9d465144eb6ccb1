"""Byte-pair encoding: training on the distinct-word table, encoding, decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.encoding import MAX_VOCAB, decode_column, encode_column, vocab_dict
from textloom.session import collect_bounded, pin

END = "</w>"
BASE_SIZE = 256
UNKNOWN = "[UNK]"
# Most frequent pairs that a window of merges is limited to, and different stretches of symbols that it is played on.
WINDOW_PAIRS = 4000
WINDOW_SEGMENTS = 50_000
# Different keys that a task adds up before it passes them on.
COMBINED = 200_000


def _merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the lowest-rank merge, wherever it occurs, until none applies."""
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        joined, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and symbols[i] == best[0] and symbols[i + 1] == best[1]:
                joined.append(best[0] + best[1])
                i += 2
            else:
                joined.append(symbols[i])
                i += 1
        symbols = joined
    return symbols


def _words_after(state: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """The word table after a list of merges; words that became one symbol are finished and go."""
    ranks = {pair: i for i, pair in enumerate(merges)}

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [_merge_symbols(line.split(" "), ranks) for line in pdf["symbols"]]
            out = pd.DataFrame({"symbols": pd.Series([" ".join(x) for x in lines], dtype=object), "n": pdf["n"].to_numpy()})
            yield out[np.fromiter((len(x) > 1 for x in lines), bool, len(lines))]

    return state.mapInPandas(apply, "symbols string, n bigint")


def _summed(found: dict[str, int], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({columns[0]: pd.Series(list(found), dtype=object), columns[1]: pd.Series(list(found.values()), dtype="int64")})


def _pair_totals(state: DataFrame) -> DataFrame:
    """(left, right, n); pairs are combined inside each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        for pdf in batches:
            for line, n in zip(pdf["symbols"], pdf["n"]):
                parts = line.split(" ")
                for pair in map("{} {}".format, parts, parts[1:]):
                    found[pair] = found.get(pair, 0) + n
            if len(found) > COMBINED:
                yield _summed(found, ["pair", "n"])
                found = {}
        yield _summed(found, ["pair", "n"])

    pairs = state.mapInPandas(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.split("pair", " ")[0].alias("left"), F.split("pair", " ")[1].alias("right"), "n")


def _segments(state: DataFrame, live: set[tuple[str, str]]) -> DataFrame:
    """(symbols, n): the words cut between neighbours that are no live pair, equal stretches added up."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        for pdf in batches:
            for line, n in zip(pdf["symbols"], pdf["n"]):
                parts, start = line.split(" "), 0
                for i in range(1, len(parts) + 1):
                    if i == len(parts) or (parts[i - 1], parts[i]) not in live:
                        if i - start > 1:
                            key = " ".join(parts[start:i])
                            found[key] = found.get(key, 0) + n
                        start = i
            if len(found) > COMBINED:
                yield _summed(found, ["symbols", "n"])
                found = {}
        yield _summed(found, ["symbols", "n"])

    return state.mapInPandas(cut, "symbols string, n bigint").groupBy("symbols").agg(F.sum("n").alias("n"))


def window_merges(segments: list[tuple[str, int]], least: int, most: int, spelled: set[str]) -> list[tuple[str, str]]:
    """The merges, one at a time, of weighted symbol stretches while the best pair occurs ``least`` times, ``most`` of them.

    A merge that spells a symbol which exists already ends the window. ``spelled`` holds all symbols made so far and grows.
    """
    rows = [line.split(" ") for line, _ in segments]
    weights = [n for _, n in segments]
    counts: dict[tuple[str, str], int] = {}
    where: dict[tuple[str, str], set[int]] = {}
    for i, row in enumerate(rows):
        for pair in zip(row, row[1:]):
            counts[pair] = counts.get(pair, 0) + weights[i]
            where.setdefault(pair, set()).add(i)
    heap = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(merges) < most:
        n, pair = heapq.heappop(heap)
        if counts.get(pair) != -n:
            continue
        if -n < least:
            break
        merges.append(pair)
        changed = set()
        for i in where.pop(pair):
            row = rows[i]
            for old in zip(row, row[1:]):
                counts[old] -= weights[i]
                changed.add(old)
                if old != pair:
                    where[old].discard(i)
            row = rows[i] = _merge_symbols(row, {pair: 0})
            for new in zip(row, row[1:]):
                counts[new] = counts.get(new, 0) + weights[i]
                changed.add(new)
                where.setdefault(new, set()).add(i)
        for other in changed:
            if counts[other] > 0:
                heapq.heappush(heap, (-counts[other], other))
            else:
                del counts[other]
        again = "".join(pair) in spelled
        spelled.add("".join(pair))
        if again:
            break
    return merges


def bpe_train(counts: DataFrame, num_merges: int, end_mark: str | None = END, pairs: int = WINDOW_PAIRS, segments: int = WINDOW_SEGMENTS) -> DataFrame:
    """(rank, left, right, merged, id) learned from ``counts(word, n)``, as if one pair at a time; ties by (left, right).

    The merges come in windows. A merge never raises a count: a pair that it makes, such as (ab, c), stands at some places
    where (b, c) stood. So while the best pair is more frequent than the best one outside the ``pairs`` most frequent, no
    merge crosses neighbours outside that list, and the words fall into stretches between them that go their ways alone.
    Spark counts the pairs, adds up equal stretches over all words and applies the window's merges; the driver plays the
    window on ``segments`` different stretches at most (a window with more takes a shorter list). A symbol that is spelled in
    two ways would mix places inside and outside the list, so its merge ends the window. Symbols hold no white space.
    """
    spark = counts.sparkSession
    if num_merges > MAX_VOCAB:
        raise ValueError(f"at most {MAX_VOCAB} merges")
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    symbols = F.concat(chars, F.array(F.lit(end_mark))) if end_mark else chars
    state = counts.select(F.array_join(symbols, " ").alias("symbols"), "n").filter(F.contains("symbols", F.lit(" ")))
    state = pin(state.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "bpe-words")
    merges: list[tuple[str, str]] = []
    spelled: set[str] = set()
    width = pairs
    while len(merges) < num_merges:
        ranked = _pair_totals(state).orderBy(F.desc("n"), "left", "right").limit(pairs + 1).collect()
        if not ranked:
            break
        while True:
            least = ranked[width]["n"] + 1 if width < len(ranked) else 1
            live = {(r["left"], r["right"]) for r in ranked[:width] if r["n"] >= least}
            if len(live) < 2:
                new = [(ranked[0]["left"], ranked[0]["right"])]
                spelled.add("".join(new[0]))
                break
            found = _segments(state, live).limit(segments + 1).collect()
            if len(found) <= segments:
                new = window_merges([(r["symbols"], r["n"]) for r in found], least, num_merges - len(merges), spelled)
                break
            width = max(1, width // 2)
        merges.extend(new)
        state = pin(_words_after(state, new), "bpe-words")
        width = min(pairs, 2 * width)
    rows = [(i, left, right, left + right, BASE_SIZE + i) for i, (left, right) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string, merged string, id bigint")


def bpe_vocab(merges: DataFrame, end_mark: str | None = END) -> DataFrame:
    """(token, id): 256 single characters, the merges, and the end mark last."""
    base = merges.sparkSession.range(BASE_SIZE).select(F.char(F.col("id")).alias("token"), "id")
    # char() wraps 0 to an empty string; keep it as the NUL character.
    base = base.withColumn("token", F.when(F.col("id") == 0, F.lit("\x00")).otherwise(F.col("token")))
    # Two different pairs can spell the same token: the later id wins, as in the training table.
    learned = merges.groupBy(F.col("merged").alias("token")).agg(F.max("id").alias("id"))
    vocab = base.unionByName(learned)
    if end_mark:
        end = merges.agg((F.count(F.lit(1)) + BASE_SIZE).alias("id")).select(F.lit(end_mark).alias("token"), "id")
        vocab = vocab.unionByName(end)
    return vocab


def _word_encoder(ranks: dict[tuple[str, str], int], vocab: dict[str, int], end_mark: str | None):
    def encode(word: str) -> list[int]:
        symbols = list(word) + ([end_mark] if end_mark else [])
        return [vocab.get(s, 0) for s in _merge_symbols(symbols, ranks)]

    return encode


def bpe_encode(text: Column, merges: DataFrame, end_mark: str | None = END, max_length: int | None = None) -> Column:
    """Ids by repeatedly applying the lowest-rank merge; unknown symbols are 0."""
    rows = collect_bounded(merges, MAX_VOCAB, "merge table")
    ranks = {(r["left"], r["right"]): r["rank"] for r in rows}
    encoder = _word_encoder(ranks, vocab_dict(bpe_vocab(merges, end_mark)), end_mark)
    return encode_column(text, encoder, max_length=max_length)


def bpe_decode(ids: Column, merges: DataFrame, end_mark: str = END) -> Column:
    tokens = {i: t for t, i in vocab_dict(bpe_vocab(merges, end_mark)).items()}
    # A spelling reached by two merges keeps both ids when decoding.
    tokens.update({int(r["id"]): r["merged"] for r in collect_bounded(merges, MAX_VOCAB, "merge table")})
    return decode_column(ids, tokens, lambda parts: "".join(parts).replace(end_mark, " ").strip(), UNKNOWN)
