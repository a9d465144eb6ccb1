"""Text-overlap scores of prediction/reference pairs: BLEU, ROUGE, METEOR."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.stem import stem_word
from textloom.functions.text import ngrams
from textloom.session import parts_of

# Weights of the four BLEU orders.
BLEU_WEIGHTS = {1: (1.0,), 2: (0.5, 0.5), 3: (0.33, 0.33, 0.33), 4: (0.25, 0.25, 0.25, 0.25)}
# METEOR parameters.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def punctuated_tokens(text: Column) -> Column:
    """Lower-case words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]"), F.lit(0))


# Characters of text whose n-grams one task counts.
COUNTED_CHARS = 4_000_000


def corpus_bleu(df: DataFrame, key: list[str], pred_tokens: Column, ref_tokens: Column, size: Column | None = None) -> DataFrame:
    """One row bleu1..bleu4 over the whole corpus, without smoothing.

    Pairs are placed once by key; counting and clipping the n-grams of a pair stays in its
    partition, and only a few sums per order leave it. With ``size``, the length of a row's texts, a
    task gets about COUNTED_CHARS, so that its n-grams fit in memory.
    """
    pairs = df.select(*key, pred_tokens.alias("_p"), ref_tokens.alias("_r"))
    pairs = pairs.repartition(*key) if size is None else pairs.repartition(parts_of(df, size, COUNTED_CHARS), *key)

    def counted_grams(side: str, n: int) -> Column:
        marks = [F.lit(n).alias("order"), F.lit(int(side == "_p")).alias("p"), F.lit(int(side == "_r")).alias("r")]
        return F.transform(ngrams(F.col(side), n), lambda g: F.struct(g.alias("gram"), *marks))

    grams = pairs.select(*key, F.inline(F.concat(*[counted_grams(c, n) for n in range(1, 5) for c in ("_p", "_r")])))
    counted = grams.groupBy(*key, "order", "gram").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    matches = counted.agg(*[F.sum(F.when(F.col("order") == n, F.least("p", "r")).otherwise(0)).alias(f"m{n}") for n in range(1, 5)])
    sizes = pairs.agg(
        F.sum(F.size("_p")).alias("c"), F.sum(F.size("_r")).alias("ref"),
        # A text shorter than n tokens still counts one possible n-gram.
        *[F.sum(F.greatest(F.size("_p") - (n - 1), F.lit(1))).alias(f"d{n}") for n in range(1, 5)],
    )
    totals = sizes.withColumn("m", matches.select(F.struct(*matches.columns).alias("m")).scalar())
    penalty = F.when(F.col("c") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.col("c")))
    scores = []
    for order, weights in BLEU_WEIGHTS.items():
        logs = [F.lit(w) * F.log(F.col(f"m.m{n}") / F.col(f"d{n}")) for n, w in enumerate(weights, 1)]
        exponent = logs[0]
        for part in logs[1:]:
            exponent = exponent + part
        scores.append(F.coalesce(penalty * F.exp(exponent), F.lit(0.0)).alias(f"bleu{order}"))
    return totals.select(*scores)


def rouge_tokens(text: Column) -> Column:
    """Words with full stops removed, as sentences are split on them."""
    return F.regexp_extract_all(F.replace(text, F.lit("."), F.lit(" ")), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def _prf(common: Column, n_pred: Column, n_ref: Column) -> list[Column]:
    p = F.coalesce(F.try_divide(common, n_pred), F.lit(0.0))
    r = F.coalesce(F.try_divide(common, n_ref), F.lit(0.0))
    return [p, r, 2 * p * r / (p + r + 1e-8)]


def rouge_n(df: DataFrame, pred_tokens: Column, ref_tokens: Column, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row: mean precision, recall, F of n-gram sets. Array expressions only, no shuffle of text."""
    rows = df.select(pred_tokens.alias("_p"), ref_tokens.alias("_r"))
    sets = rows.select(
        *[F.array_distinct(ngrams(F.col(c), n)).alias(f"{c}{n}") for n in orders for c in ("_p", "_r")]
    )
    out = []
    for n in orders:
        common = F.size(F.array_intersect(f"_p{n}", f"_r{n}"))
        for name, value in zip("prf", _prf(common, F.size(f"_p{n}"), F.size(f"_r{n}"))):
            out.append(F.avg(value).alias(f"rouge{n}_{name}"))
    return sets.agg(*out)


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by the bit-parallel recurrence on one big integer."""
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        matched = row & places.get(token, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def common_words(a: list, b: list) -> set:
    """The words of one longest common subsequence: walking back, equal ends are taken, else ``a`` is cut only if that keeps more.

    Rows of the bit-parallel recurrence are kept (one bit a cell); an unset bit i of row j stands where the first i + 1 words of
    ``a`` have one more in common with the first j of ``b`` than the first i have.
    """
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = [full]
    for token in b:
        matched = rows[-1] & places.get(token, 0)
        rows.append(((rows[-1] + matched) | (rows[-1] - matched)) & full)
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(a[i])
        elif length(i - 1, j) > length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def sentences(text: str) -> list[list[str]]:
    """Words of the stretches between full stops; empty stretches count as none."""
    return [" ".join(part.split()).split(" ") for part in text.split(".") if part]


def summary_overlap(pred: str, ref: str) -> tuple[int, int, int]:
    """(common, words of pred, words of ref), different words each: common are the words of the union, over all pairs of sentences, of a longest common subsequence."""
    ours, theirs = sentences(pred), sentences(ref)
    union: set = set()
    for r in theirs:
        for p in ours:
            union |= common_words(r, p)
    return len(union), len({w for s in ours for w in s}), len({w for s in theirs for w in s})


def rouge_l(df: DataFrame, pred: Column, ref: Column) -> DataFrame:
    """One row: mean precision, recall, F of the summary-level longest common subsequence of two texts (null: empty).

    Fixed by the published score that is asked for: sentences end at full stops, matched words are united over all sentence
    pairs, and words count once a text.
    """

    @F.pandas_udf("struct<c:int,np:int,nr:int>")
    def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summary_overlap(x or "", y or "") for x, y in zip(a, b)], columns=["c", "np", "nr"]).astype("int32")

    rows = df.select(overlap(pred, ref).alias("o")).select("o.*")
    values = _prf(F.col("c"), F.col("np"), F.col("nr"))
    return rows.agg(*[F.avg(v).alias(f"rougel_{n}") for n, v in zip("prf", values)])


def _f_measure(common: int, n_pred: int, n_ref: int) -> float:
    return 2 * common / (n_pred + n_ref) if common else 0.0


def stemmed_words(text: str, stem=stem_word) -> list[str]:
    """ASCII words; those over three letters stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", text.lower())]


def rouge_f(pred: list[str], ref: list[str]) -> tuple[float, float, float]:
    """F of unigram and bigram multisets and of the longest common subsequence."""
    out = []
    for n in (1, 2):
        p, r = Counter(zip(*[pred[i:] for i in range(n)])), Counter(zip(*[ref[i:] for i in range(n)]))
        out.append(_f_measure(sum((p & r).values()), sum(p.values()), sum(r.values())))
    out.append(_f_measure(lcs_length(pred, ref), len(pred), len(ref)))
    return tuple(out)


def rouge_fmeasure(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """One row: mean ROUGE-1, -2, -L F-measure on stemmed words."""

    @F.pandas_udf("rouge1 double, rouge2 double, rougeL double")
    def scores(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        stem = lru_cache(200_000)(stem_word)
        rows = [rouge_f(stemmed_words(p, stem), stemmed_words(r, stem)) for p, r in zip(pred, ref)]
        return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])

    rows = df.select(scores(prediction, reference).alias("s"))
    return rows.agg(*[F.avg(f"s.{c}").alias(c) for c in ("rouge1", "rouge2", "rougeL")])


def align(pred: list[str], ref: list[str], stem=stem_word) -> list[tuple[int, int]]:
    """Matched positions: equal words first, then equal stems; later words are matched first."""
    matches: list[tuple[int, int]] = []
    left, right = list(enumerate(pred)), list(enumerate(ref))
    for form in (lambda w: w, stem):
        free: dict[str, list[int]] = {}
        for j, word in right:
            free.setdefault(form(word), []).append(j)
        taken_left, taken_right = set(), set()
        for i, word in reversed(left):
            options = free.get(form(word))
            if options:
                j = options.pop()
                matches.append((i, j))
                taken_left.add(i)
                taken_right.add(j)
        left = [(i, w) for i, w in left if i not in taken_left]
        right = [(j, w) for j, w in right if j not in taken_right]
    return sorted(matches)


def meteor_score(pred: list[str], ref: list[str], stem=stem_word) -> float:
    matches = align(pred, ref, stem)
    if not matches:
        return 0.0
    precision, recall = len(matches) / len(pred), len(matches) / len(ref)
    mean = precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matches, matches[1:]))
    return (1 - GAMMA * (chunks / len(matches)) ** BETA) * mean


def meteor(df: DataFrame, pred_tokens: Column, ref_tokens: Column) -> DataFrame:
    """One row: mean METEOR with exact and stem matches (no synonym lexicon)."""

    @F.pandas_udf("double")
    def scores(pred: pd.Series, ref: pd.Series) -> pd.Series:
        stem = lru_cache(200_000)(stem_word)
        return pd.Series([meteor_score(list(p), list(r), stem) for p, r in zip(pred, ref)], dtype="float64")

    return df.select(scores(pred_tokens, ref_tokens).alias("s")).agg(F.avg("s").alias("meteor"))
