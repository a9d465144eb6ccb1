import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bpe, unigram, vocab as vc, wordpiece as wp


def counts_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def brute_bpe(counts, merges, end):
    """One merge at a time over symbol tuples."""
    table = {tuple(w) + ((end,) if end else ()): n for w, n in counts.items()}
    learned = []
    for _ in range(merges):
        pairs = Counter()
        for symbols, n in table.items():
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        learned.append(best)
        fresh = Counter()
        for symbols, n in table.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            fresh[tuple(out)] += n
        table = fresh
    return learned


TEXT = "set new new renew reset renew aaaa aaa banana bandana newest widest lower low low low $1 a\\b (x) [x]"


@pytest.mark.parametrize("end", [None, "</w>"])
def test_bpe_training_equals_one_at_a_time(spark, end):
    counts = Counter(TEXT.split())
    got = bpe.bpe_train(counts_frame(spark, counts), 40, end).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == brute_bpe(counts, 40, end)


def test_bpe_batches_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = vc.word_counts(docs, tx.words(F.col("text"))).collect()
    counts = {r["word"]: r["n"] for r in rows}
    got = bpe.bpe_train(counts_frame(spark, counts), 40).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == brute_bpe(counts, 40, "</w>")


def test_bpe_round_trip_and_unknowns(spark):
    merges = bpe.bpe_train(counts_frame(spark, Counter(TEXT.split())), 20)
    df = spark.createDataFrame([(1, " renew  bandana\nlow "), (2, ""), (3, None), (4, "日 low")], "id int, t string")
    enc = df.select("id", bpe.bpe_encode(F.col("t"), merges).alias("ids"))
    rows = {r["id"]: r for r in enc.select("id", "ids", bpe.bpe_decode(F.col("ids"), merges).alias("d")).collect()}
    assert rows[1]["d"] == "renew bandana low"
    assert rows[2]["ids"] == [] and rows[3]["ids"] is None
    assert rows[4]["ids"][0] == 0
    short = df.filter("id = 1").select(bpe.bpe_encode(F.col("t"), merges, max_length=2).alias("ids")).first()
    assert len(short["ids"]) == 2


@pytest.mark.parametrize(("pairs", "segments"), [(1, 5), (3, 2), (10, 50), (100, 100_000)])
def test_bpe_windows_of_any_size_give_the_same_merges(spark, pairs, segments):
    counts = Counter((TEXT + " abcabc ababab bcabca xabcx abc bc aab aaab abcd bcd").split())
    got = bpe.bpe_train(counts_frame(spark, counts), 30, None, pairs=pairs, segments=segments).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == brute_bpe(counts, 30, None)


@pytest.mark.parametrize("seed", range(300))
def test_windows_of_merges_equal_one_at_a_time(seed):
    """Words over few letters, where symbols are spelled in several ways; stretches cut as the word table would be."""
    rng = random.Random(seed)
    words = Counter("".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(40))
    want, merges, spelled = brute_bpe(words, 30, None), [], set()
    table = [(list(w), n) for w, n in words.items()]
    while len(merges) < 30:
        totals = Counter()
        for row, n in table:
            for pair in zip(row, row[1:]):
                totals[pair] += n
        ranked = sorted(totals.items(), key=lambda x: (-x[1], x[0]))
        if not ranked:
            break
        width = rng.randrange(1, 6)
        least = ranked[width][1] + 1 if width < len(ranked) else 1
        live = {p for p, n in ranked[:width] if n >= least}
        if len(live) < 2:
            new = [ranked[0][0]]
            spelled.add("".join(new[0]))
        else:
            stretches = Counter()
            for row, n in table:
                cuts = [0] + [i for i in range(1, len(row)) if (row[i - 1], row[i]) not in live] + [len(row)]
                for a, b in zip(cuts, cuts[1:]):
                    if b - a > 1:
                        stretches[" ".join(row[a:b])] += n
            new = bpe.window_merges(list(stretches.items()), least, 30 - len(merges), spelled)
        merges += new
        ranks = {p: i for i, p in enumerate(new)}
        table = [(bpe._merge_symbols(row, ranks), n) for row, n in table]
    assert merges == want


@pytest.mark.parametrize("n", [5, 40, 100_000])
def test_wordpiece_scores_equal_brute_force(spark, n):
    counts = Counter(TEXT.split())
    counts.update({"abcdefghijklmnopqrstuvwxyz": 3, "xabcdefghijklmnopqrstuvwxy": 2, "q" * 40: 1})
    score = Counter()
    for word, c in counts.items():
        for piece in {word[i:j] for i, j in combinations(range(len(word) + 1), 2) if j - i >= 2}:
            score[piece] += c * len(piece)
    want = sorted(score.items(), key=lambda kv: (-kv[1], -len(kv[0]), kv[0]))[:n]
    got = wp.piece_scores(counts_frame(spark, counts), n).collect()
    assert sorted((r["token"], r["score"]) for r in got) == sorted(want)


def test_wordpiece_encode_decode(spark):
    vocab = spark.createDataFrame(
        [(t, i) for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "new", "##est", "l", "##ow", "low"])],
        "token string, id bigint",
    )
    df = spark.createDataFrame([(1, "newest low low?")], "id int, t string")
    enc = df.select(wp.wordpiece_encode(F.col("t"), vocab).alias("ids"))
    row = enc.select("ids", wp.wordpiece_decode(F.col("ids"), vocab).alias("d")).first()
    assert row["ids"] == [2, 5, 6, 9, 9, 1, 3]
    assert row["d"] == "newest low low [UNK]"


def splits(word):
    for mask in range(1 << (len(word) - 1)):
        parts, start = [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or mask >> (i - 1) & 1:
                parts.append(word[start:i])
                start = i
        yield parts


def test_unigram_inference_equals_enumeration():
    scores = {"a": -2.0, "b": -2.5, "ab": -2.2, "ba": -3.0, "aba": -4.0}
    word = "ababa"
    ways = [p for p in splits(word) if all(x in scores for x in p)]
    weight = {tuple(p): math.exp(sum(scores[x] for x in p)) for p in ways}
    total = sum(weight.values())
    want = Counter()
    for parts, w in weight.items():
        for piece in parts:
            want[piece] += w / total
    # The same word twice beside a shorter and a longer one of other pieces, all in one lattice.
    tokens = sorted(scores)
    words, n = [word, "b", word, "ababaab"], np.array([2.0, 0.0, 1.0, 0.0])
    ids = unigram.lattice(words, {t: i for i, t in enumerate(tokens)}, 3)
    got = unigram.expected_counts(ids, np.array([len(w) for w in words]), n, np.array([scores[t] for t in tokens]))
    assert dict(zip(tokens, got)) == pytest.approx({t: 3 * want[t] for t in tokens})
    assert unigram.best_pieces(word, scores, 3) == list(max(weight, key=weight.get))


def test_unigram_lattices_leave_out_what_is_pruned():
    scores = np.array([-1.0, -np.inf, -2.0])
    ids = unigram.lattice(["axa"], {"a": 0, "x": 1, "ax": 2}, 2)
    got = unigram.expected_counts(ids, np.array([3]), np.array([1.0]), scores)
    ways = [math.exp(-1 - 20 - 1), math.exp(-2 - 1)]
    assert got == pytest.approx([(2 * ways[0] + ways[1]) / sum(ways), 0.0, ways[1] / sum(ways)])


def test_unigram_seeds_equal_brute_force(spark):
    words = {unigram.MARK + w: n for w, n in Counter(TEXT.split()).items()}
    want = Counter()
    for word, n in words.items():
        for i, j in combinations(range(len(word) + 1), 2):
            if 2 <= j - i <= 6:
                want[word[i:j]] += n
    want = sorted(((n * len(t), t) for t, n in want.items() if n >= 2), key=lambda x: (-x[0], x[1]))
    got = unigram.seed_pieces(counts_frame(spark, words), 10_000, 6).collect()
    assert sorted((r["n"] * len(r["token"]), r["token"]) for r in got) == sorted(want)


def test_unigram_training(spark):
    counts = counts_frame(spark, Counter((TEXT + " ﬁne ﬁne").split()))
    vocab = unigram.unigram_train(counts, 60, seeds=500, coverage=1.0)
    rows = vocab.orderBy("id").collect()
    assert [r["token"] for r in rows[:4]] == ["<pad>", "<unk>", "<s>", "</s>"]
    assert len(rows) == 60 and len({r["token"] for r in rows}) == 60
    df = spark.createDataFrame([(1, "renew  banana ﬁne")], "id int, t string")
    enc = df.select(unigram.unigram_encode(F.col("t"), vocab).alias("ids"))
    assert enc.select(unigram.unigram_decode(F.col("ids"), vocab)).first()[0] == "renew banana fine"
