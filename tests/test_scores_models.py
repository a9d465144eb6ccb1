import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import features as ft
from textloom.operators import joblog as jl
from textloom.operators import metrics as mt
from textloom.operators import models as ml
from textloom.operators import naive_bayes as nb
from textloom.operators import overlap as ov


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        assert ov.lcs_length(a, b) == lcs(a, b)


def bleu(pairs, weights):
    precisions = []
    for n in range(1, len(weights) + 1):
        match = total = 0
        for p, r in pairs:
            pc = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
            rc = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            match += sum((pc & rc).values())
            total += max(1, sum(pc.values()))
        precisions.append(match / total)
    if min(precisions) == 0:
        return 0.0
    c, ref = sum(len(p) for p, _ in pairs), sum(len(r) for _, r in pairs)
    penalty = 1 if c > ref else math.exp(1 - ref / c)
    return penalty * math.exp(sum(w * math.log(p) for w, p in zip(weights, precisions)))


def test_bleu_equals_formula(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(1, 14))]) for _ in range(30)]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "id int, p array<string>, r array<string>")
    row = ov.corpus_bleu(df, ["id"], F.col("p"), F.col("r")).first()
    for n, weights in ov.BLEU_WEIGHTS.items():
        assert row[f"bleu{n}"] == pytest.approx(bleu(pairs, weights))


def test_rouge_and_meteor_of_known_pairs(spark):
    rows = [("the cat sat on the mat", "the cat sat on the mat"), ("", "something"), ("cats running", "a cat runs")]
    df = spark.createDataFrame(rows, "p string, r string")
    row = ov.rouge_l(df, F.col("p"), F.col("r")).first()
    assert row["rougel_r"] == pytest.approx((1 + 0 + 0) / 3)
    perfect = ov.meteor_score("the cat sat on the mat".split(), "the cat sat on the mat".split())
    assert perfect == pytest.approx(1 - 0.5 * (1 / 6) ** 3)
    assert ov.meteor_score([], ["x"]) == 0.0
    assert ov.align(["cats", "running"], ["a", "cat", "runs"]) == [(0, 1), (1, 2)]
    assert ov.rouge_f(["a", "b", "c"], ["a", "c", "d"]) == pytest.approx((2 / 3, 0.0, 2 / 3))
    assert ov.rouge_fmeasure(df, "p", "r").first()["rouge1"] == pytest.approx((1 + 0 + 0.4) / 3, abs=0.3)


def test_rouge_l_of_several_sentences(spark):
    # By hand: "police killed the gunman" and "the gunman fled" against "the gunman was killed by police. he fled".
    # Pairs: {the, gunman} and {} of the first; {the, gunman} and {fled} of the second: 3 of 5 and 3 of 8 different words.
    assert ov.summary_overlap("police killed the gunman. the gunman fled.", "the gunman was killed by police. he fled") == (3, 5, 8)
    assert ov.summary_overlap("a b. a b", "b a") == (1, 2, 2)
    assert ov.summary_overlap("", "x") == (0, 0, 1) and ov.summary_overlap("...", "") == (0, 0, 0)
    df = spark.createDataFrame([("police killed the gunman. the gunman fled.", "the gunman was killed by police. he fled"), (None, "x")], "p string, r string")
    row = ov.rouge_l(df, F.col("p"), F.col("r")).first()
    p, r = 3 / 5, 3 / 8
    assert tuple(row) == pytest.approx((p / 2, r / 2, 2 * p * r / (p + r + 1e-8) / 2))


def test_common_words_equal_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(9))] for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        i, j, want = len(a), len(b), set()
        while i and j:
            if a[i - 1] == b[j - 1]:
                want.add(a[i - 1])
                i, j = i - 1, j - 1
            elif t[i - 1][j] > t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert ov.common_words(a, b) == want and ov.lcs_length(a, b) == t[-1][-1]


def test_classification_edges(spark):
    one_class = spark.createDataFrame([(1, 1)] * 3, "p int, y int")
    row = mt.classification_metrics(one_class, "p", "y").first()
    assert tuple(row) == (1.0, 1.0, 1.0, 1.0)
    empty = one_class.filter("p = 9")
    assert mt.classification_metrics(empty, "p", "y").first()["accuracy"] == 0.0
    assert mt.simple_accuracy(empty, "p", "y").first()["accuracy"] == 0.0
    never = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    assert tuple(mt.binary_scores(never, "p", "y").first()) == (0.0, 0.0, 0.0)
    assert mt.confusion_matrix(never, "p", "y").count() == 4
    logits = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 1)], "p array<double>, y int")
    assert mt.classification_metrics(logits, "p", "y").first()["accuracy"] == 0.5


def test_regression_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "p double, y double")
    assert tuple(mt.regression_metrics(df, "p", "y").first()) == (1.0, 1.0, 1.0, 0.0)


def test_job_log_edges(spark):
    jobs = spark.createDataFrame([("failed", 1)], "status string, user_id int").withColumns(
        {c: F.current_timestamp() for c in ("started_at", "completed_at")}
    )
    assert jl.avg_duration(jobs).first()[0] == 0.0
    history = spark.createDataFrame([("a", e, s) for e, s in enumerate([0.5, 0.9, 0.9, 0.6])], "run string, epoch int, score double")
    assert tuple(jl.best_epoch(history, "score").first()) == ("a", 1, 0.9)
    assert tuple(jl.best_epoch(history, "score", False).first()) == ("a", 0, 0.5)
    assert jl.early_stop(history).first()["stop"] is True
    assert jl.early_stop(history, patience=4).first()["stop"] is False


def test_gradient_descent_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(50), rng.normal(size=(50, 2))]
    y = (x[:, 1] > 0).astype(float)
    theta = np.zeros(3)
    for _ in range(6):
        h = 1 / (1 + np.exp(-x @ theta))
        cost = -(y @ np.log(h) + (1 - y) @ np.log(1 - h)) / 50
        theta = theta - 0.1 * x.T @ (h - y) / 50
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "x0 double, x1 double, x2 double, y int")
    got_cost, got = nb.gd_logistic(df, ["x0", "x1", "x2"], "y", 0.1, 6)
    assert got_cost == pytest.approx(cost) and got == pytest.approx(theta.tolist())


def test_pca_of_a_seeded_matrix(spark):
    np.random.seed(1)
    x = np.random.rand(3, 10)
    df = ml.hstack(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>"), [], ["v"])
    rows = ml.pca(df, 2).orderBy("id").collect()
    got = np.abs([[r["pc1"], r["pc2"]] for r in rows])
    want = [[0.43437323, 0.49820384], [0.42077249, 0.50351448], [0.85514571, 0.00531064]]
    assert got == pytest.approx(np.array(want), abs=1e-6)
    variance = [r["variance"] for r in ml.explained_variance(df, 2).orderBy("component").collect()]
    assert variance == pytest.approx(np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1][:2].tolist())


def test_doc_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b", "zz"]), (2, ["zz"]), (3, [])], "id int, t array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>")
    got = {r["id"]: r["vector"] for r in ft.doc_vectors(docs, "id", F.col("t"), vectors, 2).collect()}
    assert got[1] == pytest.approx([1 / 3, 2.0]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_kmeans_needs_rows(spark):
    df = ml.hstack(spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id int, v array<double>"), [], ["v"])
    assert ml.kmeans(df).select("cluster").distinct().count() == 1
    df = ml.hstack(spark.createDataFrame([(i, [float(i)]) for i in range(40)], "id int, v array<double>"), [], ["v"])
    assert ml.kmeans(df).select("cluster").distinct().count() == 4


def test_doc_vectors_query_trains_whole_word_vectors(spark, monkeypatch):
    """The word vectors of the query are those of ``word2vec`` at its own settings: 100 dimensions, 10 epochs."""
    from textloom.plans import catalog_learning as learning

    asked = {}
    monkeypatch.setattr(learning.ml, "word2vec", lambda df, tokens, **settings: asked.update(settings) or spark.createDataFrame([], "word string, vector array<double>"))
    assert len(learning.doc_vectors(spark, "/root/testdata/sf0.001").first()["vector"]) == 100 and not asked
