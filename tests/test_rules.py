"""Rules that the twins cannot show: storage, schemas, edge rows, exactness of the numeric parts."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import tweets
from textloom.operators import datasets as ds
from textloom.operators import dedup as dd
from textloom.operators import features as ft
from textloom.operators import joblog as jl
from textloom.operators import models as ml
from textloom.operators import retrieval as rt
from textloom.operators import vectors as vec
from textloom.operators import vocab as vc
from textloom.operators import web
from textloom.plans.chain import TOKENIZERS, Chain, choose
from textloom.plans.preprocess import PreprocessConfig, run_preprocess
from textloom.session import pin, scratch, shared_folder
from textloom.sources import readers as rd
from textloom.sources import writers as wr

SAMPLE = PreprocessConfig(extract_entities=False, min_doc_length=0, id_col="ID", order=("timestamp", "ID"))


def sample_rows():
    """55 rows with 46 different names: three whole rows repeat, six names come back under new ids."""
    rows = [(i, f"Person {chr(65 + i % 26)}{chr(97 + i // 26)}ne", 20 + i % 25, "Town " if i % 7 else f"Town {i}  ") for i in range(1, 47)]
    return rows[:5] + rows[:3] + rows[5:] + [(46 + k, *rows[k][1:]) for k in (3, 1, 4, 2, 5, 6)]


@pytest.mark.parametrize("suffix", ["csv", "json"])
def test_sample_keeps_46_of_55_rows_and_all_columns(spark, tmp_path, suffix):
    names, rows = ["ID", "content", "timestamp", "City"], sample_rows()
    source = tmp_path / f"raw.{suffix}"
    if suffix == "csv":
        source.write_text("\n".join([",".join(names)] + [",".join(map(str, r)) for r in rows]))
    else:
        source.write_text(json.dumps([dict(zip(names, r)) for r in rows]))
    stats = run_preprocess(spark, str(source), str(tmp_path / "out"), SAMPLE)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (len(rows), stats["input_rows"], stats["output_rows"], len(out)) == (55, 55, 46, 46)
    assert sorted(r["ID"] for r in out) == list(range(1, 47))
    assert set(out[0].__fields__) == {*names, "content_clean"}
    assert {(r["ID"], r["timestamp"], r["City"]) for r in out} == {(i, t, c) for i, _, t, c in rows if i < 47}


def test_publish_replaces_the_old_result(spark, tmp_path):
    for n in (3, 2):
        spark.range(n).write.parquet(str(tmp_path / f"new{n}"))
        wr.publish(spark, str(tmp_path / f"new{n}"), str(tmp_path / "goal"))
        assert spark.read.parquet(str(tmp_path / "goal")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["goal"]


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, name, default=None):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_scratch_leaves_nothing(spark):
    import os

    root = f"{shared_folder(spark).removeprefix('file:')}/textloom/{spark.sparkContext.applicationId}"
    pin(spark.range(1))
    before = sorted(os.listdir(root))
    docs = spark.createDataFrame([(i, f"some words of document number {i % 3}") for i in range(9)], "id long, text string")
    with scratch(spark):
        kept = {r["id"] for r in dd.near_dup_dedup(docs, "id", "text").collect()}
    assert kept and sorted(os.listdir(root)) == before


def test_task_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,other,text\npos,1,"I like, it"\n')
    assert rd.read_task_csv(spark, str(tmp_path / "a.csv"), "classification").first().asDict() == {"text": "I like, it", "label": "pos"}
    (tmp_path / "q.csv").write_text("answer,question,context\na,q,c\n")
    assert tuple(rd.read_task_csv(spark, str(tmp_path / "q.csv"), "qa").first()) == ("c", "q", "a", 0)
    with pytest.raises(ValueError, match="label"):
        rd.read_task_csv(spark, str(tmp_path / "q.csv"), "classification")


def test_csv_gives_back_any_text(spark, tmp_path):
    texts = ['a\nb "q" \\x', "\\n \\s \\\\", " \r\n ", "", None, 'x","y', "\\", '"', " lead", "trail \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    wr.write_corpus(df, str(tmp_path / "c"), "csv")
    back = rd.read_csv(spark, str(tmp_path / "c"), df.schema, escaped=True)
    assert [r["text"] for r in back.orderBy("id").collect()] == texts


def test_every_link_form(spark):
    html = """<a href='/x'>1</a><A class=b HREF=/y>2</a><a href="/z?a=1&amp;b=2">3</a><a name="n">4</a><!-- <a href="/no"> --><a href="">5</a>"""
    rows = web.extract_links(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r["pos"], r["href"]) for r in rows] == [(0, "/x"), (1, "/y"), (2, "/z?a=1&b=2"), (3, "")]


def test_rows_without_class_or_status_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "id long, label string")
    assert {(r["id"], r["split"]) for r in ds.per_class_split(rows, "label", "id", 1).collect()} == {(1, "train"), (2, "train"), (3, "test"), (4, "test")}
    assert ds.map_labels(rows, "label").count() == 4
    counts = {(r["status"], r["n"]) for r in jl.status_counts(rows.withColumnRenamed("label", "status")).collect()}
    assert counts == {("a", 2), (None, 2), ("total", 4)}


def test_best_epoch_takes_the_first_metric_that_a_run_has(spark):
    rows = [("a", 0, 0.5, 9.0), ("a", 1, 0.7, 9.5), ("a", 2, 0.7, 1.0), ("b", 0, None, 9.0), ("b", 1, None, 8.0), ("b", 2, None, 8.5)]
    history = spark.createDataFrame(rows, "run string, epoch int, accuracy double, perplexity double")
    assert {tuple(r) for r in jl.best_epoch(history).collect()} == {("a", 1, 0.7), ("b", 1, 8.0)}


def test_near_duplicates_keep_the_earliest_by_order(spark):
    text = "a text that is long enough to have many shingles of five characters in it"
    rows = [(1, 9, text), (2, 3, text + "."), (3, 5, text), (4, 1, "something else altogether")]
    docs = spark.createDataFrame(rows, "id long, timestamp int, text string")
    assert {r["id"] for r in dd.near_dup_dedup(docs, "id", "text", order=("timestamp", "id")).collect()} == {2, 4}
    assert {r["id"] for r in dd.near_dup_dedup(docs, "id", "text").collect()} == {1, 4}


def test_long_chains_settle_and_hopeless_layouts_are_refused(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["cluster"] for r in dd.connected_components(edges).collect()} == {0}
    with pytest.raises(ValueError):
        dd.band_layout(0.05)


def test_nmf_reaches_the_error_of_plain_updates(spark):
    random = np.random.default_rng(0)
    a = random.poisson(random.gamma(1, 1, (60, 3)) @ random.gamma(1, 1, (3, 20)))
    cells = [(i, f"t{j:02}", int(a[i, j])) for i in range(60) for j in range(20) if a[i, j]]
    terms, h = ml.nmf_factors(spark.createDataFrame(cells, "id long, term string, tf long"), "id", 3, iterations=60, tolerance=0)

    def error(h, rounds):
        w = np.ones((60, 3))
        for _ in range(rounds):
            w *= (a @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
        return np.linalg.norm(a - w @ h), w

    best = math.inf
    for seed in range(3):
        g = np.random.default_rng(seed).random((3, 20)) + 0.1
        w = np.ones((60, 3))
        for _ in range(2000):
            w *= (a @ g.T) / np.maximum(w @ g @ g.T, 1e-12)
            g *= (w.T @ a) / np.maximum(w.T @ w @ g, 1e-12)
        best = min(best, np.linalg.norm(a - w @ g))
    assert len(terms) == 20 and (h >= 0).all()
    assert error(h, 2000)[0] <= 1.03 * best


def test_vector_blocks_are_bounded_and_exact(spark, monkeypatch):
    assert vec.BLOCK_CELLS * 8 * 6 <= 256 << 20 and vec.VECTOR_ROWS * 1024 * 8 <= 256 << 20
    random = np.random.default_rng(1)
    q, v, ids = random.integers(-2, 3, (30, 4)).astype(float), random.integers(-2, 3, (900, 4)).astype(float), random.permutation(900)
    monkeypatch.setattr(vec, "VECTOR_ROWS", 256)
    monkeypatch.setattr(vec, "BLOCK_CELLS", 1000)
    for metric in ("cosine", "l2"):
        best = vec.Best(30, 5)
        for at in range(0, 900, 400):
            best.add(q, ids[at : at + 400], v[at : at + 400], metric)
        scores = vec._block_scores(q, v, metric)
        for i in range(30):
            assert sorted(zip(-best.scores[i], best.ids[i])) == sorted((-scores[i, j], ids[j]) for j in range(900))[:5]


def test_sparse_grid_equals_shipped_queries(spark, monkeypatch):
    random = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in random.integers(0, 40, 12))) for i in range(80)], "id long, text string")
    asked = docs.filter("id % 8 = 0").select(F.col("id").alias("query_id"), "text")
    weights = rt.sparse_weights(docs, "id", "text", asked, "query_id", "text")
    shipped = {tuple(r) for r in rt.sparse_retrieve(*weights, "id", "query_id").collect()}
    monkeypatch.setattr(rt, "MAX_SHIPPED_CELLS", 20)
    monkeypatch.setattr(rt, "DOCUMENT_BLOCK", 30)
    assert shipped == {tuple(r) for r in rt.sparse_retrieve(*weights, "id", "query_id").collect()}
    assert {r[0] for r in shipped if r[0] == r[1] and r[3] == 1} == set(range(0, 80, 8))


def test_documents_that_are_the_queries_are_weighed_once(spark, monkeypatch):
    counted, real = [], rt.term_counts
    monkeypatch.setattr(rt, "term_counts", lambda *given, **more: counted.append(given) or real(*given, **more))
    rows = [(1, "red fox red"), (2, "red hen"), (3, ""), (4, None), (None, "fox den"), (2, "hen hut")]
    docs = spark.createDataFrame(rows, "id long, text string")
    held, asked = rt.sparse_weights(docs, "id", "text", docs, "id", "text")
    assert len(counted) == 2
    table = lambda df: {(r["id"], r["term"]): round(r["weight"], 12) for r in df.collect()}
    own = table(rt.own_weights(docs, "id", "text"))
    assert len(counted) == 3 and own == table(asked)
    assert {k: w for k, w in own.items() if k[0] is not None} == table(held)


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "x", "a", "c"],), (["c", "a"],), (["a"],)], "t array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word string, id long")
    few = {tuple(r) for r in ft.skipgram_pairs(df, F.col("t"), vocab, 2).collect()}
    monkeypatch.setattr(ft, "MAX_SHIPPED_ROWS", 1)
    assert few == {tuple(r) for r in ft.skipgram_pairs(df, F.col("t"), vocab, 2).collect()}
    assert (0, 1, 2) in few and (2, 0, 2) in few


def test_models_learn_separable_classes(spark):
    """Blobs that any of the classifiers must tell apart; topics that any factorisation must find."""
    random = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in random.normal(0, 0.3, 3) + 4 * np.eye(3)[i % 3] + 1.5], "test" if i % 5 == 0 else "train") for i in range(150)]
    df = ml.hstack(spark.createDataFrame(rows, "id long, label int, v array<double>, split string").withColumn("label", F.col("label").cast("double")), [], ["v"])
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    for name in ("logistic_regression", "linear_svm", "random_forest"):
        assert ml.fit_predict(name, train, test).filter("prediction != label").count() == 0, name
    scores = ml.compare_models(["logistic_regression", "random_forest"], df, "split").collect()
    assert {r["model"]: r["accuracy"] for r in scores} == {"logistic_regression": 1.0, "random_forest": 1.0}


def test_word_vectors_bring_companions_together(spark):
    random = np.random.default_rng(4)
    groups = [[f"{g}{i}" for i in range(4)] for g in "ab"]
    docs = [([groups[k % 2][x] for x in random.integers(0, 4, 12)],) for k in range(200)]
    df = spark.createDataFrame(docs, "t array<string>")
    rows = {r["word"]: np.array(r["vector"]) for r in ml.word2vec(df, F.col("t"), size=8, epochs=5).collect()}
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert set(rows) == {w for g in groups for w in g}
    assert cos(rows["a0"], rows["a1"]) > cos(rows["a0"], rows["b1"])


def test_word_vectors_train_on_every_core(spark, monkeypatch):
    settings, real = [], ml.Word2Vec
    monkeypatch.setattr(ml, "Word2Vec", lambda **given: settings.append(given) or real(**given))
    df = spark.createDataFrame([("a b c a b c".split(),)] * 40, "t array<string>")
    assert ml.word2vec(df, F.col("t"), size=4, epochs=1).count() == 3
    assert settings[0]["numPartitions"] == spark.sparkContext.defaultParallelism


def test_topics_separate_two_vocabularies(spark):
    random = np.random.default_rng(5)
    words = ["apple pear plum fig date".split(), "iron zinc lead gold tin".split()]
    docs = spark.createDataFrame([(i, " ".join(words[i % 2][x] for x in random.integers(0, 5, 30))) for i in range(60)], "id long, text string")
    topics = ml.lda_fit(ml.count_vectors(docs, "id", "text", min_df=1.0, max_df=0.9), 2, 30)
    assert all(0.5 <= r["topic_weight"] <= 1 + 1e-9 and r["topic"] in (0, 1) for r in ml.doc_topics(topics).collect())
    top = ml.topic_top_words(topics, 4).orderBy("topic", "rank").collect()
    assert [(r["topic"], r["rank"]) for r in top] == [(t, k) for t in (0, 1) for k in range(1, 5)]
    assert all(x["weight"] >= y["weight"] > 0 for x, y in zip(top, top[1:]) if x["topic"] == y["topic"])
    counts = ft.count_matrix(docs, "id", "text", min_df=1, max_df=1.0)
    tops = {}
    for r in ml.nmf_topics(counts, "id", 2, k=5).collect():
        tops.setdefault(r["topic"], set()).add(r["term"])
    assert sorted(map(sorted, tops.values())) == sorted(map(sorted, words))


def test_vocabulary_comes_back_with_its_settings(spark, tmp_path):
    words = spark.createDataFrame([("a", 0), ("b", 1)], "word string, id long")
    vc.save_vocab(words, str(tmp_path / "v"), {"min_freq": 5, "type": "word"})
    assert {tuple(r) for r in vc.load_vocab(spark, str(tmp_path / "v")).collect()} == {("a", 0), ("b", 1)}
    assert vc.load_vocab_config(spark, str(tmp_path / "v")) == {"min_freq": 5, "type": "word"}


def test_chain_counts_every_step_in_one_action(spark):
    chain = Chain().add("even", lambda df: df.filter("id % 2 = 0")).add("few", lambda df: df.filter("id < 10"))
    out = []
    assert chain.run(spark.range(100), lambda df: out.extend(df.collect())) == {"even": 50, "few": 5}
    assert len(out) == 5
    with pytest.raises(ValueError, match="left no rows"):
        Chain().add("none", lambda df: df.filter("id < 0")).run(spark.range(3), lambda df: df.collect())
    with pytest.raises(ValueError, match="already"):
        chain.add("few", lambda df: df)


def test_families_are_chosen_by_name():
    assert choose(TOKENIZERS, "bpe")[0].__name__ == "bpe_train"
    with pytest.raises(ValueError, match="known: classification"):
        choose({"classification": 1}, "other")


def test_token_classes_of_short_posts(spark):
    texts = {
        "I </3 you <3 :-) :D": ["i", "</3", "you", "<3", ":-)", ":D"],
        "mail bob.x@b.com or +1 (555) 123-4567": ["mail", "bob.x@b.com", "or", "+1 (555) 123-4567"],
        "a --> b <b> x &amp; y": ["a", "-->", "b", "<b>", "x", "&", "y"],
        "#self-care don't 3.5 wow!!!!!!": ["#self-care", "don't", "3.5", "wow", "!", "!", "!"],
        "so... http://a.b/c?d=1 @someone _x_": ["so", "...", "http://a.b/c?d=1", "_x_"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["tokens"] for r in df.select("text", tweets.tweet_tokens(F.col("text")).alias("tokens")).collect()}
    assert got == texts
