"""Work that must not grow faster than the input: counted shuffles and compilations, and values beyond the small tables."""

import hashlib
import itertools
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.operators import features as ft
from textloom.operators import models as ml
from textloom.operators import naive_bayes as nb
from textloom.operators import overlap as ov
from textloom.operators import unigram
from textloom.operators import vectors as vt
from textloom.operators import vocab as vc
from textloom.plans import catalog_corpus as corpus


def exchanges(df, text="Exchange hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(text)


def test_format_size_beyond_64_bits(spark, tmp_path):
    keys = [(1, 2, 3), (6_000_000, 9_000_000, 1), (2_000_000_000, 3_000_000_000, 2)]
    table = spark.createDataFrame(keys, "l_partkey bigint, l_orderkey bigint, l_linenumber int")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    shown = {r["l_orderkey"]: r["shown"] for r in entry.queries()["format_size"](spark, str(tmp_path)).collect()}
    assert shown == {
        2: "4.00 B", 9_000_000: f"{6_000_000 * 9_000_000**2 / 1024**4:.2f} TB",
        3_000_000_000: f"{2 * 10**9 * 9 * 10**18 / 1024**4:.2f} TB",
    }


@pytest.mark.parametrize("shipped", [200_000, 0])
def test_skipgram_pairs_shuffle_once(spark, monkeypatch, shipped):
    """Counts equal brute force when stretches and held pairs are small; one shuffle carries the pairs."""
    monkeypatch.setattr(ft, "PLACES", 7, raising=False)
    monkeypatch.setattr(ft, "HELD_PAIRS", 5, raising=False)
    monkeypatch.setattr(ft, "SHIPPED_WORDS", shipped, raising=False)
    texts = [[f"w{(i * j + j * j) % 11}" for j in range(i % 23)] for i in range(60)] + [["w1", None, "w1", "rare", "w2"]]
    words = {f"w{i}": 10 - i for i in range(10)}
    want = Counter()
    for t in texts:
        for i, a in enumerate(t):
            for j in range(max(i - 3, 0), min(i + 4, len(t))):
                if i != j and a in words and t[j] in words:
                    want[words[a], words[t[j]]] += 1
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>").repartition(3)
    vocab = spark.createDataFrame(list(words.items()), "word string, id bigint")
    pairs = ft.skipgram_pairs(df, F.col("t"), vocab, 3)
    if shipped:
        assert exchanges(pairs) == 1
    assert {(r["target"], r["context"]): r["n"] for r in pairs.collect()} == dict(want)


@pytest.mark.parametrize("hashed", [8_000_000, 0])
def test_word_pairs_of_large_vocabularies_move_packed_blocks(spark, monkeypatch, hashed):
    """Beyond SHIPPED_WORDS words no place of a word is written or joined, and what is shuffled is blocks of pairs, not rows."""
    monkeypatch.setattr(ft, "SHIPPED_WORDS", 0)
    monkeypatch.setattr(ft, "HASHED_WORDS", hashed)
    monkeypatch.setattr(ft, "CELL_PAIRS", 40)
    texts = [[f"w{(i * j + j) % 9}" for j in range(i % 19)] for i in range(50)] + [[None, "w1", None, "w1", "rare"], None, []]
    want = Counter()
    for t in texts:
        for i, j in itertools.combinations(range(len(t or [])), 2):
            if j - i <= 2 and {t[i], t[j]} <= {f"w{x}" for x in range(9)}:
                want[tuple(sorted((int(t[i][1:]) * 7, int(t[j][1:]) * 7)))] += 1
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>").repartition(3)
    vocab = spark.createDataFrame([(f"w{x}", 10, 7 * x) for x in range(9)], "word string, n bigint, id bigint")
    pairs = ft.word_pairs(df, F.col("t"), vocab, 2)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" in plan and "HashAggregate(keys=[a" not in plan
    if hashed:
        assert "Join" not in plan and "word-places" not in plan
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(want)


def test_packed_pairs_come_back_whole():
    random = np.random.default_rng(1)
    ids = np.sort(random.integers(0, 1 << 31, (2, 500)) >> random.integers(0, 31, 500), axis=0)
    keys = np.unique(np.concatenate([ids[0] << 32 | ids[1], [0, 1, 1 << 32 | 1, (1 << 31) - 1 << 32 | (1 << 31) - 1]]))
    counts = random.integers(1, 1 << 32, len(keys))
    for side in (1, 2, 7, 300):
        got = [ft._unpacked_pairs(r["cell"], r["size"], pa.py_buffer(r["block"]), side) for r in ft._packed_pairs(keys, counts, side).to_pylist()]
        key, n = ft._added(*map(list, zip(*got)))
        assert (key == keys).all() and (n == counts).all()


def test_first_places_are_found_without_sorting_all_words(spark, monkeypatch):
    """Words are numbered by their first place: a missing key before all others, then the smallest, also negative ones."""
    most = (1 << 63) - 1
    rows = [(5, ["b", "a"]), (-2, ["c", "b", "d"]), (-most - 1, ["e", "c"]), (None, ["d", "f"]), (most, ["a", "f", "g"]), (5, ["g", "e"])]
    df = spark.createDataFrame(rows, "id bigint, t array<string>").repartition(3)
    seen, real = [], vc.row_index
    monkeypatch.setattr(vc, "row_index", lambda stats, *order: seen.append(stats) or real(stats, *order))
    found = vc.min_freq_vocab(df, "id", F.col("t"), 2)
    assert [r["word"] for r in found.orderBy("id").collect()] == ["d", "f", "e", "c", "b", "g", "a"]
    assert {r["n"] for r in found.collect()} == {2} and "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shipped", [2_000_000, 0])
def test_freq_features_shuffle_sums_only(spark, monkeypatch, shipped):
    monkeypatch.setattr(ft, "SHIPPED_WORDS", shipped, raising=False)
    monkeypatch.setattr(ft, "ROWS_COUNTED", 4, raising=False)
    rows = [(i % 17, i % 2, [f"w{(i * j) % 13}" for j in range(i % 9)]) for i in range(40)] + [(None, 1, ["w1"]), (99, 0, None), (98, 0, ["w1", "w1"])]
    df = spark.createDataFrame(rows, "id bigint, label int, t array<string>").repartition(2)
    uses = Counter((w, label) for _, label, t in rows for w in t or [])
    sums = {}
    for key, _, t in rows:
        x = sums.setdefault(key, [0, 0])
        for w in t or []:
            x[0] += uses[w, 1]
            x[1] += uses[w, 0]
    sums[None] = [0, 0]
    counts = nb.class_word_freqs(df, F.col("t"), "label")
    found = nb.freq_features(df, "id", F.col("t"), counts)
    if shipped:
        # The keys on both sides of the last join, and nothing by word.
        assert "explode" not in found._jdf.queryExecution().executedPlan().toString()
        assert exchanges(found, "word") == 0
    got = sorted((str(r["id"]), r["x0"], r["x1"], r["x2"]) for r in found.collect())
    assert got == sorted((str(k), 1.0, float(sums[k][0]), float(sums[k][1])) for k, _, _ in rows)


def test_gradient_steps_compile_nothing(spark, monkeypatch):
    random = np.random.default_rng(1)
    x = random.integers(0, 50, (500, 2)).astype(float)
    y = (x[:, 0] + random.normal(0, 5, 500) > x[:, 1]).astype(int)
    df = spark.createDataFrame([(1.0, float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "x0 double, x1 double, x2 double, y int")
    matrix = nb.gd_logistic(df, ["x0", "x1", "x2"], "y", 1e-4, 12)
    monkeypatch.setattr(nb, "MAX_SHIPPED_ROWS", 10)
    compiled = lambda: spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()
    nb.gd_logistic(df, ["x0", "x1", "x2"], "y", 1e-4, 2)
    before = compiled()
    cost, theta = nb.gd_logistic(df, ["x0", "x1", "x2"], "y", 1e-4, 12)
    assert compiled() - before <= 3
    assert cost == pytest.approx(matrix[0], rel=1e-12) and theta == pytest.approx(matrix[1], rel=1e-9)


def test_tasks_count_bounded_text(spark, monkeypatch):
    """Ten times the text makes ten times the tasks, not larger ones; the counts stay the same."""
    monkeypatch.setattr(ft, "COUNTED_CHARS", 400, raising=False)
    monkeypatch.setattr(ov, "COUNTED_CHARS", 400, raising=False)
    texts = [(i % 90, " ".join(f"w{(i * j) % 19}" for j in range(40)), " ".join(f"w{(i + j) % 7}" for j in range(30))) for i in range(100)]
    df = spark.createDataFrame([*texts, (None, None, None)], "id bigint, a string, b string")
    chars = sum(len(a) for _, a, _ in texts)
    counts = ft.tfidf(df, "id", "a", min_df=1, max_df=1.0)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and f", {-(-chars // 400)}), REPARTITION_BY_NUM" in plan
    want = Counter()
    for key, a, _ in texts:
        words = a.split()
        want.update((key, g) for g in [*words, *(f"{x} {y}" for x, y in zip(words, words[1:]))])
    assert {(r["id"], r["term"]): r["tf"] for r in counts.collect()} == dict(want)
    tokens = [ov.punctuated_tokens(F.col(c)) for c in ("a", "b")]
    rows = df.filter("id IS NOT NULL")
    sized = ov.corpus_bleu(rows, ["id"], *tokens, F.length("a") + F.length("b"))
    assert sized.first() == ov.corpus_bleu(rows, ["id"], *tokens).first()


def test_count_vectors_keep_no_tokens_in_memory(spark, monkeypatch):
    """The fit stores its rows where a limit is a share; the words inside the limits are the same either way."""
    stored = []

    class Recorded(ml.CountVectorizer):
        def fit(self, rows):
            stored.append(self.getMinDF() < 1 or self.getMaxDF() < 1)
            return super().fit(rows)

    monkeypatch.setattr(ml, "CountVectorizer", Recorded)
    texts = [" ".join(f"w{j:02}" for j in range(12) if i % (j + 1) == 0) for i in range(40)]
    uses = Counter(w for t in texts for w in t.split())
    df = spark.createDataFrame(list(enumerate(texts)) + [(40, "")], "id int, text string").repartition(3)
    for least, most in ((5, 0.7), (0.1, 0.5), (0.001, 30), (2, 40)):
        low, high = (x * 41 if x < 1 else x for x in (least, most))
        found = ml.count_vectors(df, "id", "text", min_df=least, max_df=most).vocabulary
        assert set(found) == {w for w, n in uses.items() if low <= n <= high}
    assert stored == [False] * 4


def test_stretches_are_bounded_and_whole(monkeypatch):
    from textloom.functions import batches

    monkeypatch.setattr(batches, "HELD_BYTES", 10)
    texts = pa.array(["aaaa", "bbbbb", None, "c", "d" * 30, "", None, "ä" * 5, "e"])
    found = list(batches.stretches(texts))
    assert sum(n for _, n in found) == len(texts)
    assert [start for start, _ in found] == [0, *itertools.accumulate(n for _, n in found)][:-1]
    assert all(n == 1 or sum(len((t or "").encode()) for t in texts.slice(s, n).to_pylist()) <= 10 for s, n in found)
    assert list(batches.stretches(texts.slice(4, 2))) == [(0, 1), (1, 1)]
    assert list(batches.stretches(pa.array([], pa.string()))) == []


def test_ranges_hold_a_bounded_piece(monkeypatch):
    from textloom.functions import batches
    from textloom.sources import records

    monkeypatch.setattr(batches, "HELD_BYTES", 100)
    rows = [("a", 0, f"line {i}") for i in range(200)] + [("a", 5000, "x" * 300), ("b", 0, "y")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("file", "start", "value"), r)) for r in rows])
    pieces = list(records.ranges(iter([batch])))
    assert [(*key, v) for key, values in pieces for v in values] == rows
    assert max(len(values) for _, values in pieces) <= 100 // len("line 0")


def test_text_udfs_answer_in_bounded_batches(spark, monkeypatch):
    """Encoded and parsed texts equal those of whole batches, also where texts are missing or empty."""
    from textloom.functions import html as hp
    from textloom.operators import encoding, web

    texts = [None, "ab  c", "", "  ", None, "x " * 3_000_000, "ab", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1).sortWithinPartitions("id")
    ids = encoding.encode_column(F.col("text"), lambda w: [len(w), 7], before=[1], after=[2])
    cut = encoding.encode_column(F.col("text"), lambda w: [len(w), 7], before=[1], after=[2], max_length=2)
    rows = df.select("id", ids.alias("ids"), cut.alias("cut"), web.html_to_text(F.col("text")).alias("html")).collect()
    for r, text in zip(sorted(rows), texts):
        want = None if text is None else [1, *(x for w in text.split() for x in (len(w), 7)), 2]
        assert r["ids"] == want and r["cut"] == (None if want is None else want[:2])
        assert r["html"] == (None if text is None else hp.visible_text(text))


def test_vector_grid_takes_arrow_blocks(spark, monkeypatch):
    """A block reaches Python as Arrow, not as an object a row; the result is that of shipped queries; vectors of two lengths are refused."""
    rows = [(i, [float((i * j) % 7) for j in range(1, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vector array<float>").repartition(3)
    queries = df.select(F.col("id").alias("query_id"), "vector")
    want = sorted(map(tuple, vt.nearest(queries, df, 4).collect()))
    monkeypatch.setattr(vt, "MAX_SHIPPED_NUMBERS", 10)
    found = vt.nearest(queries, df, 4)
    assert exchanges(found, "FlatMapCoGroupsInArrow") == 1
    assert vt.QUERY_BLOCK + vt.VECTOR_BLOCK <= 40_000
    assert sorted(map(tuple, found.collect())) == want and len(want) == 240
    for odd in (pa.array([[1.0], [1.0, 2.0], None]), pa.array([[1.0], None]), pa.array([None], pa.list_(pa.float32()))):
        with pytest.raises(ValueError, match="one length"):
            vt._arrow_matrix(pa.chunked_array([odd]))


def test_unigram_seeds_are_cut_on_the_cluster(spark):
    words = [("banana", 3), ("bandana", 2), ("anna", 1), ("nab", 1)]
    counts = Counter()
    for word, n in words:
        for i in range(len(word)):
            for j in range(i + 2, min(len(word), i + 4) + 1):
                counts[word[i:j]] += n
    ranked = sorted(((t, n) for t, n in counts.items() if n >= 2), key=lambda x: (-x[1] * len(x[0]), x[0]))
    df = spark.createDataFrame(words, "word string, n bigint")
    for seeds in (1, 7, len(ranked), 1000):
        found = unigram.seed_pieces(df, seeds, 4)
        assert exchanges(found, "TakeOrderedAndProject") == 0
        assert sorted(map(tuple, found.collect())) == sorted(ranked[:seeds])


def test_nmf_reads_its_counts_once(spark):
    """Counts are costly to make. One round's sums equal plain matrix products."""
    cells = [(i, f"t{(i * j) % 9}", i % 4 + 1) for i in range(50) for j in (1, 2) if j == 1 or i % 9]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counts = spark.createDataFrame(cells, "id long, term string, tf long").repartition(3).mapInArrow(counted, "id long, term string, tf long")
    terms, h = ml.nmf_factors(counts, "id", 2, iterations=2, tolerance=0, inner=1)
    assert read.value == len(cells)
    assert terms == sorted({t for _, t, _ in cells})
    a = np.zeros((50, len(terms)))
    for i, t, n in cells:
        a[i, terms.index(t)] = n
    average = np.mean([n for *_, n in cells])
    want = np.sqrt(average / 2) * np.abs(np.random.default_rng(42).standard_normal((2, len(terms)))) + 1e-9
    for _ in range(2):
        w = np.full((50, 2), np.sqrt(average / 2))
        w *= (a @ want.T) / np.maximum(w @ (want @ want.T), 1e-12)
        want = want * (w.T @ a) / np.maximum((w.T @ w) @ want, 1e-12)
    assert np.allclose(h, want)


@pytest.mark.parametrize("most", [1000, 3])
def test_pages_of_one_row_group_are_written_by_many_tasks(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(corpus, "WRITTEN_PAGES", most, raising=False)
    asked, real = [], corpus.rd.read_html
    monkeypatch.setattr(corpus.rd, "read_html", lambda spark, path: asked.append(path) or real(spark, path))
    html = {i: f"<p>{i}</p>\n" * (i % 3) for i in range(60)}
    spark.createDataFrame(list(html.items()), "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = entry.queries()["read_html"](spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["n_chars"], r["digest"]) for r in found} == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in html.items()}
    files = list(Path(asked[0]).glob("page_id=*/part-*"))
    writers = {f.name.split("-")[1] for f in files}
    assert len(files) == len(found) == 60 and len(writers) >= (6 if most == 1000 else 12)
