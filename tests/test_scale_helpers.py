"""Ordering, skewed lookups, de-duplication and neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import datasets as ds
from textloom.operators import dedup as dd
from textloom.operators import retrieval as rt
from textloom.operators import vectors as vt
from textloom.operators.ordering import head_split, row_index
from textloom.operators import skew
from textloom.operators.skew import lookup


def test_row_index(spark):
    keys = random.Random(1).sample(range(10_000), 3_000)
    df = row_index(spark.createDataFrame([(k,) for k in keys], "k int").repartition(7), "k")
    assert [(r["k"], r["row_index"]) for r in df.orderBy("k").collect()] == [(k, i + 1) for i, k in enumerate(sorted(keys))]


@pytest.mark.parametrize("n,ratio", [(1, 0.8), (10, 0.8), (7, 0.5), (5, 1.0), (5, 0.0)])
def test_head_split(spark, n, ratio):
    df = head_split(spark.createDataFrame([(i, "x") for i in range(n)], "k int, t string"), ["k"], ratio)
    assert sorted(r["k"] for r in df.filter("split = 'train'").collect()) == list(range(int(n * ratio)))


@pytest.mark.parametrize("hot_rows", [0, 100_000])
def test_lookup_equals_join_with_a_hot_key(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "id int, k string")
    one = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 3000, 6)], "k string, v int")
    for how in ("inner", "left"):
        got = lookup(many, one, "k", how=how).select("id", "k", "v")
        want = many.join(one, "k", how).select("id", "k", "v")
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_per_class_and_stratified_split(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, label string")
    head = ds.per_class_split(df, "label", "id", 20).filter("split = 'train'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in head} == {"big": 20, "small": 20}
    test = ds.stratified_split(df, "label", "id").filter("split = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in test} == {"big": 90, "small": 10}


def test_pad_batch_and_chunk_list(spark):
    df = spark.createDataFrame([(i, list(range(i % 5))) for i in range(10)], "id int, ids array<int>")
    rows = {r["id"]: r for r in ds.pad_batch(df, "id", "ids", 4).collect()}
    for i in range(10):
        batch = [j for j in range(10) if j // 4 == i // 4]
        assert rows[i]["padded"] == list(range(i % 5)) + [0] * (max(j % 5 for j in batch) - i % 5)
    lists = ds.chunk_list(df, "id", 4).orderBy("batch_id").collect()
    assert [r["items"] for r in lists] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def near_copies(seed=3):
    """A third of the rows are near copies of one text, plus exact copies, chains and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    drift = list(base)
    for i in range(12):
        for _ in range(3):
            drift[rng.randrange(len(drift))] = word()
        texts.append(" ".join(drift))
    texts += [texts[5]] * 4 + [texts[45]] * 2
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += ["abc", "abc", "", "abcd"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_pairs(rows, threshold):
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in rows}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                score = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if score >= threshold:
                    out[a, b] = score
    return out


@pytest.mark.parametrize("threshold,hot_rows", [(0.9, 0), (0.7, 100_000)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, threshold, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rows = near_copies()
    df = spark.createDataFrame(rows, "id int, t string")
    pairs = brute_pairs(rows, threshold)
    first = {}
    for (a, b), score in pairs.items():
        if b not in first or a < first[b][0]:
            first[b] = (a, pytest.approx(score))
    links = {r["id"]: (r["partner"], r["jaccard"]) for r in dd.near_dup_links(df, "id", "t", threshold).collect()}
    assert links == first

    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    firsts = {}
    for i, t in rows:
        firsts.setdefault(t, i)
    kept = {i for i in firsts.values() if root(i) == i}
    assert {r["id"] for r in dd.near_dup_dedup(df, "id", "t", threshold).collect()} == kept


@pytest.mark.parametrize("crowd", [2, 8])
def test_near_duplicates_around_common_bodies_equal_brute_force(spark, monkeypatch, crowd):
    """Several groups in the same buckets, some below the threshold of each other, joined through few rows."""
    monkeypatch.setattr(dd, "CROWD", crowd)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    body = [word() for _ in range(80)]
    rows = []
    for group in range(4):
        own = body[: 74 - group] + [word() for _ in range(6 + group)]
        for _ in range(12):
            words = list(own)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = word()
            rows.append(" ".join(words))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "id int, t string")
    for threshold in (0.8, 0.9):
        first = {}
        for (a, b), score in brute_pairs(rows, threshold).items():
            if b not in first or a < first[b][0]:
                first[b] = (a, pytest.approx(score))
        assert first
        links = {r["id"]: (r["partner"], r["jaccard"]) for r in dd.near_dup_links(df, "id", "t", threshold).collect()}
        assert links == first


def test_pages_around_one_body_make_few_pairs(spark, monkeypatch):
    """400 pages of similarity 0.86 at a threshold of 0.9: all pairs would be 79 800."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = "".join(rng.choice(letters) for _ in range(1_000))
    rows = [(i, body + "".join(rng.choice(letters) for _ in range(80))) for i in range(400)]
    counted = []
    verify = dd._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(dd, "_verified", counting)
    df = spark.createDataFrame(rows, "id int, t string")
    assert dd.near_dup_links(df, "id", "t", 0.9).collect() == []
    assert 0 < sum(counted) < 4_000


@pytest.mark.parametrize("block", [5, 4_096])
def test_parity_bits_lose_no_pair_and_leave_few_texts_to_move(spark, monkeypatch, block):
    monkeypatch.setattr(dd, "BLOCK_SETS", block)
    rows = near_copies()
    # The second row of an id is another text.
    rows.append((0, rows[1][1] + " and more"))
    texts = spark.createDataFrame([(i, t) for i, t in rows if len(t) >= 5], "id int, text string")
    ids = sorted({i for i, t in rows if len(t) >= 5})
    every = [(a, b) for a in ids for b in ids if a < b]
    asked = dd.pin(spark.createDataFrame(every, "a int, b int"))
    found = {tuple(r) for r in dd._possible(asked, texts, 0.9, 5).collect()}
    sets: dict = {}
    for i, t in rows:
        sets.setdefault(i, []).append({t[j : j + 5] for j in range(len(t) - 4)})
    score = lambda a, b: max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b])
    assert {p for p in every if score(*p) >= 0.9} <= found
    # What passes is hardly below the threshold.
    assert all(score(*p) > 0.8 for p in found)


def test_no_table_of_all_shingles_and_no_texts_of_hopeless_pairs(spark, monkeypatch):
    """400 pages around one body: only their rarest shingles are written, and no text meets another."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = "".join(rng.choice(letters) for _ in range(1_000))
    rows = [(i, body + "".join(rng.choice(letters) for _ in range(80))) for i in range(400)]
    written, pin = {}, dd.pin

    def counting(df, name="pin", *rest, **options):
        out = pin(df, name, *rest, **options)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(dd, "pin", counting)
    df = spark.createDataFrame(rows, "id int, t string")
    assert dd.near_dup_dedup(df, "id", "t", 0.9).count() == 400
    assert max(written.values()) < 400 * 1_076 / 5
    assert written["possible-pairs"] == 0


def test_sets_below_the_threshold_share_few_buckets():
    """At 0.9, pairs of similarity 0.7 shared two buckets on average with bands of six."""
    rng = np.random.default_rng(8)
    bands, rows = dd.band_layout(0.9, max_hashes=dd.MAX_COORDINATES)
    orders, shared, found = dd._coordinates(bands * rows), 0, 0
    for _ in range(60):
        some = rng.integers(0, 1 << 64, 1_190, dtype=np.uint64)
        keys = [dd._band_keys(part, bands, rows, orders) for part in (some[:1_000], some[190:], some[:950])]
        shared += int((keys[0] == keys[1]).sum())
        found += bool((keys[0] == keys[2]).any())
    assert found == 60 and shared < 60


def test_sketches_hold_no_shingles(spark):
    df = spark.createDataFrame([(1, "a text of some length"), (2, "abc"), (3, None)], "id int, t string")
    sketch = dd.sketches(df, "id", "t", 0.9)
    assert sketch.columns == ["id", "n", "bands"] and [r["id"] for r in sketch.collect()] == [1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a int, b int")
    got = {r["id"]: r["cluster"] for r in dd.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_band_layout_misses_little():
    for t in (0.5, 0.7, 0.8, 0.9, 0.95, 1.0):
        bands, rows = dd.band_layout(t)
        assert bands * rows <= 128
        assert (1 - t**rows) ** bands <= 1e-6


def vector_frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, 6)).round(1)
    values[-1] = 0
    return values, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id int, vector array<double>").repartition(5)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("k", [3, 500])
def test_nearest_equals_brute_force(spark, monkeypatch, metric, grid, k):
    if grid:
        monkeypatch.setattr(vt, "MAX_SHIPPED_NUMBERS", 10)
        monkeypatch.setattr(vt, "QUERY_BLOCK", 7)
        monkeypatch.setattr(vt, "VECTOR_BLOCK", 40)
    values, vectors = vector_frame(spark, 120, 1)
    asked, queries = vector_frame(spark, 20, 2)
    got = {}
    for r in vt.nearest(queries.withColumnRenamed("id", "query_id"), vectors, k, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i, q in enumerate(asked):
        if metric == "cosine":
            norms = np.linalg.norm(values, axis=1) * np.linalg.norm(q)
            score = np.where(norms > 0, values @ q / np.where(norms > 0, norms, 1), 0)
        else:
            score = -((values - q) ** 2).sum(axis=1)
        assert got[i] == sorted(range(len(values)), key=lambda j: (-round(score[j], 9), j))[:k]


def test_sparse_retrieval_in_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    weights = rt.sparse_weights(docs, "doc_id", "text", items, "item_id", "text")
    whole = rt.sparse_retrieve(*weights, "doc_id", "item_id", 4).select("query_id", "id", "rank")
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(rt, "MAX_SHIPPED_CELLS", 20_000)
    blocks = rt.sparse_retrieve(*weights, "doc_id", "item_id", 4).select("query_id", "id", "rank")
    assert sorted(map(tuple, blocks.collect())) == want and want
