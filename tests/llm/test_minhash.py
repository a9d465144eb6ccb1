import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import minhash
from textloom.llm.common import Rolling, WordHashes


def brute(rows, k, percent):
    def shingles(text):
        ascii_lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(edge_docs, edge_rows, k, percent):
    out = minhash.near_duplicates(edge_docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, out), key=repr) == brute(edge_rows, k, percent)


def test_chain_and_crowd(spark):
    """A chain of near copies is one group; a crowd around one page is one group as well."""
    words = [f"c{i}" for i in range(300)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 150])) for i in range(30)]
    crowd = [(100 + i, " ".join(words[:200] + [f"own{i}"])) for i in range(200)]
    rows = chain + crowd
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    got = sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute(rows, 3, 85)


def test_no_rows(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_layout_bounds_the_miss_chance():
    for percent in (50, 80, 85, 90, 100):
        bands, rows = minhash.band_layout(percent)
        assert bands * rows <= minhash.MAX_COORDINATES
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6
    with pytest.raises(ValueError):
        minhash.band_layout(1)


def test_circulant_coordinates_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    same = np.mean(minhash.signature(a, 192) == minhash.signature(b, 192))
    assert abs(same - 1500 / 2500) < 0.12


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 6))
def test_rolling_hashes_tell_runs_apart(words, k):
    runs = Rolling(WordHashes().of(words)).runs(k)
    texts = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert len(runs) == len(texts)
    assert len(set(runs.tolist())) == len(set(texts))


def test_parity_bits_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        bands, rows = minhash.band_layout(percent)
        far = minhash.most_differing(percent, bands * rows)
        worst = 0
        for _ in range(150):
            pool = rng.integers(0, 2**63, 400).astype(np.uint64)
            # Equal sizes with exactly the threshold's similarity or a little more.
            common = int(np.ceil(2 * percent / (100 + percent) * 200))
            a, b = pool[:200], np.concatenate([pool[:common], pool[200 : 400 - common]])
            x, y = (minhash.parity_bits(minhash.signature(v, bands * rows)) for v in (a, b))
            worst = max(worst, int(np.unpackbits((x ^ y).view(np.uint8)).sum()))
        assert worst <= far < 0.27 * bands * rows


def test_versions_without_words_link_nothing(spark):
    """Null versions of paired ids do not end the job, and empty ones are not equal to each other."""
    rows = [(1, "a b c d"), (1, None), (2, "a b c d"), (2, ""), (2, None), (5, "e f g"), (5, " "), (6, "x y z"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")
    assert [tuple(r) for r in minhash.verified(pairs, docs, 3, 85).collect()] == [(1, 2)]


def pages_around_a_body():
    """60 pages of one body and own words, too far apart to be linked; every tenth has a near copy."""
    body = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(50)]
        rows.append((2 * i, " ".join(body + own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(body + own[:-2])))
    return rows


def test_a_common_body_makes_no_pairs(spark):
    rows = pages_around_a_body()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = minhash.sketches(docs, 3, 85).selectExpr("doc_id AS id", "doc_id AS comp", "digest")
    pairs = {tuple(r) for r in minhash.rare_shingle_pairs(docs, chosen, 3, 85).collect()}
    assert pairs == {(2 * i, 2 * i + 1) for i in range(0, 60, 10)}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Near copies among pages around one body are found, by rare shingles and one by one."""
    rows = pages_around_a_body()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (0, 8):
        monkeypatch.setattr(minhash, "CROWD", crowd)
        out = minhash.near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, out), key=repr) == brute(rows, 3, 85)
