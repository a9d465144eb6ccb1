import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from textloom.llm import quality

UNKNOWN, BEGIN, END = "<unknown>", "<begin>", "<end>"


def reference_model(texts, vocabulary):
    """Interpolated modified Kneser-Ney, written straight from its formulas."""
    counts = Counter(w for t in texts for w in t.split())
    kept = {w for w, _ in sorted(((w, n) for w, n in counts.items() if n > 1), key=lambda x: (-x[1], x[0]))[:vocabulary]}
    three = Counter()
    for t in texts:
        w = [BEGIN, BEGIN, *(x if x in kept else UNKNOWN for x in t.split()), END]
        three.update(zip(w, w[1:], w[2:]))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    bad = {UNKNOWN, BEGIN}

    def cut(table):
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(i, max(quality.LEAST_DISCOUNT, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    d3 = cut({k: c for k, c in three.items() if not bad & {*k[:2]}})
    d2 = cut({k: c for k, c in two.items() if k[0] not in bad})
    d1 = cut(one)
    of2, of3 = defaultdict(list), defaultdict(list)
    for (v, w), c in two.items():
        of2[v].append(c)
    for (u, v, w), c in three.items():
        of3[u, v].append(c)
    total = sum(one.values())
    rest = sum(map(d1, one.values())) / total

    def p1(w):
        return (max(one[w] - d1(one[w]), 0) if one[w] else 0) / total + rest / (len(kept) + 2)

    def p2(v, w):
        if v in bad or v not in of2:
            return p1(w)
        c = two[v, w]
        return ((c - d2(c)) / sum(of2[v]) if c else 0) + sum(map(d2, of2[v])) / sum(of2[v]) * p1(w)

    def p3(u, v, w):
        if bad & {u, v} or (u, v) not in of3:
            return p2(v, w)
        c = three[u, v, w]
        return ((c - d3(c)) / sum(of3[u, v]) if c else 0) + sum(map(d3, of3[u, v])) / sum(of3[u, v]) * p2(v, w)

    kinds = max(len(counts) - len(kept), 2)

    def perplexity(text):
        w = [BEGIN, BEGIN, *(x if x in kept else UNKNOWN for x in text.split()), END]
        logs = [math.log(p3(*x)) - (math.log(kinds) if x[2] == UNKNOWN else 0) for x in zip(w, w[1:], w[2:])]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


def prose(rng, n):
    words, out = [f"w{i}" for i in range(40)], []
    for _ in range(n):
        out.append(words[int(rng.paretovariate(0.7)) % 40] if rng.random() < 0.9 else f"rare{rng.randrange(500)}")
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80), "en") for i in range(300)] + [(1000 + i, " ".join(f"junk{rng.randrange(10**6)}!!" for _ in range(80)), "en") for i in range(40)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, " \n", "xx"), (2003, prose(rng, 60), None), (2004, prose(rng, 60), "xx"), (None, prose(rng, 50), "en"), (2005, "w1", "en"), (2005, "w1", "en"), (2006, prose(rng, 20_000), "en")]
    docs = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, lang string, n int, key string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0, 1) for i in range(200)] + [(1000 + i, 0, 0, 1) for i in range(10)] + [(5, 1, 0, 1), (6, 0, 0, 1), (7, 1, 1, 1), (None, 1, 0, 1), (8, None, None, 1)], "doc_id long, quality int, toxic int, n int")
    return rows, docs, labels


def test_perplexity_equals_the_formulas(corpus, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_COUNT", 1)
    rows, docs, labels = corpus
    fitted = {r["doc_id"] for r in quality.trusted_ids(labels).filter("fit").collect()}
    trusted = [t for i, t, _ in rows if i in fitted]
    assert 60 < len(trusted) < 140 and not fitted & {6, 7, 8}
    want = reference_model(trusted, 30)
    model = quality.fit(docs, labels, vocabulary=30)
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, model).collect()}
    for i, t, _ in rows:
        if i is not None:
            assert (got[i] is None) == (not (t or "").split())
            if got[i] is not None:
                assert got[i] == pytest.approx(want(t), rel=1e-9)


def test_good_text_stays_and_junk_goes(corpus):
    rows, docs, labels = corpus
    out = quality.judged(docs, labels).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert sum(kept[i] for i in range(200, 300)) >= 93
    assert not any(kept[1000 + i] for i in range(40))
    assert not kept[2000] and not kept[2001] and not kept[2002] and kept[2003] and kept[2004]


def test_formulas_hold_at_production_settings(corpus):
    """No run is left out and no word seen twice is unknown."""
    rows, docs, labels = corpus
    fitted = {r["doc_id"] for r in quality.trusted_ids(labels).filter("fit").collect()}
    want = reference_model([t for i, t, _ in rows if i in fitted], None)
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, quality.fit(docs, labels)).collect()}
    for i, t, _ in rows:
        if i is not None and (t or "").split():
            assert got[i] == pytest.approx(want(t), rel=1e-9)


def test_all_trusted_documents_are_fitted(spark, monkeypatch):
    """More than the 10 000 that once were the most."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('a b ', id % 7) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    seen, words = [], quality.frequent_words
    monkeypatch.setattr(quality, "frequent_words", lambda texts, most: seen.append(texts.count()) or words(texts, most))
    quality.fit(docs, labels)
    assert seen == [quality.trusted_ids(labels).filter("fit").count()] and seen[0] > 12_000


def test_every_language_has_its_own_limit(spark):
    """A rare language above the limit of the large one keeps its documents; one without evidence keeps all."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    held = sorted(r["doc_id"] for r in quality.trusted_ids(labels).filter("NOT fit").collect())
    scores = [(i, "en", 10.0) for i in held[:-4]] + [(i, "xx", 500.0) for i in held[-4:-1]] + [(held[-1], None, 70.0), (900, "yy", 9e9)]
    got = {r["lang"]: r["limit"] for r in quality.limits(spark.createDataFrame(scores, "doc_id long, lang string, perplexity double"), labels).collect()}
    assert set(got) == {"en", "xx", None} and 10 <= got["en"] < 11 and got["xx"] > 500 and 70 < got[None] < 500


def test_held_out_accuracy_on_the_tables(spark):
    """Fitted without the labels of odd documents, and judged on those."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.judged(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    share = {q: out.filter(f"quality = {q} AND kept").count() / out.filter(f"quality = {q}").count() for q in (0, 1)}
    assert share[1] >= 0.97 and share[0] <= 0.5


def test_without_labels_or_rows(spark, no_docs, corpus):
    _, docs, labels = corpus
    none = labels.limit(0)
    assert quality.judged(no_docs, none).collect() == [] and quality.judged(no_docs, labels).collect() == []
    kept = [r for r in quality.judged(docs, none).collect() if r["kept"]]
    assert len(kept) == docs.filter("length(trim(translate(text, '\n', ''))) > 0").count()


def test_the_model_keeps_few_bytes_a_run(spark, monkeypatch):
    """Counts of runs, sorted and packed, instead of a hash and a logarithm each."""
    monkeypatch.setattr(quality, "FILTER_BITS", (1 << 15, 1 << 16))
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(500)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    fitted = {r["doc_id"] for r in quality.trusted_ids(labels).filter("fit").collect()}
    three = {x for i in fitted for w in [texts[i].split()] for x in zip(w, w[1:], w[2:])}
    runs = len(three) + len({x[1:] for x in three})
    path = quality.fit(docs, labels).values.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert sum(f.stat().st_size for f in Path(path).iterdir()) < 8 * runs


def test_batches_that_ask_nothing_and_many_batches(corpus, monkeypatch):
    rows, docs, labels = corpus
    model = quality.fit(docs, labels)
    scored = lambda found: {r["doc_id"]: r["perplexity"] or 0.0 for r in found}
    want = scored(quality.perplexities(docs, model).collect())
    monkeypatch.setattr(quality, "BATCH_DOCUMENTS", 1)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = quality.perplexities(docs, model).collect()
    finally:
        docs.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and scored(got) == pytest.approx(want, rel=1e-12)


def test_forgotten_words_keep_their_numbers(monkeypatch):
    monkeypatch.setattr(quality, "CACHED_WORDS", 3)
    words = [f"w{i}".encode() for i in range(6)]
    ids = quality.Ids(quality.np.unique(quality.WordHashes().of(words[:5])))
    first = {w: ids.of(w).tolist() for w in words}
    assert sorted(n for n, _ in first.values()) == [0, 1, 2, 3, 4, 5] and first[words[5]] == [5, 6]
    assert ids.of(b" ".join(words)).tolist() == [first[w][0] for w in words] + [6] and ids.of(b"").tolist() == [6]
