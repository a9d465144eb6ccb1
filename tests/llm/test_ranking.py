import math
import random
import re
from collections import Counter

from textloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(w), len(w)) for i, w in bags if w]
    N, L = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, []).extend(terms(text))
    out = []
    for item, words in wanted.items():
        found = []
        for i, bag, n in bags:
            m = 25 + (75 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in words if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def make(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "m") for i, t in docs], "doc_id long, text string, n int, ids string").repartition(4),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int").repartition(2),
    )


def example():
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "été", "Été", "ß1", "x_y", "a-b", "\U0001f600", "9", "the", "the", "the"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", "\n", "\x1c", "  "]).join(rng.choices(words, k=n))
    docs = [(rng.randrange(400), text(rng.randrange(0, 60))) for _ in range(300)]
    docs += [(i, "the alpha beta copy") for i in range(500, 900)] + [(None, "alpha beta"), (None, None), (1, None), (2, ""), (3, " .,;"), (4, "alpha " * 5000), (5, text(8000))]
    items = [(i, text(12)) for i in range(12)] + [(3, "more of it: alpha"), (20, None), (21, ""), (22, "nowhere found"), (None, "beta beta w1"), (23, "the the the"), (24, text(3000))]
    return docs, items


def test_equal_brute_force(spark):
    docs, items = example()
    out = ranking.top_documents(*make(spark, docs, items))
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    docs, items = example()
    monkeypatch.setattr(ranking, "BLOCK_PAIRS", 150)
    monkeypatch.setattr(ranking, "GRID", 100)
    assert sorted(map(tuple, ranking.top_documents(*make(spark, docs, items)).collect()), key=str) == brute(docs, items)


def test_equal_bags_are_scored_once(spark):
    docs, items = example()
    docs, items = make(spark, docs, items)
    block = next(ranking.blocks(ranking.item_terms(items)))
    counted = ranking.bags(docs, block.terms)
    classes = ranking.bag_classes(counted, 700, 20_000, 10)
    assert classes.filter("size(ids) = 3 AND members[0] = 500").collect()[0]["members"] == list(range(500, 510))
    assert classes.count() == classes.select("ids", "tfs", "m").distinct().count()


def test_no_rows(spark, no_docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.top_documents(no_docs, items).collect() == []
    assert ranking.top_documents(items.select(items.item_id.alias("doc_id"), "text"), items.limit(0)).collect() == []
