import hashlib
import random
import zlib

import pytest

from textloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def small(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """Levels of a tree from the leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        out.append((level[first:i], level[i + 1 : first + 8]))
        i //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {}
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        of[lang] = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {lang: tree([leaf(r) for r in mine]) for lang, mine in of.items()}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, r in enumerate(of[lang]):
            steps = path(trees[lang], i) + path(top, at)
            node = leaf(r) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else leaf((*r[:4], small(r[4])))
            for left, right in steps:
                node = H("".join(left) + node + "".join(right))
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[lang][-1][0], root, H("".join(h for a, b in steps for h in a + b)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (8, 9, 64), (65, 512, 513, 3), (1200, 1, 1, 1, 1, 1, 1, 1, 1, 1)])
def test_equal_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    rows, names = [], [None, "", "Ä", "a", "b", "c", "d", "e", "f", "é\U0001f600"]
    for lang, n in zip(names, sizes):
        rows += [(rng.randrange(-50, 10**6), rng.choice(["s", None, ""]), lang, rng.choice([None, 5]), rng.choice([None, "", "Text ÄÖ A-Z", "lower", "Word " * 30])) for _ in range(n)]
    rows += [(None, None, names[0], None, "X"), rows[0], (rows[0][0], *rows[0][1:4], "another version")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, i int, tree string")
    assert sorted(map(tuple, merkle.checked(docs.repartition(3)).collect()), key=str) == brute(rows)


def test_only_altered_texts_with_capitals_fail(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and small(r["text"]) != r["text"]}
    assert {r["doc_id"] for r in merkle.checked(docs).collect() if not r["verified"]} == changed


def test_every_third_level_is_stored(spark):
    rows = [(0, "t", i, 5000, str(i)) for i in range(5000)]
    leaves = spark.createDataFrame([(t, i, n, h) for _, t, i, n, h in rows], "tree string, i long, n long, hash string")
    manifest = merkle.grown(leaves)
    assert [level.count() for level in manifest.levels] == [5000, 10, 1]


def test_no_rows(no_docs):
    assert merkle.checked(no_docs).collect() == []
