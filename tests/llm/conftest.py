import random

import pytest


def invented(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and long texts, repeated rows and ids, copies, near copies, shared passages."""
    rng = random.Random(7)
    base = [f"u{i}" for i in rng.sample(range(10**6), 400)]
    near = base[:]
    near[200] = "other"
    far = base[:300] + [f"v{i}" for i in range(100)]
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(30_000))
    passage = " ".join(f"p{i}" for i in range(70))
    return [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "one two three"),
        (10, " ".join(base)), (11, " ".join(base)), (12, " ".join(near)), (13, " ".join(far)), (14, " ".join(base[1:])),
        (15, long), (16, long + " end"), (17, "Été ß \U0001f600 naïve space \x1c x"),
        (20, "start " + passage + " stop"), (21, passage), (22, "a b c " + passage[:200] + " d"), (23, passage + " " + passage),
        (30, "same row"), (30, "same row"), (31, "first version of it"), (31, "second version of it"),
        (None, "one two three"), (None, None), (40, "de " * 120), (41, "de " * 90), (42, invented(rng, 150, 3)), (43, invented(rng, 150, 3)),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns, some named like those that the operators make."""
    rows = [(i, t, "n", "src", 7, 1, "k", 0.5) for i, t in edge_rows]
    schema = "doc_id long, text string, n string, source string, size int, row int, digest string, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
