"""Every query with a SQL twin gives the twin's rows on the smallest tables; the rest give rows."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, rows_of

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

# These train models and have exact tests of their own operators.
SLOW = {"word2vec", "model_comparison", "linear_svm", "random_forest", "nmf_topics", "lda_topics", "unigram_encode", "bpe_encode", "wordpiece_encode"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    relation = duck.sql(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry(spark):
    assert {r["lang"] for r in entry_module.entry(spark).collect()} <= {"en", "de", "es", "fr"}
