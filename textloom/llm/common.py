"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import pin

# Words of the contracts: runs of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Odd multiplier of the rolling hashes (invertible modulo 2^64).
BASE = 0xD6E8FEB86659FD93
CACHED_WORDS = 200_000


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: the rows are whole documents, so a batch stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding.

    ``bytes.split()`` cuts exactly at space and U+0009 to U+000D, and ``bytes.lower()`` maps
    exactly A-Z.
    """
    return column.cast(pa.binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser, a bijection of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word, remembered for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all k-word runs of a sequence of word hashes, in time independent of k."""

    powers = np.empty(0, np.uint64)
    inverse = np.empty(0, np.uint64)

    @classmethod
    def prepare(cls, n: int) -> None:
        """Powers of BASE and of its inverse, grown when a longer text comes."""
        if len(cls.powers) > n:
            return
        size = max(2 * n, 1 << 16)
        for name, factor in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            values = np.full(size, factor, np.uint64)
            values[0] = 1
            setattr(cls, name, np.multiply.accumulate(values))

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.prepare(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.powers[:n], out=self.sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """Hash of the run that starts at each position 0 .. n - k."""
        count = len(self.sums) - k
        if count <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:count]) * self.inverse[:count] + np.uint64(k))


def int64(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list column of one numpy array per row, without Python objects per element."""
    arrays = list(values)
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


FILTER_WORDS = 1 << 17


def id_filter(ids: DataFrame) -> Column:
    """A test that is true for every doc_id in ``ids(doc_id)`` and false for most others; null is in no set.

    A bit filter of fixed size (1 MB). A full one would be true everywhere: what follows has to decide.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_WORDS * 64))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(cast(doc_id AS long)), 64) AS int))")
    set_bits = ids.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    dense = ids.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word").join(set_bits, "word", "left").fillna(0)
    dense = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    word = F.get(pin(dense, "id-bits").scalar(), F.floor(place / 64).cast("int"))
    return F.coalesce(bit.bitwiseAND(word) != 0, F.lit(False))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id stands in ``ids(doc_id)``, moving few of the texts: rows
    that surely stay take no part in the join. Null ids stay."""
    ids = pin(ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "ids-to-drop")
    maybe = id_filter(ids)
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(ids, "doc_id", "left_anti").select(*docs.columns))
