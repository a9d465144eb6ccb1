"""Ranked lexical search by bag de-duplication: equal bags are scored once, then expanded."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import utf8
from textloom.session import collect_bounded, pin

# (item, term) pairs that one block of items ships to the tasks, about; more items make more blocks.
BLOCK_PAIRS = 1_000_000
# An item alone may have more; beyond this it is refused.
MOST_TERMS = 2_000_000
# Tasks that a class's members are spread over before they meet; scores that a task holds at a time.
SALTS = 32
GRID = 2_000_000
# Stands for a null doc_id, which comes last.
NO_ID = 2**63 - 1
# Bytes that are no part of a term become a space, A-Z small letters.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(LETTERS).split()


class Block(NamedTuple):
    """The terms of some items: ``terms`` in order, and per term the items that hold it (in ``items``) and how often."""

    items: list
    terms: list[bytes]
    starts: np.ndarray
    places: np.ndarray
    repeats: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of ``items(item_id, text)``; rows that share an item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(utf8(batch.column("text"))):
                counts = Counter(terms_of(text or b""))
                ids = batch.column("item_id").take(pa.array([i] * len(counts), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item_id", "term", "n"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary, n long")
    return rows.groupBy("item_id", "term").agg(F.sum("n").alias("repeats"))


def blocks(wanted: DataFrame) -> Iterator[Block]:
    """Blocks of whole items, each of a bounded number of terms."""
    pairs = wanted.count()
    n = max(1, math.ceil(2 * pairs / BLOCK_PAIRS))
    for i in range(n):
        part = wanted if n == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        rows = collect_bounded(part, max(BLOCK_PAIRS, MOST_TERMS), "terms of a block of items")
        if not rows:
            continue
        items = sorted({r["item_id"] for r in rows}, key=lambda x: (x is not None, x or 0))
        place = {item: j for j, item in enumerate(items)}
        rows.sort(key=lambda r: (bytes(r["term"]), place[r["item_id"]]))
        names = [bytes(r["term"]) for r in rows]
        terms = sorted(set(names))
        first = {}
        for j, t in enumerate(names):
            first.setdefault(t, j)
        starts = np.array([first[t] for t in terms] + [len(rows)], np.int64)
        yield Block(items, terms, starts, np.array([place[r["item_id"]] for r in rows], np.int64), np.array([r["repeats"] for r in rows], np.int64))


def bags(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs): all terms of a document counted, and its bag restricted to ``terms`` (their numbers, ascending)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(sent.value)}
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in utf8(batch.column("text")):
                words = terms_of(text or b"")
                found = sorted(Counter(filter(None.__ne__, map(numbers.get, words))).items())
                sizes.append(len(words))
                ids.append([i for i, _ in found])
                tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def bag_classes(counted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(ids, tfs, m, members, low): one row per different bag and length figure m; ``members`` are its k smallest doc_ids, null last.

    A hash leads the key, the bags themselves complete it, so equal hashes never merge different bags. Of each class a scan
    partition sends k ids at most, to one of SALTS tasks, so a class that holds a third of all rows stays small everywhere.
    """
    m = F.lit(100 - 75) + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    rows = counted.filter("size(ids) > 0").select("doc_id", "ids", "tfs", m.alias("m"))
    rows = rows.select(F.xxhash64("ids", "tfs", "m").alias("key"), "ids", "tfs", "m", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = Window.partitionBy("key", "ids", "tfs", "m", "salt").orderBy("doc_id")
    least = rows.withColumn("row", F.row_number().over(first)).filter(F.col("row") <= k)
    members = F.slice(F.array_sort(F.collect_list("doc_id")), 1, k)
    return least.groupBy("key", "ids", "tfs", "m").agg(members.alias("members")).select("ids", "tfs", "m", "members", F.col("members")[0].alias("low"))


def best_classes(classes: DataFrame, block: Block, weights: list[int], k: int) -> DataFrame:
    """(item_id, score, members): per task and item the k best classes, by score and then by smallest member.

    Every class is scored once, for all items of the block together. Scores are 64-bit integers.
    """
    sent = classes.sparkSession.sparkContext.broadcast((block, np.array(weights, np.int64)))

    def scores(batch: pa.RecordBatch, block: Block, weight: np.ndarray) -> np.ndarray:
        lengths = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
        term = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        m = batch.column("m").to_numpy(zero_copy_only=False)[row]
        part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        out = np.zeros((len(lengths), len(block.items)), np.int64)
        # Each (class, term) meets the items that hold the term.
        width = block.starts[term + 1] - block.starts[term]
        at = np.repeat(block.starts[term] - np.cumsum(width) + width, width) + np.arange(width.sum())
        np.add.at(out, (np.repeat(row, width), block.places[at]), np.repeat(part, width) * block.repeats[at])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = sent.value
        # Per item (minus score, smallest member, members), best first.
        best: list[list[tuple[int, int, list]]] = [[] for _ in block.items]
        # Few classes at a time if there are many items, so that the score grid stays small.
        step = max(1, GRID // len(block.items))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            low = batch.column("low").to_numpy(zero_copy_only=False)
            for i, column in enumerate(scores(batch, block, weight).T):
                least = -best[i][-1][0] if len(best[i]) == k else 1
                hits = np.flatnonzero(column >= least)
                if len(hits) > k:
                    hits = hits[np.lexsort((low[hits], -column[hits]))[:k]]
                if len(hits):
                    new = [(-int(column[h]), int(low[h]), batch.column("members")[int(h)].as_py()) for h in hits]
                    best[i] = sorted(best[i] + new, key=lambda x: x[:2])[:k]
        rows = [(block.items[i], -score, ids) for i, found in enumerate(best) for score, _, ids in found]
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["item_id", "score", "members"])

    return classes.mapInArrow(run, "item_id long, score long, members array<long>")


def top_of_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    counted = pin(bags(docs, block.terms), "bags", compression="zstd")
    total = counted.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return docs.sparkSession.createDataFrame([], "item_id long, score long, doc_id long")
    df = np.zeros(len(block.terms), np.int64)
    for r in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["id"]] = r["df"]
    weights = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(d) + 1))) for d in df]
    classes = bag_classes(counted, total["docs"], total["terms"], k)
    best = best_classes(classes, block, weights, k)
    return best.select("item_id", "score", F.explode("members").alias("doc_id")).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of ``docs(doc_id, text)`` with the highest scores above 0 for each item.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, only A-Z lower-cased, of whole texts. Each
    row of ``docs`` is a document of its own, also if its id or text repeats; equal scores are ordered by doc_id, null last.
    Null and empty texts hold no term and are not counted. Rows of ``items`` that share an item_id (null is one) are one
    item with the terms of all; items without terms have no rows. Other columns are ignored; without documents there are
    no rows. Items are treated in blocks of BLOCK_PAIRS (item, term) pairs; a block above MOST_TERMS is refused.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = pin(item_terms(items), "item-terms")
    found = spark.createDataFrame([], "item_id long, score long, doc_id long")
    for block in blocks(wanted):
        found = found.unionByName(top_of_block(docs, block, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
