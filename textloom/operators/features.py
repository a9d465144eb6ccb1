"""Term weights, skip-gram pairs and document vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as tx
from textloom.operators.skew import lookup
from textloom.session import MAX_SHIPPED_ROWS, parts_of, pin, scalar


def word_tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


# Characters of text whose terms one task counts.
COUNTED_CHARS = 16_000_000


def term_counts(df: DataFrame, key: str, tokens: Column, max_n: int = 1, size: Column | None = None) -> DataFrame:
    """(key, term, tf) over n-grams up to ``max_n``.

    Rows are placed by key once; counting per (key, term) and later per key needs no further
    shuffle, and a term that occurs everywhere never gathers in one task. With ``size``, the length of
    a row's text, a task gets about COUNTED_CHARS, so that its counts fit in memory.
    """
    grams = tokens
    if max_n > 1:
        grams = F.concat(*[tx.ngrams(F.col("_t"), n) for n in range(1, max_n + 1)])
    placed = df.select(key, tokens.alias("_t"))
    placed = placed.repartition(key) if size is None else placed.repartition(parts_of(df, size, COUNTED_CHARS), key)
    exploded = placed.select(key, F.explode(grams if max_n > 1 else F.col("_t")).alias("term"))
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


# Rows whose terms are counted at a time.
ROWS_COUNTED = 1000


def row_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, word, c): words of each row with their count there; rows that share a key stay apart. No shuffle, no table of all words."""
    found = df.select(key, tokens.alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_COUNTED):
                part = batch.slice(start, ROWS_COUNTED)
                words, row = _word_places(part.column("_t"))
                coded = words.dictionary_encode(null_encoding="encode")
                kinds = max(len(coded.dictionary), 1)
                at, c = np.unique(row * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at // kinds)), coded.dictionary.take(pa.array(at % kinds)), pa.array(c)], [key, "word", "c"])

    return found.mapInArrow(run, f"{key} {found.schema[key].dataType.simpleString()}, word string, c bigint")


def word_sums(df: DataFrame, key: str, tokens: Column, table: DataFrame, columns: list[str]) -> DataFrame:
    """(key, *columns): sums of the columns of ``table(word, n, ...)`` over the words of each key, repeats counted.

    ``n`` is how often a word occurs. A table of up to SHIPPED_WORDS words is sent to the tasks and nothing but the sums is
    shuffled; a larger one is joined by word.
    """
    if table.count() > SHIPPED_WORDS:
        hits = lookup(row_counts(df, key, tokens), table.select("word", *columns), "word", counts=table)
        return hits.groupBy(key).agg(*[F.sum(F.col("c") * F.col(c)).alias(c) for c in columns])
    shipped = table.select("word", *columns).toArrow()
    values = [np.append(shipped[c].to_numpy(), 0) for c in columns]
    sent = df.sparkSession.sparkContext.broadcast((shipped["word"].combine_chunks(), values))
    found = df.select(key, tokens.alias("_t"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = sent.value
        for batch in batches:
            places, row = _word_places(batch.column("_t"))
            at = pc.fill_null(pc.index_in(places.cast(words.type), words), -1).to_numpy(zero_copy_only=False)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sums = []
            for x in values:
                if x.dtype.kind == "f":
                    sums.append(np.bincount(row, x[at], batch.num_rows))
                else:
                    sums.append(np.diff(np.append(0, np.cumsum(x[at]))[ends]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], [key, *columns])

    rows = found.mapInArrow(run, f"{key} {found.schema[key].dataType.simpleString()}, {types}")
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])


def features(counts: DataFrame, n_docs: Column, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """(term, df, total): terms inside the document-frequency limits, the most frequent first."""
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    stats = stats.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(float(max_df))))
    if max_features is not None:
        stats = stats.orderBy(F.desc("total"), "term").limit(max_features)
    return stats


def count_matrix(
    df: DataFrame, key: str, text: str, max_features: int = 2000, min_df: int = 5, max_df: float = 0.7,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Long form (key, term, tf) of the count matrix."""
    tokens = tx.drop_stop_words(word_tokens(F.col(text)), stop_words)
    counts = term_counts(df, key, tokens, size=F.length(text))
    kept = features(counts, _n_rows(df), min_df, max_df, max_features).select("term")
    return counts.join(F.broadcast(kept) if _shipped(max_features) else kept, "term").select(key, "term", "tf")


def _shipped(max_features: int | None) -> bool:
    """Whether a feature table is small enough, by its limit, to be sent to every task."""
    return max_features is not None and max_features <= MAX_SHIPPED_ROWS


def _n_rows(df: DataFrame) -> Column:
    return scalar(df.agg(F.count(F.lit(1)).alias("n")), F.col("n"))


def tfidf(
    df: DataFrame, key: str, text: str, max_features: int | None = 5000, min_df: int = 5, max_df: float = 0.7,
    max_n: int = 2,
) -> DataFrame:
    """(key, term, tf, weight): smooth idf, unit length per row.

    With ``max_features`` the feature table is bounded and shipped to every task, so the count
    rows of dropped terms end where they are made. Without it the join is left to the optimizer.
    """
    counts = term_counts(df, key, word_tokens(F.col(text)), max_n, F.length(text))
    n_docs = _n_rows(df)
    kept = features(counts, n_docs, min_df, max_df, max_features)
    idf = (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf")
    kept = kept.select("term", idf)
    weighed = counts.join(F.broadcast(kept) if _shipped(max_features) else kept, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    return unit_length(weighed, key).select(key, "term", "tf", "weight")


def unit_length(weighed: DataFrame, key: str) -> DataFrame:
    """Add ``weight``: ``raw`` scaled to unit length per key.

    A window over the key (one row's terms) reads its input once; a group and join back would
    compute it twice.
    """
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighed.withColumn("weight", F.col("raw") / norm)


def top_terms(weights: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, rank, term, weight): heaviest terms of every row; ties by term."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(key, F.col("rank").cast("bigint").alias("rank"), "term", "weight")


# Words that are sent to the tasks at most, as one Arrow array of some 20 bytes a word.
SHIPPED_WORDS = 2_000_000
# Words whose hashes are sent to the tasks at most, 16 bytes a word.
HASHED_WORDS = 8_000_000
# Places that are paired at a time, and different pairs that a task holds before it hands them on.
PLACES = 200_000
HELD_PAIRS = 750_000
# Pairs whose counts are added up in one group, before any are equal.
CELL_PAIRS = 4_000_000


def _word_places(arrays: pa.ListArray | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and the list that each stands in."""
    rows = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    return rows.flatten(), pc.list_parent_indices(rows).to_numpy(zero_copy_only=False)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and the sum of the counts of each."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed_pairs(key: np.ndarray, n: np.ndarray, side: int) -> pa.RecordBatch:
    """Sorted pairs ``a << 32 | b`` with counts below 2^32, cut into the cells of a grid over the ids.

    A block holds steps between neighbours, their bytes in order of weight, compressed: a few bytes a pair.
    """
    a, b = key >> 32, key & 0xFFFFFFFF
    cell = (a % side * side + b % side).astype(np.uint16 if side < 256 else np.uint32)
    order = np.argsort(cell, kind="stable")
    cell, a, b = cell[order], a[order] // side, b[order] // side
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
    step, jump = np.diff(a, prepend=0), np.diff(b, prepend=0)
    step[starts] = a[starts]
    fresh = step != 0
    fresh[starts] = True
    jump[fresh] = b[fresh]
    plain = np.stack([step, jump, n[order]]).astype("<u4")
    ends = np.append(starts, len(cell))
    blocks = [
        pa.compress(np.ascontiguousarray(plain[:, s:e]).view(np.uint8).reshape(3, e - s, 4).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)
        for s, e in zip(ends, ends[1:])
    ]
    sizes = pa.array(np.diff(ends), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(cell[starts].astype(np.int32)), sizes, pa.array(blocks, pa.binary())], ["cell", "size", "block"])


def _unpacked_pairs(cell: int, size: int, block: pa.Buffer, side: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(block, 12 * size, codec="zstd"), np.uint8)
    step, jump, n = np.ascontiguousarray(raw.reshape(3, 4, size).transpose(0, 2, 1)).view("<u4").reshape(3, size).astype(np.int64)
    fresh = np.flatnonzero(np.append(True, step[1:] != 0))
    b = np.cumsum(jump)
    b -= np.repeat(b[fresh] - jump[fresh], np.diff(np.append(fresh, size)))
    return (np.cumsum(step) * side + cell // side) << 32 | b * side + cell % side, n


def _hashed(word: Column) -> Column:
    return F.when(word.isNotNull(), F.struct(F.xxhash64(word).alias("h"), F.hash(word).alias("check")))


def word_pairs(df: DataFrame, tokens: Column, vocab: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, n): ids a <= b of words at most ``window`` apart, both in the vocabulary, and how often they are, in either order.

    Words become ids before anything is paired, a task adds up equal pairs of bounded stretches, and every pair of ids is
    shuffled once, packed; groups of bounded size are added up. Of a vocabulary of up to HASHED_WORDS words, hashes are sent to
    the tasks, and a word of 96 equal bits counts as equal; a larger one is joined by word.
    """
    vocab = pin(vocab, "vocabulary")
    if (vocab.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("word ids must be below 2^31")
    rows = df.select(tokens.alias("_t")).filter(F.size("_t") > 1)
    places = vocab.agg(F.sum("n")) if "n" in vocab.columns else rows.agg(F.sum(F.size("_t")))
    cells = max((places.first()[0] or 0) * window / CELL_PAIRS, df.sparkSession.sparkContext.defaultParallelism)
    side = math.ceil(math.sqrt(cells))
    shipped = None
    if vocab.count() <= HASHED_WORDS:
        shipped = vocab.select(_hashed(F.col("word")).alias("w"), F.col("id").cast("int")).select("w.h", "w.check", "id").toArrow()
        shipped = [shipped[c].to_numpy() for c in ("h", "check", "id")]
        order = np.argsort(shipped[0])
        shipped = [x[order] for x in shipped]
    if shipped is not None and (np.diff(shipped[0]) != 0).all():
        sent = df.sparkSession.sparkContext.broadcast([np.append(x, x.dtype.type(-1)) for x in shipped])
        rows = rows.select(F.transform("_t", _hashed).alias("_t"))

        def as_ids(found: pa.StructArray) -> np.ndarray:
            hashes, checks, ids = sent.value
            h, check = (pc.fill_null(pc.struct_field(found, i), 0).to_numpy(zero_copy_only=False) for i in (0, 1))
            different, back = np.unique(h, return_inverse=True)
            at = np.searchsorted(hashes[:-1], different)[back]
            known = (hashes[at] == h) & (checks[at] == check) & pc.is_valid(found).to_numpy(zero_copy_only=False)
            return np.where(known, ids[at], -1).astype(np.int64)
    else:
        placed = rows.withColumn("_row", F.monotonically_increasing_id())
        words = pin(placed.select("_row", F.posexplode("_t").alias("_pos", "word")), "word-places")
        known = lookup(words, vocab.select("word", "id"), "word", how="left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "id"))).alias("_t"))
        rows = known.select(F.transform("_t", lambda x: F.coalesce(x["id"], F.lit(-1))).alias("_t"))
        as_ids = lambda found: found.to_numpy(zero_copy_only=False)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64)
        keys, counts, waiting, paired = [nothing], [nothing], 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_COUNTED):
                found, row = _word_places(batch.column("_t").slice(first, ROWS_COUNTED))
                for start in range(0, len(found), PLACES):
                    x, at = as_ids(found.slice(start, PLACES + window)), row[start : start + PLACES + window]
                    for gap in range(1, window + 1):
                        end = min(PLACES, len(x) - gap)
                        if end <= 0:
                            break
                        a, b = x[:end], x[gap : end + gap]
                        both = (a >= 0) & (b >= 0) & (at[:end] == at[gap : end + gap])
                        a, b = a[both], b[both]
                        key, n = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b), return_counts=True)
                        keys.append(key)
                        counts.append(n)
                        waiting += len(key)
                        paired += len(a)
                    if waiting > HELD_PAIRS or paired > 1 << 31:
                        merged = _added(keys, counts)
                        keys, counts, waiting = [merged[0]], [merged[1]], 0
                        if len(keys[0]) > HELD_PAIRS or paired > 1 << 31:
                            yield _packed_pairs(keys[0], counts[0], side)
                            keys, counts, paired = [nothing], [nothing], 0
        yield _packed_pairs(*_added(keys, counts), side)

    def added(blocks: pa.Table) -> pa.Table:
        keys, counts, waiting = [], [], 0
        for cell, size, block in zip(*(blocks[c].combine_chunks() for c in ("cell", "size", "block"))):
            key, n = _unpacked_pairs(cell.as_py(), size.as_py(), block.as_buffer(), side)
            keys.append(key)
            counts.append(n)
            waiting += len(key)
            if waiting > HELD_PAIRS:
                merged = _added(keys, counts)
                keys, counts, waiting = [merged[0]], [merged[1]], 0
        key, n = _added(keys, counts)
        table = pa.table({"a": key >> 32, "b": key & 0xFFFFFFFF, "n": n})
        return pa.Table.from_batches(table.to_batches(max_chunksize=PLACES), table.schema)

    packed = rows.mapInArrow(pairs, "cell int, size int, block binary")
    return packed.groupBy("cell").applyInArrow(added, "a bigint, b bigint, n bigint")


def skipgram_pairs(df: DataFrame, tokens: Column, vocab: DataFrame, window: int = 5) -> DataFrame:
    """(target, context, n): ids of words at most ``window`` apart, both in the vocabulary.

    Both directions of a pair come from one counted row; a word beside itself is its own target twice.
    """
    known = word_pairs(df, tokens, vocab, window)
    same = F.struct(F.col("a").alias("target"), F.col("b").alias("context"), (F.col("n") * 2).alias("n"))
    turned = F.array(
        F.struct(F.col("a").alias("target"), F.col("b").alias("context"), "n"),
        F.struct(F.col("b").alias("target"), F.col("a").alias("context"), "n"),
    )
    return known.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(same)).otherwise(turned)))


def sum_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): element-wise sum, combined before the shuffle."""
    return _fold_vectors(rows, key, vector, F.sum)


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return _fold_vectors(rows, key, vector, F.avg)


def _fold_vectors(rows: DataFrame, key: str, vector: str, fold) -> DataFrame:
    dims = rows.select(key, F.posexplode(vector).alias("i", "x"))
    folded = dims.groupBy(key, "i").agg(fold(F.col("x").cast("double")).alias("x"))
    # At most one row per dimension and key: the list is as long as the vector.
    ordered = folded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return ordered.select(key, F.col("v.x").alias(vector))


def doc_vectors(df: DataFrame, key: str, tokens: Column, vectors: DataFrame, size: int) -> DataFrame:
    """(key, vector): mean vector of the known words of each row, zeros when there are none."""
    words = df.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))
    known = lookup(words, vectors.select("word", "vector"), "word")
    dims = known.select(key, "c", F.posexplode("vector").alias("i", "x"))
    sums = dims.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("x"))
    means = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.select(key).join(means, key, "left").select(key, F.coalesce(F.col("v.x"), zeros).alias("vector"))
