"""Exact and near-duplicate removal."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.skew import lookup
from textloom.session import pin


def first_row_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Earliest row per key. The hash leads the sort, so long keys are compared only on ties.

    ``row_number() = 1`` becomes a group limit before the shuffle: a hot key sends one row per
    input partition.
    """
    w = Window.partitionBy(F.xxhash64(key), F.col(key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def exact_dedup(df: DataFrame, text: str = "content_clean", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    return first_row_per_key(df, text, list(order))


def copy_links(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, rep) for every row: ``rep`` is the smallest id with the same text."""
    keyed = df.select(id_col, F.sha2(F.col(text), 256).alias("digest"))
    reps = keyed.groupBy("digest").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))
    repeated = reps.filter("n > 1")
    return lookup(keyed, repeated.select("digest", "rep"), "digest", counts=repeated).select(id_col, "rep")


def band_layout(threshold: float, miss: float = 1e-6, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): longest rows whose miss probability at the threshold stays below ``miss``."""
    best = None
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no layout of {max_hashes} hashes finds pairs at {threshold} with miss chance {miss}")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-character windows of the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mix(h + codes[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


# Coordinates of a sketch at most. Longer bands keep sets below the threshold out of each other's buckets.
MAX_COORDINATES = 384


def _coordinates(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of as many linear orders of 32-bit numbers."""
    mixed = _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1), mixed.astype(np.uint32)


def _band_keys(hashes: np.ndarray, bands: int, rows: int, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key per band of minima. The upper halves of the hashes are random, so an order needs no mixing of its own."""
    factors, summands = orders
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    # Blocks that stay in the cache.
    for start in range(0, len(upper), 256):
        block = upper[start : start + 256, None] * factors
        block += summands
        np.minimum(low, block.min(axis=0), out=low)
    grid = low.reshape(bands, rows).astype(np.uint64)
    key = np.zeros(bands, np.uint64)
    for j in range(rows):
        key = _mix(key + grid[:, j] + np.uint64(0x9E3779B97F4A7C15))
    return key


def sketches(df: DataFrame, id_col: str, text: str, threshold: float, k: int = 5) -> DataFrame:
    """(id, n, bands) per row with at least one shingle: set size and band keys; Arrow batches, no shuffle."""
    bands, rows = band_layout(threshold, max_hashes=MAX_COORDINATES)
    orders = _coordinates(bands * rows)
    id_type = df.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, content in zip(pdf[id_col], pdf[text]):
                hashes = shingle_hashes(content, k)
                if len(hashes):
                    keys = _band_keys(hashes, bands, rows, orders)
                    out.append((key, len(hashes), keys.view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "n", "bands"])

    schema = f"id {id_type}, n int, bands array<bigint>"
    return df.filter(F.col(text).isNotNull()).select(id_col, text).mapInPandas(sketch, schema)


# A block holds at most this many sets, and about this many bytes of parity bits.
BLOCK_SETS = 4_096
BLOCK_BYTES = 16_000_000


def _parity(hashes: np.ndarray) -> bytes:
    """For each of 2^i cells, at least two a hash, whether the set has an odd number of hashes in it."""
    cells = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    held = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8)).tobytes()


def _differing(a: np.ndarray, b: np.ndarray) -> int:
    """Cells in which two parity rows of 64-bit numbers differ; two sets differ in as many hashes at least."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _possible(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Those of the pinned ``pairs(a, b)`` whose parity bits allow the threshold: all that reach it, and few others.

    Sets of that similarity differ in at most (1 - t) / (1 + t) of their summed sizes. Sets are dealt into
    blocks; a pair of blocks gets the bits of a set once, however many pairs it has there.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    asked = pin(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked-ids")

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_hashes(content, k) for content in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sets], "bits": [_parity(s) for s in sets]})

    sets = texts.join(asked, "id", "left_semi").select("id", "text").mapInPandas(bits, f"id {id_type}, n int, bits binary")
    sets = pin(sets, "parity-sets")
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK_SETS), -(-size["bytes"] // BLOCK_BYTES), 1)
    block = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    placed = pairs.select(F.least(block("a"), block("b")).alias("_i"), F.greatest(block("a"), block("b")).alias("_j"), "a", "b")
    wanted = placed.select(F.col("_i").alias("_x"), F.col("_j").alias("_y"), F.explode(F.array("a", "b")).alias("id"))
    wanted = wanted.distinct().join(sets, "id")

    def compare(block_pairs: pa.Table, block_sets: pa.Table) -> pa.Table:
        # An id may stand for several texts.
        held: dict = {}
        for key, n, row in zip(*(block_sets[c].to_pylist() for c in ("id", "n", "bits"))):
            held.setdefault(key, []).append((n, np.frombuffer(row, np.uint64)))

        def fits(a: tuple, b: tuple) -> bool:
            apart = max(_differing(a[1], b[1]), abs(a[0] - b[0]))
            return apart * (1 + threshold) <= (1 - threshold) * (a[0] + b[0]) + 1e-6

        near = [any(fits(x, y) for x in held[a] for y in held[b]) for a, b in zip(block_pairs["a"].to_pylist(), block_pairs["b"].to_pylist())]
        return block_pairs.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    cells = placed.groupBy("_i", "_j").cogroup(wanted.groupBy("_x", "_y"))
    return cells.applyInArrow(compare, f"a {id_type}, b {id_type}")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, jaccard) of those ``pairs(a, b)`` whose exact Jaccard reaches the threshold.

    ``texts(id, text)`` has one row per id. Only texts of pairs whose parity bits allow the threshold move.
    ``a`` may be a hub shared by a large part of the pairs, hence the salted lookup; its set is built once
    per run of pairs.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    pairs = pin(_possible(pairs, texts, threshold, k), "possible-pairs")
    asked = pin(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked-ids")
    texts = texts.join(asked, "id", "left_semi")
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    hub_counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = lookup(with_b, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a", counts=hub_counts)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, of_hub = None, np.empty(0, np.uint64)
        for pdf in batches:
            found = []
            for text_a, text_b in zip(pdf["text_a"], pdf["text_b"]):
                if text_a != hub:
                    hub, of_hub = text_a, shingle_hashes(text_a, k)
                other = shingle_hashes(text_b, k)
                common = len(np.intersect1d(of_hub, other, assume_unique=True))
                found.append(common / (len(of_hub) + len(other) - common))
            scored = pdf[["a", "b"]].assign(jaccard=found)
            yield scored[scored["jaccard"] >= threshold]

    both = both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return both.mapInPandas(score, f"a {id_type}, b {id_type}, jaccard double")


# Buckets of more rows than this are searched by their rarest shingles instead of row by row.
CROWD = 8
# Rounds in which the rows of a bucket that are still open meet the smallest of them.
STAR_ROUNDS = 2


def _size_fits(n: str, other: str, threshold: float) -> Column:
    return F.least(n, other) >= F.greatest(n, other) * F.lit(threshold) - 1e-9


def _star(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, star): ids (a, b) of each bucket's smallest row and the others of fitting size, and (bucket, id, n, root, root_n)."""
    roots = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("root"), F.count(F.lit(1)).alias("size"))
    roots = pin(roots.filter("size > 1"), "bucket-roots")
    star = lookup(rows, roots.select("bucket", "root"), "bucket", counts=roots, weight="size").filter("id != root.id")
    star = pin(star.select("bucket", "id", "n", F.col("root.id").alias("root"), F.col("root.n").alias("root_n")), "stars")
    pairs = star.filter(_size_fits("n", "root_n", threshold)).select(F.col("root").alias("a"), F.col("id").alias("b"))
    return pairs.distinct(), star


def _open_pairs(rows: DataFrame, key: str, fits: Column) -> DataFrame:
    """Pairs (a, b) of the pinned ``rows(key, id, n, comp, best, ...)`` under one key that can still tell something.

    That is: the two belong to different groups, or the smaller id is below the earliest partner known of
    the larger. Under each key, members of the largest group whose partner is at or below the group's
    smallest id there are settled among themselves; only the others meet everybody. ``fits`` compares
    a row's columns with those of the other, which end in ``_1``.
    """
    parts = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"))
    main = parts.groupBy(key).agg(F.max_by(F.struct("comp", "low"), F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"))
    main = pin(main.filter("size > 1"), "main-groups")
    rows = lookup(rows, main.select(key, "main"), key, counts=main, weight="size")
    settled = (F.col("comp") == F.col("main.comp")) & (F.col("best") <= F.col("main.low"))
    unsettled = rows.filter(~settled).drop("main")
    unsettled = unsettled.select(key, *[F.col(c).alias(f"{c}_1") for c in unsettled.columns if c != key])
    earlier = F.least("id", "id_1") < F.when(F.col("id") > F.col("id_1"), F.col("best")).otherwise(F.col("best_1"))
    useful = (F.col("comp") != F.col("comp_1")) | earlier
    pairs = rows.join(unsettled, key).filter((F.col("id") != F.col("id_1")) & useful & fits)
    return pairs.select(F.least("id", "id_1").alias("a"), F.greatest("id", "id_1").alias("b")).distinct()


# Cells in which shingles are counted to order them, and rows that a task hands on at a time.
COUNT_CELLS = 1 << 22
RARE_ROWS = 200_000


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNT_CELLS - 1)).astype(np.int64)


def _rare_shingle_rows(texts: DataFrame, chosen: DataFrame, threshold: float, k: int) -> DataFrame:
    """(shingle, id, n, comp, best, at): the rarest shingles of each of ``chosen(id, comp, best)``, with their place ``at``.

    Shingles are ordered by what their cell counts over all chosen sets, fewest first, then by hash: one order for all
    sets, so any two that reach the threshold share one of the first ``n - ceil(threshold * n) + 1`` of each.
    Those alone in their cell are left out but counted in ``at``. No shingle moves but the chosen ones.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    spark = texts.sparkSession
    texts = texts.join(chosen, "id").select("id", "comp", "best", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNT_CELLS, np.int64)
        for pdf in batches:
            for content in pdf["text"]:
                np.add.at(counts, _cells(shingle_hashes(content, k)), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": at, "n": counts[at]})

    # At most COUNT_CELLS rows.
    counted = texts.select("text").mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_CELLS, np.int32)
    counts[counted["cell"].to_numpy()] = np.minimum(counted["n"].to_numpy(), np.iinfo(np.int32).max)
    shipped = spark.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shipped.value
        for pdf in batches:
            out, waiting = [], 0
            for key, comp, best, content in zip(pdf["id"], pdf["comp"], pdf["best"], pdf["text"]):
                hashes = shingle_hashes(content, k)
                held = counts[_cells(hashes)]
                prefix = len(hashes) - math.ceil(len(hashes) * threshold - 1e-9) + 1
                first = np.lexsort((hashes, held))[:prefix]
                at = np.flatnonzero(held[first] > 1)
                columns = {"shingle": hashes[first[at]].view(np.int64), "id": key, "n": len(hashes), "comp": comp, "best": best, "at": at}
                out.append(pd.DataFrame(columns))
                waiting += len(at)
                if waiting >= RARE_ROWS:
                    yield pd.concat(out)
                    out, waiting = [], 0
            if out:
                yield pd.concat(out)

    return texts.mapInPandas(cut, f"shingle bigint, id {id_type}, n int, comp {id_type}, best {id_type}, at int")


def near_dup_edges(df: DataFrame, id_col: str, text: str, threshold: float = 0.9, k: int = 5) -> DataFrame:
    """Verified edges (a < b, jaccard) among distinct texts that connect every near-dup cluster and hold every row's earliest partner.

    Inside a band bucket everybody is first compared with the bucket's smallest id; those who do not match
    it then meet the smallest of themselves. So a bucket of m near copies costs a few times m comparisons.
    What stays open meets the others of its bucket where the two are in different groups, or where an earlier
    partner is possible: one by one in buckets of CROWD rows at most; the rows of all larger buckets meet
    over their rarest shingles (with length and position bounds, exact), so pages around one
    common body make no pairs unless they reach the threshold, or nearly so.
    """
    reps = exact_dedup(df.filter(F.col(text).isNotNull()).select(id_col, text), text, (id_col,))
    texts = pin(reps.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "distinct-texts", compression="zstd")
    return _edges(texts, threshold, k)


def _edges(texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The edges of ``near_dup_edges`` among the pinned, distinct ``texts(id, text)``."""
    sk = pin(sketches(texts, "id", "text", threshold, k), "sketches")
    rows = sk.select("id", "n", F.posexplode("bands").alias("band", "key"))
    # One composite key lets the lookup spread a bucket that holds a large share of the rows.
    rows = rows.select(F.struct("band", "key").alias("bucket"), "id", "n")
    sizes = pin(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket-sizes")
    members = pin(lookup(rows, sizes, "bucket", counts=sizes, weight="size"), "band-members")

    waiting = members.select("bucket", "id", "n")
    edges = tried = open_buckets = None
    for _ in range(STAR_ROUNDS):
        pairs, star = _star(waiting, threshold)
        pairs = pin(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "star-pairs")
        found = _verified(pairs, texts, threshold, k)
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = pin(found if edges is None else edges.unionByName(found), "star-edges")
        matched = edges.select(F.col("a").alias("root"), F.col("b").alias("id"))
        waiting = pin(star.join(matched, ["root", "id"], "left_anti").select("bucket", "id", "n"), "waiting")
        if open_buckets is None:
            # Where all match the root, nothing is left to ask. Of all other buckets every member takes part below.
            open_buckets = waiting.select("bucket").distinct()
            if waiting.isEmpty():
                return edges

    groups = connected_components(edges).withColumnRenamed("cluster", "comp")
    partners = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("best"))
    known = pin(groups.join(partners, "id", "left").select("id", "comp", F.coalesce("best", "id").alias("best")), "known")
    rows = members.join(open_buckets, "bucket", "left_semi").join(known, "id", "left")
    rows = pin(rows.select("bucket", "id", "n", "size", F.coalesce("comp", "id").alias("comp"), F.coalesce("best", "id").alias("best")), "open-members")

    size_fits = _size_fits("n", "n_1", threshold)
    pairs = _open_pairs(rows.filter(F.col("size") <= CROWD).drop("size"), "bucket", size_fits)
    chosen = pin(rows.filter(F.col("size") > CROWD).select("id", "comp", "best").distinct(), "crowd")
    if not chosen.isEmpty():
        rare = pin(_rare_shingle_rows(texts, chosen, threshold, k), "rare-shingles")
        left = F.least(F.col("n") - F.col("at"), F.col("n_1") - F.col("at_1"))
        enough = left >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_1")) - 1e-9
        pairs = pairs.unionByName(_open_pairs(rare, "shingle", size_fits & enough)).distinct()
    pairs = pin(pairs.join(tried, ["a", "b"], "left_anti"), "open-pairs")
    return edges.unionByName(_verified(pairs, texts, threshold, k))


def near_dup_links(df: DataFrame, id_col: str, text: str, threshold: float = 0.9, k: int = 5) -> DataFrame:
    """(id, partner, jaccard): for each row its smallest earlier id within the threshold.

    A link table rather than all pairs: its size is at most one row per document even when a
    third of the corpus is one group of copies.
    """
    edges = pin(near_dup_edges(df, id_col, text, threshold, k), "near-dup-edges")
    first = edges.groupBy(F.col("b").alias(id_col)).agg(F.min(F.struct("a", "jaccard")).alias("m"))
    first = first.select(id_col, F.col("m.a").alias("partner"), F.col("m.jaccard").alias("jaccard"))
    # Texts shorter than a shingle have an empty set and no Jaccard, hence no links.
    long_enough = df.filter(F.length(text) >= k)
    copies = copy_links(long_enough, id_col, text).filter(F.col(id_col) != F.col("rep"))
    of_rep = first.select(F.col(id_col).alias("rep"), "partner", "jaccard")
    copy_rows = copies.join(of_rep, "rep", "left").select(
        id_col,
        F.coalesce("partner", "rep").alias("partner"),
        F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"),
    )
    return first.unionByName(copy_rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, cluster): smallest id reachable over ``edges(a, b)``; only ids that have an edge.

    Minimum labels spread along edges, then jump to their label's label; each round is pinned.
    Hubs are spread by the salted lookup and minima are combined before the shuffle.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("nb")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("nb"))
    )
    both = pin(both, "cc-edges")
    degree = pin(both.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "cc-degree")
    labels = degree.select("id", F.col("id").alias("cluster"))
    for turn in itertools.count():
        heard = lookup(both, labels, "id", counts=degree).groupBy(F.col("nb").alias("id"))
        heard = heard.agg(F.min("cluster").alias("heard"))
        step = labels.join(heard, "id", "left").select(
            "id", "cluster", F.least("cluster", "heard").alias("next")
        )
        if turn >= 2:
            # Near copies settle in two rounds; longer chains also jump to their label's label.
            step = pin(step, "cc-step")
            targets = step.select(F.col("id").alias("next"), F.col("next").alias("jump"))
            jumped = F.least(F.coalesce("jump", "next"), "next")
            step = lookup(step, targets, "next", how="left").select("id", "cluster", jumped.alias("next"))
        step = pin(step, "cc-round")
        labels = step.select("id", F.col("next").alias("cluster"))
        if step.filter("next < cluster").isEmpty():
            return labels


def near_dup_dedup(
    df: DataFrame, id_col: str, text: str, threshold: float = 0.9, k: int = 5, order: tuple[str, ...] | None = None
) -> DataFrame:
    """The earliest row of every near-dup cluster by ``order`` (default: the id); exact copies collapse first."""
    order = tuple(c for c in order or () if c != id_col)
    distinct = pin(exact_dedup(df, text, (*order, id_col)), "distinct-rows", compression="zstd")
    texts = distinct.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    clusters = connected_components(_edges(texts, threshold, k))
    if not order:
        losers = clusters.filter("id != cluster").select(F.col("id").alias(id_col))
    else:
        clusters = pin(clusters.select(F.col("id").alias(id_col), "cluster"), "clusters")
        keys = distinct.select(id_col, F.struct(*order, id_col).alias("_key")).join(clusters, id_col)
        first = keys.groupBy("cluster").agg(F.min("_key").alias("_key"))
        losers = clusters.join(first.select(F.col(f"_key.{id_col}").alias(id_col)), id_col, "left_anti").select(id_col)
    return distinct.join(losers, id_col, "left_anti")
