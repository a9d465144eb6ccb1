"""Near-duplicate documents by circulant MinHash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import GOLDEN, WORD_PATTERN, Rolling, WordHashes, id_filter, int64, lists, mix, utf8
from textloom.operators.dedup import connected_components
from textloom.operators.skew import lookup
from textloom.session import pin

# Positions that the two permutations permute.
POSITIONS = 1 << 22
MAX_COORDINATES = 192
PARITY_WORDS = 3
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]


def band_layout(percent: int, miss: float = 1e-6, coordinates: int = MAX_COORDINATES) -> tuple[int, int]:
    """(bands, rows per band): the longest bands that miss a pair at the threshold with chance ``miss`` at most."""
    best = None
    for rows in range(1, 20):
        hit = (percent / 100) ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if bands * rows <= coordinates:
            best = bands, rows
    if best is None:
        raise ValueError(f"no band layout of {coordinates} coordinates finds pairs at {percent} %")
    return best


@lru_cache(maxsize=2)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations; the second as a table whose row i holds all its circular shifts at i."""
    place = np.arange(POSITIONS, dtype=np.uint64)
    first = np.argsort(mix(place + GOLDEN)).astype(np.int32)
    second = np.argsort(mix(~place + GOLDEN)).astype(np.int32)
    ring = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate j: the smallest value of the second permutation, shifted by j, at the set's places under the first."""
    first, shifted = permutations(coordinates)
    places = first[(shingles & np.uint64(POSITIONS - 1)).astype(np.int64)]
    low = np.full(coordinates, POSITIONS, np.int32)
    for start in range(0, len(places), 2048):
        np.minimum(low, shifted[places[start : start + 2048]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    for column in low[: bands * rows].reshape(bands, rows).T:
        key = mix(key + column.astype(np.uint64))
    return key


def parity_bits(low: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate, in three 64-bit numbers."""
    bits = np.zeros(64 * PARITY_WORDS, np.uint8)
    bits[: len(low)] = low & 1
    return np.packbits(bits).view(np.int64)


def most_differing(percent: int, coordinates: int) -> int:
    """Parity bits in which sets at the threshold differ at most, but for a chance below one in a million.

    A bit differs with chance (1 - similarity) / 2; circulant coordinates vary less than independent ones.
    """
    p = (1 - percent / 100) / 2
    return math.ceil(coordinates * p + 5.5 * math.sqrt(coordinates * p * (1 - p)))


def shingle_hashes(words: list[bytes], k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs; of the whole sequence if it is shorter."""
    return np.unique(Rolling(cache.of(words)).runs(min(k, len(words)))) if words else np.empty(0, np.uint64)


def shingle_set(text: bytes, k: int) -> set:
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, p0 .. p2, bands): set size, digest of the whole set, parity bits, one key per band. No shuffle."""
    bands, rows = band_layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sizes, digests, keys, bits = [], [], [], []
            for text in utf8(batch.column("text")):
                hashes = shingle_hashes((text or b"").lower().split(), k, cache)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes, digest_size=16).digest())
                low = signature(hashes, bands * rows)
                bits.append(parity_bits(low))
                keys.append(int64(band_keys(low, bands, rows)) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
                + [pa.array([b[i] for b in bits], pa.int64()) for i in range(PARITY_WORDS)]
                + [lists(keys, pa.int64())],
                ["doc_id", "n", "digest", *PARITY, "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, p0 long, p1 long, p2 long, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pinned ``pairs(a, b)`` whose whole shingle sets reach the threshold.

    Only texts of ids in the pairs move. ``a`` is often the hub of many pairs, hence the salted lookup.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # Versions without words are linked with nothing.
    texts = docs.filter(id_filter(asked)).filter(F.col("text").rlike(WORD_PATTERN))
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = lookup(with_b, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a", counts=counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, set()
        for batch in batches:
            same = []
            for a, b in zip(utf8(batch.column("text_a")), utf8(batch.column("text_b"))):
                if a != hub:
                    hub, of_hub = a, shingle_set(a, k)
                other = shingle_set(b, k)
                common = len(of_hub & other)
                same.append(100 * common >= percent * (len(of_hub) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(run, "a long, b long").distinct()


# Buckets of more sets than this are searched by their rarest shingles instead of set by set.
CROWD = 8


def possible(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pinned ``pairs(a, b)`` whose sizes and parity bits may belong to sets at the threshold."""
    bands, per_band = band_layout(percent)
    far = most_differing(percent, bands * per_band)
    of = lambda side: about.select(*[F.col(c).alias(c if c == "id" else f"{c}_{side}") for c in ("id", "n", *PARITY)]).withColumnRenamed("id", side)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = lookup(pairs.join(of("b"), "b"), of("a"), "a", counts=counts)
    apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY), F.lit(0))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.filter(fits & (apart <= far)).select("a", "b")


def shingle_rows(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(id, comp, n, shingles): the whole hashed set of each of ``chosen(id, comp, digest)``."""
    ids = chosen.select(F.col("id").alias("doc_id"))
    texts = docs.filter(id_filter(ids)).join(chosen.withColumnRenamed("id", "doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets, mine = [], []
            for text, digest in zip(utf8(batch.column("text")), batch.column("digest").to_pylist()):
                hashes = shingle_hashes((text or b"").lower().split(), k, cache)
                # Another version of the document stands for another set.
                mine.append(hashlib.blake2b(hashes, digest_size=16).digest() == digest)
                if mine[-1]:
                    sets.append(int64(hashes))
            some = batch.select(["doc_id", "comp"]).filter(pa.array(mine, pa.bool_()))
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*some.columns, sizes, lists(sets, pa.int64())], ["id", "comp", "n", "shingles"])

    rows = texts.select("doc_id", "comp", "digest", "text").mapInArrow(run, "id long, comp long, n long, shingles array<long>")
    return rows.dropDuplicates(["id"])


def rare_shingle_pairs(docs: DataFrame, chosen: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``chosen(id, comp, digest)`` with different comp: all that reach the threshold, and few others.

    Shingles are ordered by the number of chosen sets that hold them, rarest first. Sets that reach the
    threshold share one of the first ``n - ceil(percent * n / 100) + 1``; at the first one they share, the
    rest of both must be long enough. So texts around one common body, each with enough words of its own, make no pair.
    Under a shingle only the sets outside its largest group meet the others.
    """
    sets = pin(shingle_rows(docs, chosen, k), "open-sets", compression="zstd")
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    held = pin(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-shingles")
    shared = lookup(each, held, "shingle", counts=held, weight="size").groupBy("id")
    shared = shared.agg(F.array_sort(F.collect_list(F.struct("size", "shingle"))).alias("shared"))
    # What one set alone holds comes first.
    prefix = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    rows = sets.select("id", "comp", "n").join(shared, "id").withColumn("own", F.col("n") - F.size("shared")).filter(prefix > F.col("own"))
    rows = rows.select("id", "comp", "n", "own", F.posexplode(F.expr("slice(shared, 1, int(n - (%d * n + 99) div 100 + 1 - own))" % percent)).alias("at", "s"))
    rows = pin(rows.select("id", "comp", "n", (F.col("own") + F.col("at")).alias("at"), F.col("s.shingle").alias("shingle")), "rare-shingles")
    rows, counts = outside_main(rows, "shingle")
    one = rows.filter("comp != main").select("shingle", *[F.col(c).alias(f"{c}_1") for c in ("id", "comp", "n", "at")])
    left = F.least(F.col("n") - F.col("at"), F.col("n_1") - F.col("at_1"))
    reach = (100 + percent) * left >= percent * (F.col("n") + F.col("n_1"))
    pairs = rows.join(one, "shingle").filter((F.col("comp") != F.col("comp_1")) & reach)
    return pairs.select(F.least("id", "id_1").alias("a"), F.greatest("id", "id_1").alias("b")).distinct()


def outside_main(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pinned ``rows(key, comp)`` of keys that hold two groups or more, with the largest one as ``main``; the keys and their sizes."""
    parts = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy(key).agg(F.max_by("comp", F.struct("size", -F.col("comp"))).alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"))
    main = pin(main.filter("parts > 1").drop("parts"), "main-groups")
    return lookup(rows, main, key, counts=main, weight="size"), main


def links(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, groups): verified links (a, b) that join every group, and (id, cluster) of the linked ids.

    ``sets(doc_id, digest, n, p0 .. p2, bands)`` has one row per different set. In a band's bucket the smallest
    id meets all others first; whom it links is in one group and needs no further comparison inside it.
    Where the others still are of two groups or more, those outside the largest group meet the members of other
    groups: one by one in buckets of CROWD sets at most, and by ``rare_shingle_pairs`` over the sets of all larger
    buckets at once. So no pair of different groups in a bucket is lost, and a bucket of m near copies,
    or of m texts around one body, costs a few times m.
    Pairs whose sizes or parity bits are too far apart for the threshold are not verified.
    """
    about = sets.select(F.col("doc_id").alias("id"), "n", *PARITY)
    rows = sets.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).filter("size > 1")
    sizes = pin(sizes, "buckets")
    members = pin(lookup(rows, sizes, "bucket", counts=sizes, weight="size").filter("id != hub"), "bucket-members")
    star = pin(members.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "hub-pairs")
    found = pin(verified(pin(possible(star, about, percent), "pairs"), docs, k, percent), "links")
    groups = pin(connected_components(found), "groups")

    named = members.filter("size > 2").join(groups, "id", "left").select("bucket", "id", "size", F.coalesce("cluster", "id").alias("comp"))
    named = pin(named.withColumnRenamed("size", "all"), "named-members")
    crowded, _ = outside_main(named, "bucket")
    crowded = pin(crowded, "open-members")
    few = crowded.filter(F.col("all") <= CROWD)
    others = few.filter("comp != main").select("bucket", F.col("id").alias("other"), F.col("comp").alias("other_comp"))
    pairs = few.join(others, "bucket").filter("comp != other_comp")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    chosen = crowded.filter(F.col("all") > CROWD).select("id", "comp").distinct()
    chosen = pin(chosen.join(sets.select(F.col("doc_id").alias("id"), "digest"), "id"), "open-ids")
    if not chosen.isEmpty():
        pairs = pairs.unionByName(rare_shingle_pairs(docs, chosen, k, percent))
    pairs = pin(pairs.distinct(), "other-pairs")
    new = pin(verified(pin(possible(pairs, about, percent), "pairs"), docs, k, percent), "links")
    if new.isEmpty():
        return found, groups
    found = pin(found.unionByName(new), "links")
    return found, pin(connected_components(found), "groups")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document of ``docs(doc_id, text)``: n_shingles, component_id, kept, class_id.

    Words are cut at space and U+0009 to U+000D after lower-casing A-Z; the set of a document is its
    distinct k-word shingles, or the whole sequence if it is shorter. Two documents are linked if
    100 * intersection >= percent * union of their whole sets. ``component_id`` is the smallest
    doc_id that links lead to, ``class_id`` the smallest doc_id with the same set.

    Null and empty texts have an empty set and are linked with nothing. Rows that share a doc_id are
    versions of one document: each keeps its row, and each one's links count for the id. A null
    doc_id is linked with nothing, gets a null component and is kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = pin(sketches(docs, k, percent), "sketches")
    used = sk.filter("n > 0 AND doc_id IS NOT NULL")
    classes = used.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n"), *[F.any_value(c).alias(c) for c in (*PARITY, "bands")]
    )
    classes = pin(classes, "set-classes")
    one_each = classes.select(F.col("rep").alias("doc_id"), "digest", "n", *PARITY, "bands")
    # Versions of one document: their ids are links of their own.
    edges, groups = links(docs, one_each, k, percent)
    repeated = used.groupBy("doc_id").agg(F.count(F.lit(1)).alias("v")).filter("v > 1")
    versions = used.select("doc_id", "digest").join(repeated, "doc_id").join(classes.select("digest", "rep"), "digest").filter("doc_id != rep")
    versions = pin(versions.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "versions")
    if not versions.isEmpty():
        groups = connected_components(edges.unionByName(versions))
    named = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", "rep", F.coalesce("cluster", "rep").alias("component_id"), "size"
    )
    named = pin(named.filter("size > 1 OR component_id != rep"), "components")
    rows = sk.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    found = lookup(rows, named.select("digest", "rep", "component_id"), "digest", counts=named, weight="size", how="left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.least(F.coalesce("component_id", "doc_id"), "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(known, F.coalesce("rep", "doc_id")).alias("class_id"),
    )
