"""Remove long passages that stand in an earlier document too: relative Lempel-Ziv parsing against reference blocks.

Blocks chosen by content are indexed over all documents; the smallest document that holds a block is its
reference. Every text is factored greedily against the references of its blocks; long factors are repeated
spans, and the windows that lie in no single factor are checked by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Rolling, WordHashes, int64, lists, mix, utf8
from textloom.operators.skew import lookup
from textloom.session import pin

WINDOW = 50
NOTHING = hashlib.sha256(b"").hexdigest()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def anchors(rolling: Rolling, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the reference blocks of a text: runs of window / 2 words.

    Chosen by content: of the blocks inside each window the one of smallest hash. So equal windows
    of any two texts hold an equal block at the same place, and about one position in 13 is chosen.
    """
    block = window // 2
    hashes = rolling.runs(block)
    inside = window - block + 1
    if len(hashes) < inside:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = sliding_min(hashes, inside)
    padded = np.concatenate([np.zeros(inside - 1, np.uint64), low, np.zeros(inside - 1, np.uint64)])
    highest = ~sliding_min(~padded, inside)
    chosen = np.flatnonzero(highest == hashes)
    return chosen, hashes[chosen]


def scanned(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n, digest, anchors): word count, SHA-256 of the words, distinct block hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sizes, digests, blocks = [], [], []
            for text in utf8(batch.column("text")):
                words = (text or b"").split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                blocks.append(int64(np.unique(anchors(Rolling(cache.of(words)), window)[1])) if len(words) >= window else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(blocks, pa.int64())],
                ["doc_id", "n", "digest", "anchors"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, anchors array<long>")


HEAD = 4


def reference_blocks(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, block): each of the anchors that ``texts(text, digest, own)`` is the reference of, with the words around it.

    ``block`` holds 64-bit numbers: the text (start of its digest), the anchor's place, a second hash of the
    anchor, the number of words on its right, then the word hashes of window / 2 places on its left and right.
    So all windows around the anchor lie inside. A row whose text has another digest is passed over.
    """
    block = window // 2
    side = window - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i, (text, digest) in enumerate(zip(utf8(batch.column("text")), batch.column("digest").to_pylist())):
                words = (text or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() != digest:
                    continue
                hashes = cache.of(words)
                places, found = anchors(Rolling(hashes), window)
                own = batch.column("own")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found, at = np.unique(found, return_index=True)
                mine = np.isin(found, own)
                found, places = found[mine], places[at[mine]]
                padded = np.concatenate([np.zeros(side, np.uint64), hashes, np.zeros(side, np.uint64)])
                around = np.arange(side)
                rows = np.empty((len(found), HEAD + 2 * side), np.uint64)
                rows[:, 0] = np.frombuffer(digest[:8], np.uint64)[0]
                rows[:, 1] = places
                rows[:, 2] = Rolling(mix(hashes)).runs(block)[places]
                rows[:, 3] = np.minimum(side, len(words) - block - places)
                # Left of the anchor from near to far, so that both sides are read outwards.
                rows[:, HEAD : HEAD + side] = padded[places[:, None] + side - 1 - around]
                rows[:, HEAD + side :] = padded[places[:, None] + side + block + around]
                yield pa.RecordBatch.from_arrays([pa.array(int64(found)), pa.array([r.tobytes() for r in rows], pa.binary())], ["anchor", "block"])

    return texts.select("text", "digest", "own").mapInArrow(run, "anchor long, block binary")


def matches(hashes: np.ndarray, places: np.ndarray, blocks: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of a text that stand in one reference: the blocks at ``places``, extended
    word by word to both sides, and joined where they continue each other in the same reference."""
    block = window // 2
    side = window - block
    same = Rolling(mix(hashes)).runs(block)[places] == blocks[:, 2]
    places, blocks = places[same], blocks[same]
    if not len(places):
        return []
    padded = np.concatenate([np.zeros(side, np.uint64), hashes, np.zeros(side, np.uint64)])
    around = np.arange(side)
    source, at = blocks[:, 0], blocks[:, 1].view(np.int64)
    left = (padded[places[:, None] + side - 1 - around] == blocks[:, HEAD : HEAD + side]) & (around < np.minimum(places, at)[:, None])
    room = np.minimum(len(hashes) - block - places, blocks[:, 3].view(np.int64))
    right = (padded[places[:, None] + side + block + around] == blocks[:, HEAD + side :]) & (around < room[:, None])
    begin = places - np.logical_and.accumulate(left, axis=1).sum(axis=1)
    end = places + block + np.logical_and.accumulate(right, axis=1).sum(axis=1)
    order = np.lexsort((begin, at - places, source))
    runs: list[tuple[int, int]] = []
    last = None
    for i in order:
        line = (source[i], at[i] - places[i])
        if line == last and begin[i] <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], int(end[i])))
        else:
            runs.append((int(begin[i]), int(end[i])))
        last = line
    return runs


def factors(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The greedy factors of a text: from each place the run that reaches furthest, then on from its end.

    A factor is given with all of its run, also what lies before the place it was taken at.
    """
    taken: list[tuple[int, int]] = []
    at, best = -1, None
    for run in sorted(runs):
        if best and run[0] > at:
            # The place ``at`` is reached: the run that covers it and goes furthest becomes a factor.
            taken.append(best)
            at, best = best[1], None
        if run[1] > at and (best is None or run[1] > best[1]):
            if best is None and run[0] > at:
                at = run[0]
            best = run
    return taken + [best] if best else taken


def parsed(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, unit, start, stop, key, check): long factors of each text, and the windows to be checked.

    ``texts(doc_id, text, digest, shared)`` with ``shared`` a list of (anchor, block), block null where the text is
    the reference itself. Factors of ``window`` words or more have no key. Windows around shared blocks that lie
    inside no such factor (at factor boundaries, in references, where a later text than the reference is
    repeated) carry 128 bits of hash. A row whose text has another digest is passed over.
    """
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i, (text, digest) in enumerate(zip(utf8(batch.column("text")), batch.column("digest").to_pylist())):
                words = (text or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() != digest:
                    continue
                hashes = cache.of(words)
                rolling = Rolling(hashes)
                shared = batch.column("shared")[i].values
                known = shared.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
                order = np.argsort(known)
                known = known[order]
                places, found = anchors(rolling, window)
                row = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[row] == found
                places, row = places[hit], order[row[hit]]
                data = shared.field("block")
                referred = data.is_valid().to_numpy(zero_copy_only=False)
                width = HEAD + 2 * (window - block)
                table = np.frombuffer(b"".join(data.drop_null().to_pylist()), np.uint64).reshape(-1, width)
                number = np.cumsum(referred) - 1
                there = referred[row]
                long = [f for f in factors(matches(hashes, places[there], table[number[row[there]]], window)) if f[1] - f[0] >= window]

                starts = len(words) - window + 1
                edges = np.zeros(starts + window, np.int64)
                np.add.at(edges, np.maximum(places - (window - block), 0), 1)
                np.add.at(edges, places + 1, -1)
                around = np.cumsum(edges)[:starts] > 0
                for begin, end in long:
                    around[begin : end - window + 1] = False
                at = np.flatnonzero(around)
                # A second hash of the same run, from word hashes mixed anew.
                second = Rolling(mix(hashes)).runs(window)[at]
                n, m = len(at), len(long)
                spans = np.array(long, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(batch.column("doc_id")[i].as_py(), pa.int64()), n + m),
                        pa.repeat(pa.scalar(digest[:8], pa.binary()), n + m),
                        pa.array(np.concatenate([at.astype(np.int32), spans[:, 0]])),
                        pa.array(np.concatenate([at.astype(np.int32) + np.int32(window), spans[:, 1]])),
                        pa.concat_arrays([pa.array(int64(rolling.runs(window)[at])), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(int64(second)), pa.nulls(m, pa.int64())]),
                    ],
                    ["doc_id", "unit", "start", "stop", "key", "check"],
                )

    schema = "doc_id long, unit binary, start int, stop int, key long, check long"
    return texts.select("doc_id", "text", "digest", "shared").mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spans`` (begin, end) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def cut_texts(texts: DataFrame) -> DataFrame:
    """(digest, n_removed, kept_sha256, kept_text) of ``texts(text, digest, spans)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (text, digest) in enumerate(zip(utf8(batch.column("text")), batch.column("digest").to_pylist())):
                words = (text or b"").split()
                if hashlib.sha256(b" ".join(words)).digest() != digest:
                    continue
                kept, at = [], 0
                spans = batch.column("spans")[i].values
                for begin, end in merged(list(zip(spans.field("start").to_pylist(), spans.field("stop").to_pylist()))):
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((digest, len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                ["digest", "n_removed", "kept_sha256", "kept_text"],
            )

    schema = "digest binary, n_removed long, kept_sha256 string, kept_text string"
    return texts.select("text", "digest", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per document of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes if a window of ``window`` words around it also starts in a document of smaller
    doc_id. Words are cut at space and U+0009 to U+000D.

    Plan: (1) equal texts fold into their smallest doc_id; the others are covered whole. (2) Every
    text is cut into blocks by content; blocks of two documents at least form the index, with the words
    around them in their smallest doc_id, the reference. (3) Every text is factored greedily against the references
    of its blocks; factors of ``window`` words or more are repeated spans. (4) Windows around indexed blocks
    that lie in no such factor are compared by 128 bits of hash, for their smallest doc_id. The smallest
    doc_id of a window never has it inside a factor, so none is lost. (5) Spans are merged and cut out.
    No pairs of documents arise anywhere: a block in m documents costs m rows.

    Very long texts are read whole. Null and short texts keep all words. Rows with a null doc_id keep all words and are no reference.
    Rows that share a doc_id do not remove each other's words. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = pin(scanned(docs, window), "blocks")
    units = sk.filter((F.col("n") >= window) & F.col("doc_id").isNotNull()).groupBy("digest")
    units = units.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("anchors").alias("anchors"))
    units = pin(units, "texts-once")

    blocks = units.select("rep", "digest", F.explode("anchors").alias("anchor"))
    holder = F.struct("rep", "digest")
    seen = blocks.groupBy("anchor").agg(F.min(holder).alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("n"))
    index = pin(seen.filter("low.rep < high").select("anchor", "low.rep", "low.digest", "n"), "block-index")
    owners = index.groupBy("rep", "digest").agg(F.collect_list("anchor").alias("own"))
    rows = docs.join(owners, docs["doc_id"] == owners["rep"]).select("text", "digest", "own")
    # A document can have equal rows: one block an anchor.
    around = reference_blocks(rows, window).groupBy("anchor").agg(F.any_value("block").alias("block"))
    references = pin(index.select("anchor", F.col("rep").alias("low")).join(around, "anchor"), "reference-blocks")

    shared = lookup(blocks, references, "anchor", counts=index)
    shared = shared.select("rep", "digest", F.struct("anchor", F.when(F.col("low") < F.col("rep"), F.col("block")).alias("block")).alias("s"))
    shared = shared.groupBy("rep", "digest").agg(F.collect_list("s").alias("shared"))
    rows = docs.join(shared, docs["doc_id"] == shared["rep"]).select("doc_id", "text", "digest", "shared")
    found = pin(parsed(rows, window), "factors")
    checked = found.filter("key IS NOT NULL")
    first = checked.groupBy("key", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    first = pin(first.filter("low < high").select(F.struct("key", "check").alias("id"), "low", "n"), "window-index")
    placed = checked.select(F.struct("key", "check").alias("id"), "doc_id", "unit", "start", "stop")
    covered = lookup(placed, first.select("id", "low"), "id", counts=first).filter("doc_id > low")
    covered = covered.select("doc_id", "unit", "start", "stop").unionByName(found.filter("key IS NULL").select("doc_id", "unit", "start", "stop"))
    covered = covered.groupBy("doc_id", "unit").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    # The full digest again: a doc_id can have several versions.
    named = units.select(F.col("rep").alias("doc_id"), F.substring("digest", 1, 8).alias("unit"), "digest")
    covered = named.join(covered, ["doc_id", "unit"])
    parts = cut_texts(docs.join(covered, "doc_id"))
    keep = ["n_removed", "kept_sha256"] + ["kept_text"] * texts
    parts = parts.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in keep])
    known = units.select("digest", "rep", "size").join(parts, "digest", "left").filter("size > 1 OR n_removed IS NOT NULL")
    known = pin(known, "cut-texts")

    out = lookup(sk.select("doc_id", "n", "digest"), known.drop("size"), "digest", counts=known, weight="size", how="left")
    copy = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
    own = F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(False))
    removed = F.when(copy, F.col("n")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long")
    kept = F.when(copy, F.lit(NOTHING)).when(own & F.col("n_removed").isNotNull(), F.col("kept_sha256"))
    columns = ["doc_id", F.col("n").alias("n_words"), removed.alias("n_removed"), F.coalesce(kept, F.lower(F.hex("digest"))).alias("kept_sha256")]
    if texts:
        text = F.when(copy, F.lit("")).when(own, F.col("kept_text"))
        columns.append(text.alias("kept_text"))
    return out.select(*columns)
