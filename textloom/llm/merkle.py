"""Merkle manifest of a data set, stored every few levels; missing nodes are computed again for a proof."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordering import row_index
from textloom.operators.skew import lookup
from textloom.session import pin

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ARITY = 8
# Levels from one stored level to the next; a subtree between them has ARITY ** STORED_EVERY nodes at most.
STORED_EVERY = 3
BLOCK = ARITY**STORED_EVERY


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Manifest(NamedTuple):
    """``leaves(tree, i, n, hash, ...)`` and the stored levels of all trees above them: ``levels[j](tree, i, n, hash)``.

    ``i`` numbers the nodes of a level of a tree from 0, ``n`` counts them. The last level holds one node per tree.
    """

    leaves: DataFrame
    levels: list[DataFrame]


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes counted, a colon, the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def runs_above(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of an aligned subtree: its ``nodes``, and as many levels above as it holds alone, up to STORED_EVERY.

    ``n`` nodes in the whole tree on this level.
    """
    levels = [nodes]
    while n > 1 and len(levels) <= STORED_EVERY:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
        n = -(-n // ARITY)
    return levels


def subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, block, n, members): the aligned subtrees of a stored level, each of BLOCK nodes at most."""
    member = F.struct("i", "hash", *more)
    return nodes.groupBy("tree", F.floor(F.col("i") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(member)).alias("members"))


def next_level(nodes: DataFrame) -> DataFrame:
    """The next stored level; a tree that has one node left keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, counts = [], []
            for n, hashes in zip(batch.column("n").to_pylist(), batch.column("hashes").to_pylist()):
                tops.append(runs_above(hashes, n)[-1][0])
                for _ in range(STORED_EVERY):
                    n = -(-n // ARITY)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(counts, pa.int64()), pa.array(tops)], ["tree", "i", "n", "hash"])

    blocks = subtrees(nodes).select("tree", "block", "n", F.transform("members", lambda m: m["hash"]).alias("hashes"))
    return blocks.mapInArrow(run, "tree string, i long, n long, hash string")


def grown(leaves: DataFrame) -> Manifest:
    """The manifest over ``leaves(tree, i, n, hash, ...)``; every stored level is written."""
    levels = [leaves.select("tree", "i", "n", "hash")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(pin(next_level(levels[-1]), "merkle-level"))
    return Manifest(leaves, levels)


PATH = "array<struct<left:string,right:string>>"


def down(nodes: DataFrame, paths: DataFrame, more: list[str], emit: Callable, schema: str) -> DataFrame:
    """One stored level down: each aligned subtree meets the path of its top node, and ``emit`` gets every member's whole path.

    ``paths(tree, i, path)`` lead from the stored level above to the root. The nodes between the two levels are computed
    again from the members, their hashes go into the siblings, and they are forgotten with the subtree.
    """
    blocks = subtrees(nodes, *more).join(paths.withColumnRenamed("i", "block"), ["tree", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            tree, n, members, above = (batch.column(c)[0].as_py() for c in ("tree", "n", "members", "path"))
            above = [(step["left"], step["right"]) for step in above]
            levels = runs_above([m["hash"] for m in members], n)
            rows = []
            for at, member in enumerate(members):
                own = []
                for level in levels[:-1]:
                    first = at - at % ARITY
                    own.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
                    at //= ARITY
                rows.append(emit(tree, member, own, above))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = ARROW[schema]
    return blocks.select("tree", "n", "members", "path").mapInArrow(run, schema)


NODE_PATHS = f"tree string, i long, path {PATH}"
PROOFS = "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
ARROW = {
    NODE_PATHS: pa.schema([("tree", pa.string()), ("i", pa.int64()), ("path", pa.list_(STEP))]),
    PROOFS: pa.schema([("tree", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]),
}


def node_path(tree: str, member: dict, own: list, above: list) -> dict:
    return {"tree": tree, "i": member["i"], "path": [{"left": a, "right": b} for a, b in own + above]}


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node leads to by its siblings."""
    for left, right in path:
        node = sha(left + node + right)
    return node


def proof(tree: str, member: dict, own: list, above: list) -> dict:
    path = own + above
    siblings = sha("".join(side for step in path for side in step))
    node = member["altered"] if member["altered"] is not None else member["hash"]
    return {"tree": tree, "doc_id": member["doc_id"], "leaf": member["hash"], "proof_sha256": siblings, "folded_root": folded(node, path)}


def paths(manifest: Manifest, tops: DataFrame, more: list[str], emit: Callable, schema: str) -> DataFrame:
    """``emit`` of every leaf, level by level from the roots down. ``tops(tree, i, path)``: where each tree's own root leads."""
    for level in reversed(manifest.levels[1:-1]):
        tops = pin(down(level, tops, [], node_path, NODE_PATHS), "merkle-paths")
    return down(manifest.leaves, tops, more, emit, schema)


def tree_key(lang: Column) -> Column:
    """Sorts as null first, then by the bytes of the name."""
    return F.coalesce(F.concat(F.lit("."), lang), F.lit(""))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, i, n, doc_id, hash, altered): the leaves of each language in order of doc_id (null first), then of their hash.

    ``altered`` is the leaf of the lower-cased text where 3 divides the CRC-32 of the decimal doc_id, else null.
    """
    text = F.col("text")
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    rows = rows.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf_hash(text).alias("hash"), F.when(chosen, leaf_hash(small)).alias("altered"))
    rows = row_index(pin(rows, "leaf-hashes", compression="zstd"), "tree", "doc_id", "hash", "altered", name="row")
    trees = pin(rows.groupBy("tree").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    placed = lookup(rows, trees, "tree", counts=trees)
    return placed.select("tree", (F.col("row") - F.col("first")).alias("i"), "n", "doc_id", "hash", "altered")


def checked(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    One tree of arity 8 per language, leaves in order of doc_id; the trees' roots are the leaves of a last tree. Only every
    third level is stored. ``proof_sha256`` covers the siblings from the leaf up, ``folded_root`` is where the leaf, altered
    or not, leads with them, ``verified`` whether that is the root.

    Null fields are written ``-``, empty texts ``0:``. A null language is a tree of its own and comes first. Rows with a
    null doc_id come first in their tree and are never altered; rows that share a doc_id are leaves of their own, ordered by
    hash. Without rows there is no root and no row. Further columns take no part.
    """
    manifest = grown(pin(leaves_of(docs), "leaves", compression="zstd"))
    subroots = manifest.levels[-1].select(F.col("tree").alias("own"), "hash")
    ranked = row_index(subroots, "own", name="row").withColumn("i", F.col("row") - 1)
    total = ranked.agg(F.count(F.lit(1))).scalar()
    top = grown(pin(ranked.select(F.lit("").alias("tree"), "i", total.alias("n"), "hash", "own"), "subroots"))
    root = top.levels[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("i"), F.expr(f"cast(array() as {PATH})").alias("path"))
    named = lambda tree, member, own, above: {"tree": member["own"], "i": 0, "path": [{"left": a, "right": b} for a, b in own + above]}
    tops = pin(paths(top, root, ["own"], named, NODE_PATHS), "merkle-paths")
    rows = paths(manifest, tops, ["doc_id", "altered"], proof, PROOFS)
    roots = pin(subroots.select(F.col("own").alias("tree"), F.col("hash").alias("subroot"), top.levels[-1].select("hash").scalar().alias("root")), "roots")
    counts = manifest.levels[0].groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return lookup(rows, roots, "tree", counts=counts).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
