"""Pack tokenized documents into fixed windows: concatenate and cut."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import pin

WINDOW = 1024
END_ID = 0
# Pieces whose ids a worker remembers: up to twice as many, the older half goes first.
CACHED_PIECES = 500_000
# Texts that are encoded together.
TEXTS = 500
# Pieces that are empty, or may begin or end with white space of any kind: their texts are encoded whole.
SPACE = r"[\x{0}-\x{20}\x{7F}-\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]"
ODD = rf"^$|^{SPACE}|{SPACE}$"


# The published pre-tokenizer pattern of this kind of byte-level BPE.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point all libraries agree on what a letter is.
LATIN_END = "\u0250"


def fast_encoder(path: str):
    """The same vocabulary in a library that encodes short pieces faster; None unless it is of that very kind.

    Requires that merges rank in the order of the ids they make, and the plain byte-level pre-tokenizer.
    """
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or model.get("type") != "BPE":
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    # The byte alphabet of such files: printable bytes as themselves, the others from U+0100 on in turn.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("pieces", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class PieceIds:
    """Ids, as little-endian bytes, of texts by way of their pieces between single spaces.

    A byte-level BPE never merges across a single space between other characters: its pre-tokenizer
    starts a new piece there. So the ids of a text are those of its first piece and of every further
    piece with the space in front. Arrow cuts the texts and numbers the different pieces of a batch; each is encoded
    once, frequent ones once per worker, and the ids are laid out by piece number. Texts in which white space stands
    beside a space or at an end, or that hold the string of a special token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = fast_encoder(path)
        added = [t["content"] for t in json.loads(open(path, encoding="utf-8").read()).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # Pieces with their space in front, and first pieces without one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, keys: list[str]) -> list[bytes]:
        """The ids of different pieces; what is new is learned."""
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = {}, self.known
        known = self.known
        out = list(map(known.get, keys))
        at = [i for i, x in enumerate(out) if x is None]
        if self.older:
            for i in at:
                out[i] = self.older.get(keys[i])
            at, found = [i for i in at if out[i] is None], at
            known.update((keys[i], out[i]) for i in found if out[i] is not None)
        rest = []
        encode = self.fast.encode_ordinary if self.fast is not None else None
        for i in at:
            key = keys[i]
            if encode is not None and (key.isascii() or max(key) < LATIN_END):
                known[key] = out[i] = array("I", encode(key)).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, self.encoded([keys[i] for i in rest])):
            known[keys[i]] = out[i] = ids
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(column, " ")
        ends = cut.offsets.to_numpy()
        distinct = cut.flatten().dictionary_encode()
        codes = distinct.indices.to_numpy().astype(np.int64)
        odd = pc.match_substring_regex(distinct.dictionary, ODD).to_numpy(zero_copy_only=False)
        pieces = distinct.dictionary.to_pylist()
        whole = np.logical_or.reduceat(odd[codes], ends[:-1])
        if self.added is not None:
            whole |= np.fromiter((self.added.search(t) is not None for t in texts), bool, len(texts))
        # First pieces get numbers of their own. Texts that are encoded whole need no piece.
        first, place = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] = len(pieces) + place
        used = np.zeros(len(pieces) + len(first), bool)
        used[codes[np.repeat(~whole, np.diff(ends))]] = True
        keys = [" " + p for p in pieces] + [pieces[i] for i in first]
        ids = self.ids_of(list(compress(keys, used)))
        sizes = np.zeros(len(keys), np.int64)
        sizes[used] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        before = np.cumsum(n) - n
        laid = flat[np.repeat(starts[codes] - before, n) + np.arange(n.sum())]
        bounds = np.append(before, n.sum())[ends]
        out = [laid[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i, e in zip(np.flatnonzero(whole), self.encoded([texts[i] for i in np.flatnonzero(whole)])):
            out[i] = e
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceIds:
    """One per worker process: what it has learned serves all its tasks."""
    return PieceIds(path)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """First pass, pinned: (doc_id, part, before, doc_tokens, ids) in scan order.

    ``before`` counts the tokens of the same partition in front of the document; ``ids`` holds
    unsigned 32-bit little-endian numbers. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_of(tokenizer), 0
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                ids = [x + end for x in encoder.of([t or "" for t in some.column("text").to_pylist()])]
                sizes = [len(x) // 4 for x in ids]
                begins = np.cumsum([before, *sizes])
                before = int(begins[-1])
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(begins[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "before", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pin(rows.mapInArrow(run, "doc_id long, part int, before long, doc_tokens long, ids binary"), "token-ids", compression="zstd")


def pieces(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass: global offsets from the partition totals, then one row per document and window.

    The offsets table has one row per scan partition, so it is small at any input size; it is the
    only table that is broadcast. Token ids never move.
    """
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("before")).alias("at"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 50):
                some = batch.slice(start, 50).to_pydict()
                rows = []
                for doc_id, n, at, ids in zip(*(some[c] for c in ("doc_id", "doc_tokens", "at", "ids"))):
                    begin = 0
                    while begin < n:
                        length = min(n - begin, window - (at + begin) % window)
                        part = ids[4 * begin : 4 * (begin + length)]
                        rows.append((doc_id, begin, length, zlib.crc32(part), n, (at + begin) // window, (at + begin) % window, part))
                        begin += length
                columns = list(zip(*rows)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents of ``docs(doc_id, text)`` in gapless windows of ``window`` tokens.

    A document is its ids and then ``end_id``; a null or empty text is the end id alone. Documents
    follow each other in scan order; only the last window can be short. Null and repeated doc_ids
    are rows like others. An empty table gives no pieces. Other columns are ignored.
    """
    return pieces(tokenized(docs, tokenizer, end_id), window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the windows themselves; a last one that is no power of two is padded.

    A window has ``window`` tokens at most, so the groups are bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(x["ids"] for x in raw), "<u4").astype(np.int32)
                full = len(ids) if len(ids) & (len(ids) - 1) == 0 else window
                out.append((np.pad(ids, (0, full - len(ids)), constant_values=pad_id), [x["doc_id"] for x in raw], [x["offset"] for x in raw]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                ["sequence_id", "ids", "doc_ids", "offsets"],
            )

    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return grouped.mapInArrow(run, "sequence_id long, ids array<int>, doc_ids array<long>, offsets array<long>")
