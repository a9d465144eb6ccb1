"""Text quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import CACHED_WORDS, GOLDEN, WordHashes, id_filter, int64, mix, utf8
from textloom.session import fresh_path, pin, scratch

# The model is fitted on half of the trusted documents: on all of that half.
# Words of the model: all that the fitted text holds twice or more. Others are one unknown word.
VOCABULARY = None
# Three-word runs seen less often in the fitted text are left out of the model: none.
LEAST_COUNT = 1
# A language's limit is this quantile of the perplexities of its n other trusted documents, times 1 + MARGIN / n.
QUANTILE = 0.99
MARGIN = 5
# Bits of the filter of known runs, at least and at most.
FILTER_BITS = 1 << 25, 1 << 27
LEAST_DISCOUNT = 0.05
# Tables that the runs are cut into at least, runs in one, and scan partitions whose documents share a copy of them at least.
SHARDS = 16
SHARD_RUNS = 1_000_000
GROUP_PARTITIONS = 16
# Words of text whose runs are counted together before they are moved.
BLOCK_WORDS = 300_000
# Documents that ask the model together, and words of theirs.
BATCH_DOCUMENTS = 8_000
BATCH_RUNS = 500_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, fit): documents that every label row calls good and not toxic; half of them, by hash, are for fitting.

    The other half is never fitted on, so its perplexities are those of any good text.
    """
    rows = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return rows.filter("q = 1 AND t = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fit"))


def frequent_words(texts: DataFrame, most: int | None) -> tuple[np.ndarray, int, int]:
    """Sorted 64-bit hashes of the words seen twice or more, or of the ``most`` most frequent of these, the number of all words, and of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column("text")):
                counts.update((text or b"").split())
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(int64(cache.of(batch.column("word").to_pylist())))], ["hash"])

    counted = pin(texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    words = counted.filter("n > 1")
    if most is not None:
        words = words.orderBy(F.desc("n"), "word").limit(most)
    hashes = np.unique(words.select("word").mapInArrow(hashed, "hash long").toArrow()["hash"].to_numpy().view(np.uint64))
    all_words = counted.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).first()
    return hashes, all_words["kinds"], all_words["n"] or 0


class Ids:
    """Number of each word of the model, found by its hash (8 bytes a word); any other word is the unknown one. Words seen last are remembered."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.unknown, self.cache = hashes, len(hashes), {}
        self.end = self.unknown + 1

    def of(self, text: bytes) -> np.ndarray:
        """Numbers of the words, and the end of the text."""
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            new = {word for word, number in zip(words, found) if number is None}
            if len(self.cache) + len(new) > CACHED_WORDS:
                self.cache, new = {}, set(words)
            self.cache.update(zip(new, self.numbers(new).tolist()))
            found = list(map(self.cache.get, words))
        return np.array([*found, self.end], np.int64)

    def numbers(self, words: set[bytes]) -> np.ndarray:
        wanted = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if not self.unknown:
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), self.unknown - 1)
        return np.where(self.hashes[at] == wanted, at, self.unknown)


def summed(rows: np.ndarray, keys: int) -> np.ndarray:
    """Columns sorted by the first ``keys`` of them, one row per key, the last column added up."""
    rows = rows[:, np.lexsort(rows[:keys][::-1])]
    starts = np.flatnonzero(changes(rows[:keys]))
    return np.concatenate([rows[:-1, starts], np.add.reduceat(rows[-1], starts)[None] if len(starts) else rows[-1:]])


def changes(keys: np.ndarray) -> np.ndarray:
    """Whether each column of sorted keys differs from the one before."""
    return np.concatenate([np.ones(min(keys.shape[1], 1), bool), (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def packed(columns: np.ndarray, ascending: bool = True) -> bytes:
    """Equally long columns of whole numbers, the first ascending or not: a row takes the bytes that tell it from its neighbours."""
    parts = [planes(np.diff(x, prepend=0) if ascending and i == 0 else np.ascontiguousarray(x)) for i, x in enumerate(columns)]
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int, size: int, ascending: bool = True) -> np.ndarray:
    if not size:
        return np.empty((columns, 0), np.int64)
    raw = pa.decompress(data, decompressed_size=8 * columns * size, codec="zstd", asbytes=True)
    out = np.stack([from_planes(raw[i : i + 8 * size], "<i8") for i in range(0, len(raw), 8 * size)])
    if ascending:
        out[0] = np.cumsum(out[0])
    return out


def joined(rows: pa.Table, name: str, columns: int) -> np.ndarray:
    """The packed columns of all rows, one after the other."""
    blocks = rows.select([name, f"{name}_size"]).to_pylist()
    return np.concatenate([np.empty((columns, 0), np.int64), *(unpacked(r[name], columns, r[f"{name}_size"]) for r in blocks if r[f"{name}_size"])], axis=1)


def by_shard(shard: np.ndarray, columns: np.ndarray, shards: int, ascending: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(shard, size, packed columns) of each shard that has rows; they keep their order."""
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for number in np.unique(shard).tolist():
        at = order[ends[number - 1] if number else 0 : ends[number]]
        yield number, len(at), packed(columns[:, at], ascending)


COUNTED = "shard int, runs_size long, runs binary, counts array<long>"


def counted_runs(texts: DataFrame, ids: Ids, shards: int) -> DataFrame:
    """COUNTED: three-word runs (u, v, w, n) with their counts, cut by (u, v), and how many known ones are seen once to four times.

    u or v is ``begin`` where the text begins, both before its first word.
    """
    begin, unknown = ids.end + 1, ids.unknown
    sent = [("shard", pa.int32()), ("runs_size", pa.int64()), ("runs", pa.binary())]

    def blocks(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)
        rows = summed(np.concatenate([rows, np.ones((1, rows.shape[1]), np.int64)]), 3)
        found = list(by_shard(shard_of(key_of(-1, rows[0], rows[1]), shards), rows, shards))
        return pa.RecordBatch.from_pylist([dict(zip(("shard", "runs_size", "runs"), x)) for x in found], pa.schema(sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for text in utf8(batch.column("text")):
                w = np.concatenate([[begin, begin], ids.of(text or b"")])
                parts.append(np.stack([w[:-2], w[1:-1], w[2:]]))
                n += len(w)
                if n > BLOCK_WORDS:
                    yield blocks(parts)
                    parts, n = [], 0
        if parts:
            yield blocks(parts)

    def one(rows: pa.Table) -> pa.Table:
        runs = summed(joined(rows, "runs", 4), 3)
        known = runs[3, (runs[0] < unknown) & (runs[1] < unknown)]
        counts = np.bincount(np.minimum(known, 5), minlength=6)[:5]
        return pa.table({"shard": rows["shard"][:1], "runs_size": [runs.shape[1]], "runs": [packed(runs)], "counts": [counts]}, pa.schema([*sent, ("counts", pa.list_(pa.int64()))]))

    return texts.mapInArrow(run, "shard int, runs_size long, runs binary").groupBy("shard").applyInArrow(one, COUNTED)


# How a context goes on: all counts together, and how many words follow it once, twice and more often.
CONTEXT = 4
HELD = "shard int, two_size long, two binary, three_size long, three binary"
FITTED = f"{HELD}, bits binary, counts array<long>"


def held_runs(counted: DataFrame, unknown: int, shards: int, bits: int) -> DataFrame:
    """FITTED: what a shard's run values are made of, cut by the last two words.

    two: v, w, how many words come before (v w), and how (v w) goes on. three, of known contexts only: place of
    (v w) in two, u, n, and how (u v) goes on. Then the filter bits of the shard's keys, and how many (v w) have one to four words before them.
    """

    sent = pa.schema([("shard", pa.int32()), ("runs_size", pa.int64()), ("runs", pa.binary()), ("leads_size", pa.int64()), ("leads", pa.binary())])

    def row(shard: int, runs: tuple[int, bytes | None] = (0, None), leads: tuple[int, bytes | None] = (0, None)) -> dict:
        return {"shard": shard, "runs_size": runs[0], "runs": runs[1], "leads_size": leads[0], "leads": leads[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.to_pylist():
                runs = unpacked(given["runs"], 4, given["runs_size"])
                u, v, w, n = runs
                first = changes(runs[:2])
                starts, at = np.flatnonzero(first), np.cumsum(first) - 1
                after = np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (n, n == 1, n == 2, n > 2)])
                after[:, (u[starts] >= unknown) | (v[starts] >= unknown)] = 0
                order = np.lexsort((u, w, v))
                out = np.concatenate([[v, w, u, n], after[:, at]])[:, order]
                rows = [row(k, runs=(size, data)) for k, size, data in by_shard(shard_of(key_of(-1, out[0], out[1]), shards), out, shards)]
                # As a pair of words, a context belongs to the shard that its runs were counted in.
                known = after[0] > 0
                leads = np.concatenate([runs[:2, starts], after])[:, known]
                rows.append(row(given["shard"], leads=(leads.shape[1], packed(leads))))
                yield pa.RecordBatch.from_pylist(rows, sent)

    def one(rows: pa.Table) -> pa.Table:
        runs = joined(rows, "runs", 4 + CONTEXT)
        runs = runs[:, np.lexsort(runs[:3][::-1])]
        first = changes(runs[:2])
        starts = np.flatnonzero(first)
        v, w = runs[:2, starts]
        before = np.diff(np.append(starts, runs.shape[1]))
        lead = np.zeros((CONTEXT, len(v)), np.int64)
        leads = joined(rows, "leads", 2 + CONTEXT)
        key = key_of(-1, v, w)
        order = np.argsort(key)
        lead[:, order[np.searchsorted(key[order], key_of(-1, leads[0], leads[1]))]] = leads[2:]
        two = np.concatenate([[v, w, before], lead])
        # Runs of known contexts.
        kept = (runs[4] > 0) & (runs[3] >= LEAST_COUNT)
        three = np.concatenate([(np.cumsum(first) - 1)[None], runs[2:]])[:, kept]
        known = v < unknown
        keys = np.concatenate([key[known & (w != unknown)], key_of(three[1], v[three[0]], w[three[0]])])
        set_bits = np.zeros(bits, np.uint8)
        set_bits[places(keys, bits)] = 1
        given = {
            "shard": rows["shard"][:1], "two_size": [two.shape[1]], "two": [packed(two)], "three_size": [three.shape[1]], "three": [packed(three)],
            "bits": [np.packbits(set_bits, bitorder="little").tobytes()], "counts": [np.bincount(np.minimum(before[known], 5), minlength=6)[:5]],
        }
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table(given, pa.schema(list(zip(given, kinds))))

    blocks = "shard int, runs_size long, runs binary, leads_size long, leads binary"
    return counted.select("shard", "runs_size", "runs").mapInArrow(run, blocks).groupBy("shard").applyInArrow(one, FITTED)


# Per word v: sum of the counts of (v w), how many w have one, two and more words before (v w), that number for the unknown w; per word w: how many v.
WORD_SUMS = ["total", "once", "twice", "more", "unknown", "before"]


def word_sums(held: DataFrame, unknown: int) -> np.ndarray:
    """WORD_SUMS, a column per word, the unknown one and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(WORD_SUMS), unknown + 2), np.int64)
        for batch in batches:
            for given in batch.to_pylist():
                v, w, a = unpacked(given["two"], 3 + CONTEXT, given["two_size"])[:3]
                np.add.at(out[5], w, 1)
                v, w, a = v[v < unknown], w[v < unknown], a[v < unknown]
                for row, x in zip(out, (a, a == 1, a == 2, a > 2, np.where(w == unknown, a, 0))):
                    np.add.at(row, v, x)
        at = np.flatnonzero(out.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, out[:, at])], ["w", *WORD_SUMS])

    schema = ", ".join(f"{c} long" for c in ["w", *WORD_SUMS])
    sums = held.select("two_size", "two").mapInArrow(run, schema).groupBy("w").agg(*[F.sum(c).alias(c) for c in WORD_SUMS]).toArrow()  # a row per word
    out = np.zeros((len(WORD_SUMS), unknown + 2))
    out[:, sums["w"].to_numpy()] = [sums[c].to_numpy() for c in WORD_SUMS]
    return out


def discounts(counts: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of runs seen once to four times (modified Kneser-Ney).

    Small samples can give no or negative discounts; some mass always goes to the shorter context.
    """
    n = [counts.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [min(i, max(LEAST_DISCOUNT, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]


def cut_of(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])


def left_by(once: np.ndarray, twice: np.ndarray, more: np.ndarray, total: np.ndarray, d: list[float]) -> np.ndarray:
    """The share that a context's discounts leave to the shorter context."""
    return (d[0] * once + d[1] * twice + d[2] * more) / total


@dataclass
class Model:
    """Additive form of the interpolated model.

    log p(w | u v) is the sum of a word's part, its context's part and a part of each known run:
    lp1[w] + back[v] + value(v w) + value(u v w), where value(v w) also holds the part of (v w) as the
    context of the next word, and runs unknown to the model add nothing. So a document's likelihood is a
    sum over its runs, and runs can be looked up wherever their counts are kept.
    """

    ids: Ids
    lp1: np.ndarray  # per word, then the unknown one, then the end
    back: np.ndarray  # per context word
    unknown_after: np.ndarray  # value of (v, unknown), per v
    values: DataFrame  # HELD, a row per table of known runs
    filter: np.ndarray  # bits of the known keys
    shards: int  # tables that the runs are cut into
    p1: np.ndarray  # probability by the word alone, as in lp1 but the unknown words together
    total: np.ndarray  # sum of the counts of a context word
    share: np.ndarray  # what its discounts leave
    d2: list[float]
    d3: list[float]

    def held_values(self) -> Callable[[dict], tuple[np.ndarray, np.ndarray]]:
        """Sorted keys and values of the runs of one row of HELD."""
        unknown, p1, total, share, d2, d3 = self.ids.unknown, self.p1, self.total, self.share, self.d2, self.d3

        def of(held: dict) -> tuple[np.ndarray, np.ndarray]:
            v, w, a, *lead = unpacked(held["two"], 3 + CONTEXT, held["two_size"])
            at, u, n, *context = unpacked(held["three"], 3 + CONTEXT, held["three_size"])
            inner, x = v < unknown, np.minimum(v, unknown)
            with np.errstate(divide="ignore", invalid="ignore"):
                p2 = (a - cut_of(a, d2)) / total[x] + share[x] * p1[w]
                two = np.log(p2) - np.log(share[x]) - np.log(p1[w])
                two += np.where(lead[0] > 0, np.log(left_by(*lead[1:], lead[0], d3)), 0.0)
            back = left_by(*context[1:], context[0], d3)
            three = np.log((n - cut_of(n, d3)) / context[0] + back * p2[at]) - np.log(back) - np.log(p2[at])
            inner &= w != unknown
            keys = np.concatenate([key_of(-1, v[inner], w[inner]), key_of(u, v[at], w[at])])
            values = np.concatenate([two[inner], three])
            order = np.argsort(keys)
            return keys[order], values[order]

        return of


def key_of(u: object, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of each run; two-word runs take u = -1."""
    key = mix(np.broadcast_to(np.asarray(u, np.int64), v.shape).astype(np.uint64) + GOLDEN)
    return int64(mix(mix(key + v.astype(np.uint64)) + w.astype(np.uint64)))


def fit(docs: DataFrame, labels: DataFrame, vocabulary: int | None = VOCABULARY) -> Model:
    """The model of the trusted documents; what else the fit writes goes when it ends."""
    place = fresh_path(docs.sparkSession, "model")
    with scratch(docs.sparkSession):
        return fitted_to(docs, labels, vocabulary, place)


def fitted_to(docs: DataFrame, labels: DataFrame, vocabulary: int | None, place: str) -> Model:
    spark = docs.sparkSession
    fitted = pin(trusted_ids(labels).filter("fit").select("doc_id"), "trusted-ids")
    runs_path = fresh_path(spark, "runs")
    with scratch(spark):
        # Of the texts that the join moves, most are trusted.
        texts = pin(docs.filter(id_filter(fitted)).join(fitted, "doc_id", "left_semi").select("text"), "trusted-texts", compression="zstd")
        # The moved texts go before the runs come.
        spark._jvm.System.gc()
        hashes, kinds, n = frequent_words(texts, vocabulary)
        ids = Ids(hashes)
        unknown = ids.unknown
        # A place in the text gives a run of two words and one of three at most.
        shards = max(SHARDS, math.ceil(2 * n / SHARD_RUNS))
        counted_runs(texts, ids, shards).write.parquet(runs_path)
    counted = spark.read.schema(COUNTED).parquet(runs_path)
    d3 = discounts(counts_in(counted))

    bits = min(max(FILTER_BITS[0], 1 << (16 * n).bit_length()), FILTER_BITS[1]) // shards // 32 * 32
    held_runs(counted, unknown, shards, bits).write.parquet(place)
    held = spark.read.schema(FITTED).parquet(place)
    d2 = discounts(counts_in(held))
    total, once, twice, more, after, a1 = word_sums(held, unknown)
    d1 = discounts(Counter(a1[a1 > 0].astype(int).tolist()))
    cut, every = cut_of(a1, d1), max(a1.sum(), 1.0)
    p1 = (a1 - cut) / every + (cut.sum() / every if a1.sum() else 1.0) / (unknown + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Every context word goes on; the unknown one is no context.
        share = np.where(total > 0, left_by(once, twice, more, total, d2), 1.0)
        p2 = (after - cut_of(after, d2)) / total + share * p1[unknown]
        unknown_after = np.where(after > 0, np.log(p2) - np.log(share) - np.log(p1[unknown]), 0.0)
    lp1 = np.log(p1)
    # An unknown word is one of the unknown words of the fitted text, all alike.
    lp1[unknown] -= math.log(max(kinds - unknown, 2))
    known = np.zeros(shards * bits // 32, np.uint32)
    for r in held.select("shard", "bits").toLocalIterator():  # FILTER_BITS together
        known[r["shard"] * bits // 32 : (r["shard"] + 1) * bits // 32] = np.frombuffer(r["bits"], "<u4")
    back = np.log(share)[: unknown + 1]
    return Model(ids, lp1, back, unknown_after[: unknown + 1], held.select(*[c.split()[0] for c in HELD.split(", ")]), known, shards, p1, total, share, d2, d3)


def counts_in(rows: DataFrame) -> dict[int, int]:
    """How many runs are seen once to four times, added up over all shards."""
    return {r["i"]: r["m"] for r in rows.select(F.posexplode("counts").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()}


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Place of each key among the filter bits of its shard; one that is set only costs a lookup."""
    return (mix(keys.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


ASKED = (
    "part int, shard int, batch long, pairs_size long, pairs binary, runs_size long, runs binary, cells_size long, cells binary, documents long, "
    "place int, doc_id long, lang string, n long, base double"
)


def scored_words(docs: DataFrame, model: Model, groups: int) -> DataFrame:
    """What the documents ask of the model, and what is known of them without it.

    Per batch of documents and shard one row with its known runs. pairs: their last two words v, w, and how
    many runs end so. runs: per run u + 1, or 0 if only (v w) is known, and how many documents of the batch
    hold it. cells: these documents' places in the batch (of ``documents``), and how often. Per document one row with
    n (words) and base (log-likelihood without known runs). The end of a text counts as one more word.
    Batches are numbered by scan partition, the same in any rerun.
    """
    ids, lp1, back, after, bits = model.ids, model.lp1, model.back, model.unknown_after, model.filter
    unknown, shards = ids.unknown, model.shards
    shard_bits = 32 * len(bits) // shards
    columns = [c.split() for c in ASKED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}

    def rows(count: int, /, **given: object) -> pa.RecordBatch:
        made = [
            given[c] if isinstance(given.get(c), pa.Array) else pa.nulls(count, kinds[k]) if c not in given else pa.array(given[c], kinds[k])
            for c, k in columns
        ]
        return pa.RecordBatch.from_arrays(made, [c for c, _ in columns])

    def asked(number: int, pairs: list[np.ndarray], befores: list[np.ndarray]) -> pa.RecordBatch:
        pair, before = np.concatenate(pairs), np.concatenate(befores)
        documents, place = len(pairs), np.repeat(np.arange(len(pairs), dtype=np.int32), [len(x) for x in pairs])
        pairs.clear(), befores.clear()
        order = np.lexsort((before, pair))
        pair, before, place = pair[order], before[order], place[order]
        new_run = np.append(True, (pair[1:] != pair[:-1]) | (before[1:] != before[:-1]))
        starts = np.flatnonzero(new_run | np.append(True, place[1:] != place[:-1]))
        times = np.diff(np.append(starts, len(order)))
        pair, before, place = pair[starts], before[starts], place[starts]
        run_starts = np.flatnonzero(new_run[starts])
        del order, new_run, starts
        holders, of_run = np.diff(np.append(run_starts, len(pair))), pair[run_starts]
        pair_starts = np.flatnonzero(changes(of_run[None]))
        ends, (v, w) = np.diff(np.append(pair_starts, len(of_run))), np.divmod(of_run[pair_starts], unknown + 2)
        shard = shard_of(key_of(-1, v, w), shards)
        run_shard = np.repeat(shard, ends)
        given = [
            by_shard(shard, np.stack([v, w, ends]), shards),
            by_shard(run_shard, np.stack([before[run_starts], holders]), shards, ascending=False),
            by_shard(np.repeat(run_shard, holders), np.stack([place, times]), shards, ascending=False),
        ]
        found = [[x[0][0], *x[0][1:], *x[1][1:], *x[2][1:]] for x in zip(*given)]
        names = ["shard", "pairs_size", "pairs", "runs_size", "runs", "cells_size", "cells"]
        given = {c: [x] * len(found) for c, x in (("part", (number >> 32) % groups), ("batch", number), ("documents", documents))}
        return rows(len(found), **given, **dict(zip(names, zip(*found))))

    def known(start: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = start + places(keys, shard_bits)
        return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pairs, befores = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            first, sizes, sums = len(pairs), [], []
            for text in utf8(batch.column("text")):
                w = ids.of(text or b"")
                v, x = w[:-1], w[1:]
                sums.append(float(lp1[w].sum() + back[v].sum() + after[v[x == unknown]].sum()))
                inner = v < unknown
                sizes.append(len(v))
                two = key_of(-1, v, x)
                # A run is held by the shard of its last two words.
                start = shard_of(two, shards) * shard_bits
                three = np.zeros(len(v), bool)
                three[1:] = inner[:-1] & inner[1:] & known(start[1:], key_of(w[:-2], w[1:-1], w[2:]))
                asks = three | (inner & (x != unknown) & known(start, two))
                pairs.append((v * (unknown + 2) + x)[asks])
                befores.append(np.where(three, np.append(0, w[:-2] + 1), 0)[asks].astype(np.int32))
            n, place = batch.num_rows, np.arange(first, len(pairs), dtype=np.int32)
            yield rows(
                n, part=[(number >> 32) % groups] * n, shard=place % shards, batch=[number] * n, place=place,
                doc_id=batch.column("doc_id"), lang=batch.column("lang").cast(pa.string()), n=sizes, base=sums,
            )
            if len(pairs) > BATCH_DOCUMENTS or sum(map(len, pairs)) > BATCH_RUNS:
                if any(map(len, pairs)):
                    yield asked(number, pairs, befores)
                number, pairs, befores = number + 1, [], []
        if any(map(len, pairs)):
            yield asked(number, pairs, befores)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, ASKED)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % shards


def planes(values: np.ndarray) -> bytes:
    """Numbers with all their first bytes in front, then all second ones: equal high bytes stand together and compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words, perplexity (null without words).

    Documents and run values meet by shard of the run and group of scan partitions: a task holds one
    shard of the values and what its group's documents ask of it, both bounded, and gives one row of sums
    per batch. Frequent runs are no hot keys: a batch names each run once. Sums meet by batch.
    """
    # More shards need fewer groups for as many tasks, so the copies of a large model stay few.
    groups = max(1, docs.rdd.getNumPartitions() // max(GROUP_PARTITIONS, model.shards))
    held_values = model.held_values()

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        own = asked.filter(pc.is_valid(asked["place"])).select(["batch", "place", "doc_id", "lang", "n", "base"])
        out = [own.append_column("sums", pa.nulls(own.num_rows, pa.binary()))]
        if held.num_rows:
            keys, values = held_values(held.slice(0, 1).to_pylist()[0])
            sums: list[bytes] = []

            def value_of(wanted: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                return np.where(keys[at] == wanted, values[at], 0.0) if len(keys) else np.zeros(len(wanted))

            asks = asked.filter(pc.is_valid(asked["pairs"]))
            for row in asks.to_pylist():
                v, w, ends = unpacked(row["pairs"], 3, row["pairs_size"])
                before, holders = unpacked(row["runs"], 2, row["runs_size"], ascending=False)
                place, times = unpacked(row["cells"], 2, row["cells_size"], ascending=False)
                of = np.repeat(np.arange(len(v)), ends)
                value, three = value_of(key_of(-1, v, w))[of], before > 0
                value[three] += value_of(key_of(before[three] - 1, v[of[three]], w[of[three]]))
                found = np.bincount(place, np.repeat(value, holders) * times)
                sums.append(pa.compress(planes(np.append(found, np.zeros(row["documents"] - len(found)))), codec="zstd", asbytes=True))
            given = [asks["batch"], *(pa.nulls(len(sums), out[0].schema.field(c).type) for c in out[0].column_names[1:-1]), pa.array(sums, pa.binary())]
            out.append(pa.table(given, names=out[0].column_names))
        return pa.concat_tables(out)

    def added(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows["place"])).sort_by("place")
        total = own["base"].to_numpy().copy()
        for data in rows["sums"].drop_null().to_pylist():
            total += from_planes(pa.decompress(data, decompressed_size=8 * len(total), codec="zstd", asbytes=True), "<f8")
        return own.select(["doc_id", "lang", "n"]).append_column("sum", pa.array(total))

    copies = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked, held = scored_words(docs, model, groups), model.values.withColumn("part", copies)
    schema = "batch long, place int, doc_id long, lang string, n long, base double, sums binary"
    parts = asked.groupBy("part", "shard").cogroup(held.groupBy("part", "shard")).applyInArrow(look_up, schema)
    out = parts.groupBy("batch").applyInArrow(added, "doc_id long, lang string, n long, sum double")
    return out.select("doc_id", "lang", F.col("n").alias("n_words"), F.when(F.col("n") > 0, F.exp(-F.col("sum") / (F.col("n") + 1))).alias("perplexity"))


def limits(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit): each language's quantile over all its trusted documents kept from fitting, the null language's too.

    Below 1 / (1 - quantile) documents the quantile is their maximum. The margin above it shrinks with
    their number, so few documents give a cautious limit and no number of them switches to another rule.
    """
    known = scores.join(trusted_ids(labels).filter("NOT fit"), "doc_id", "left_semi").filter("perplexity IS NOT NULL")
    by = known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit"), F.count(F.lit(1)).alias("n"))
    return by.select("lang", (F.col("limit") * (1 + MARGIN / F.col("n"))).alias("limit"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept for every row of ``docs(doc_id, text, lang)``.

    Trusted text: documents that ``labels(doc_id, quality, toxic)`` calls good and not toxic. A document
    is kept unless its perplexity is above its language's limit. A document without words is not kept.
    Documents without a language are a language of their own. A language without any trusted document
    has no limit, and everything with words is kept. Null and repeated doc_ids are rows like others.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    scores = pin(perplexities(docs, fit(docs, labels)), "perplexities")
    found = limits(scores, labels, quantile).collect()  # a row per language
    limit = F.lit(next((r["limit"] for r in found if r["lang"] is None), None)).cast("double")
    named = [r for r in found if r["lang"] is not None]
    table = F.create_map(*[F.lit(x) for r in named for x in (r["lang"], float(r["limit"]))]) if named else None
    own = F.try_element_at(table, F.col("lang")) if named else F.lit(None).cast("double")
    limit = F.when(F.col("lang").isNull(), limit).otherwise(own)
    rows = scores.withColumn("threshold", limit)
    return rows.withColumn("kept", (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
