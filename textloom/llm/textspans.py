"""Spans of texts as column expressions: matches with code point positions, running folds, cutting by position.

Everything here takes time in proportion to the text and to the number of spans, also for texts of many megabytes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that one step of a running fold walks; code points of one piece of a text.
STEP = 64
PIECE = 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column, depth: int = 1) -> Column:
    """For each element the fold of all elements before it by an associative ``op``; ``zero`` for the first.

    Folds of blocks are folded on themselves, so an element costs a few steps at any length of the array.
    """
    fold = lambda a: F.aggregate(a, zero, op)
    block = lambda i: F.floor(i / STEP).cast("int")

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(x))), lambda b: fold(F.slice(x, b * STEP + 1, F.lit(STEP))))
        if depth:
            base = running(blocks, op, zero, depth - 1)
        else:
            base = let(blocks, lambda b: F.transform(b, lambda _, i: fold(F.slice(b, F.lit(1), i))))
        return let(base, lambda before: F.transform(x, lambda _, i: op(F.get(before, block(i)), fold(F.slice(x, block(i) * STEP + 1, i % STEP)))))

    return let(values, of)


class Kind(NamedTuple):
    """What proposes the spans of a kind: a pattern that never matches the empty string, a test of the match, a cheap hint."""

    number: int
    pattern: str
    keep: Callable[[Column], Column] | None = None
    hint: Column | None = None


def proposals(text: Column, kinds: list[Kind]) -> Column:
    """array<struct<start, kind, end, found>> of the leftmost matches per kind that pass its test; code points, end exclusive.

    A text without a match costs one search per kind, and none if the hint is false.
    """

    def of(part: Column) -> Column:
        kind, whole, between = part["kind"], part["whole"], part["between"]
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda b, m: F.length(b) + F.length(m))
        ends = F.zip_with(running(lengths, lambda s, x: s + x, F.lit(0)), lengths, lambda s, x: s + x)
        rows = F.zip_with(ends, whole, lambda e, m: F.struct((e - F.length(m)).alias("start"), kind.alias("kind"), e.alias("end"), m.alias("found")))

        def kept(r: Column) -> Column:
            test = F.lit(True)
            for k in kinds:
                test = F.when(kind == k.number, k.keep(r["found"])).otherwise(test) if k.keep else test
            return test

        return F.filter(rows, kept)

    def part(k: Kind) -> Column:
        found = F.struct(F.lit(k.number).alias("kind"), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias("whole"), F.split(text, k.pattern, -1).alias("between"))
        return F.when(text.rlike(k.pattern) if k.hint is None else k.hint & text.rlike(k.pattern), found)

    return F.flatten(F.transform(F.filter(F.array(*map(part, kinds)), lambda p: p.isNotNull()), of))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in ``pieces``; the work depends on the span alone."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((end - 1) / PIECE).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start % PIECE + 1, end - start)).otherwise(F.lit(""))


def clear(spans: Column, level: Callable[[Column], Column], levels: int) -> Column:
    """``spans`` (structs that begin with start) in order, without those that a span of a smaller ``level`` (0 .. levels - 1) overlaps.

    From the left a span is overlapped if an earlier one of a smaller level ends behind its start, from the right if the
    next one of a smaller level starts before its end; running folds give both for all spans at once.
    """
    far = 2**31 - 1
    below = range(levels - 1)
    each = lambda value, other: lambda r: F.struct(*[F.when(level(r) == j, value(r)).otherwise(other).alias(f"l{j}") for j in below])
    fold = lambda best: lambda a, b: F.struct(*[best(a[f"l{j}"], b[f"l{j}"]).alias(f"l{j}") for j in below])
    fixed = lambda value: F.struct(*[F.lit(value).alias(f"l{j}") for j in below])

    def of(rows: Column) -> Column:
        left = running(F.transform(rows, each(lambda r: r["end"], 0)), fold(F.greatest), fixed(0))
        right = F.reverse(running(F.reverse(F.transform(rows, each(lambda r: r["start"], far))), fold(F.least), fixed(far)))

        def free(r: Column, b: Column) -> Column:
            test = F.lit(True)
            for j in below:
                test = test & ((level(r) <= j) | ((b["left"][f"l{j}"] <= r["start"]) & (b["right"][f"l{j}"] >= r["end"])))
            return F.when(test, r)

        return F.filter(F.zip_with(rows, F.arrays_zip(left.alias("left"), right.alias("right")), free), lambda x: x.isNotNull())

    return F.when(F.exists(spans, lambda x: level(x) > 0), let(F.array_sort(spans), of)).otherwise(F.array_sort(spans))


def replaced(text: Column, found: Column, mark: str) -> Column:
    """The text with every span of ``found`` (sorted by start) replaced by ``mark``; overlapping or touching-inside spans become one."""

    def of(parts: Column) -> Column:
        before = running(F.transform(found, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        gaps = F.zip_with(found, before, lambda x, at: F.when(x["start"] >= at, F.concat(cut(parts, at, x["start"]), F.lit(mark))).otherwise(""))
        last = F.array_max(F.transform(found, lambda x: x["end"]))
        return F.concat(F.array_join(gaps, ""), cut(parts, last, F.length(text)))

    return F.when(F.size(found) > 0, let(pieces(text), of)).otherwise(text)
