"""Records that a line does not bound: CSV rows with line breaks in quotes, elements of a JSON array.

The text reader cuts files into byte ranges and these at a separator (line break, comma). Whether a separator ends a record
depends on all that stands before it in the file, so a first pass finds for each range where it leads to from either side of
a quote, the ranges of a file are put one behind the other, and a second pass reads each range from its true state.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.batches import stretches
from textloom.session import collect_bounded, pin

# Byte ranges of one read, whose summaries (a few numbers each) the driver puts in order.
MAX_RANGES = 2_000_000


class State(NamedTuple):
    inside: bool
    depth: int


Scanner = Callable[[str, State], State]


def csv_scanner(sep: str) -> Scanner:
    """A quote opens only where a field starts; inside, a doubled quote is one character of the field."""
    # Rest of a line inside quotes up to the closing quote; a field outside up to the next separator.
    closing = re.compile(r'(?:[^"]|"")*+"')

    def scan(line: str, state: State) -> State:
        if '"' not in line:
            return state
        at, inside = 0, state.inside
        while True:
            if inside:
                end = closing.match(line, at)
                if end is None:
                    return State(True, 0)
                at, inside = end.end(), False
            else:
                if line.startswith('"', at):
                    at, inside = at + 1, True
                    continue
            at = line.find(sep, at)
            if at < 0:
                return State(False, 0)
            at += len(sep)

    return scan


def json_scanner(chunk: str, state: State) -> State:
    """Brackets outside strings; an escaped character ends no string."""
    parts = (re.sub(r"\\.", "", chunk, flags=re.S) if "\\" in chunk else chunk).split('"')
    inside, depth = state
    for i, part in enumerate(parts):
        if i:
            inside = not inside
        if not inside and part:
            depth += part.count("{") + part.count("[") - part.count("}") - part.count("]")
    return State(inside, depth)


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The chunks of a partition, range by range, in pieces."""
    for batch in batches:
        for at, n in stretches(batch.column("value")):
            names, starts, values = (batch.column(c).slice(at, n).to_pylist() for c in ("file", "start", "value"))
            begin = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[begin] or starts[i] != starts[begin]:
                    yield (names[begin], starts[begin]), values[begin:i]
                    begin = i


def starting_states(chunks: DataFrame, scan: Scanner) -> tuple[dict[tuple[str, int], State], list[tuple[str, State]]]:
    """The states of ranges that start inside quotes or brackets, and each file's last state."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outs = None, []
        row = lambda: pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "out": outs[0].inside, "out_by": outs[0].depth, "in": outs[1].inside, "in_by": outs[1].depth}], schema=kinds)
        for now, values in ranges(batches):
            if now != key:
                if key is not None:
                    yield row()
                key, outs = now, [State(False, 0), State(True, 0)]
            for value in values:
                outs = [scan(value, s) for s in outs]
        if key is not None:
            yield row()

    kinds = pa.schema([("file", pa.string()), ("start", pa.int64()), ("out", pa.bool_()), ("out_by", pa.int64()), ("in", pa.bool_()), ("in_by", pa.int64())])
    rows = collect_bounded(chunks.mapInArrow(summarise, "file string, start long, out boolean, out_by long, in boolean, in_by long"), MAX_RANGES, "byte ranges")
    found, last, file, state = {}, [], None, State(False, 0)
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            if file is not None:
                last.append((file, state))
            file, state = r["file"], State(False, 0)
        if state != State(False, 0):
            found[file, r["start"]] = state
        state = State(r["in"] if state.inside else r["out"], state.depth + (r["in_by"] if state.inside else r["out_by"]))
    if file is not None:
        last.append((file, state))
    return found, last


def joined(chunks: DataFrame, scan: Scanner, separator: str, ends: Callable[[State], bool]) -> tuple[DataFrame, list[tuple[str, State]]]:
    """(file, start, row, record) of whole records, and each file's last state. A record belongs to the range that it begins in."""
    known, last = starting_states(chunks, scan)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, row, open_parts = None, State(False, 0), 0, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 5
            types = pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "start", "row", "record", "whole"])

        for now, values in ranges(batches):
            out = []
            if now != key:
                if open_parts:
                    out.append((*key, row, separator.join(open_parts), False))
                key, row, open_parts = now, 0, []
                state = known.get(now, State(False, 0))
                # The rest of a record that an earlier range began is row -1.
                row = 0 if now not in known or ends(state) else -1
            for value in values:
                open_parts.append(value)
                state = scan(value, state)
                if ends(state):
                    out.append((*key, row, separator.join(open_parts), row >= 0))
                    row, open_parts = row + 1, []
            yield batch_of(out)
        if open_parts:
            yield batch_of([(*key, row, separator.join(open_parts), False)])

    rows = chunks.mapInArrow(cut, "file string, start long, row long, record string, whole boolean")
    if all(map(ends, known.values())):
        return rows.select("file", "start", "row", "record"), last
    # Parts of records that cross ranges: two a range at most. They belong to the last part before them that begins a record.
    rows = pin(rows, "records", compression="zstd")
    order = Window.partitionBy("file").orderBy("start", "row")
    begun = F.last(F.when(F.col("row") >= 0, F.struct("start", "row")), ignorenulls=True).over(order)
    parts = rows.filter("NOT whole").withColumn("begun", begun).groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["record"]), separator)
    whole = parts.select("file", F.col("begun.start").alias("start"), F.col("begun.row").alias("row"), text.alias("record"))
    return rows.filter("whole").select("file", "start", "row", "record").unionByName(whole), last


def chunks_of(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, start, row, record): the rows of CSV files, line breaks in quotes included. An open quote at the end of a file is an error."""
    rows, last = joined(chunks_of(spark, path, "\n"), csv_scanner(sep), "\n", lambda s: not s.inside)
    for file, state in last:
        if state.inside:
            raise ValueError(f"{file} ends inside quotes")
    return rows.withColumn("record", F.regexp_replace("record", "\r$", ""))


def holds_arrays(spark: SparkSession, path: str) -> bool:
    first = spark.read.option("lineSep", ",").text(path).first()
    return first is not None and first["value"].lstrip("\ufeff \t\r\n").startswith("[")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, row, record): the elements of JSON files that hold one array each, on one line or many. A cut file is an error."""
    rows, last = joined(chunks_of(spark, path, ","), json_scanner, ",", lambda s: not s.inside and s.depth <= 1)
    for file, state in last:
        if state != State(False, 0):
            raise ValueError(f"{file} is no whole JSON array: it ends {'inside a string' if state.inside else f'with {state.depth} open brackets'}")
    # The first element has the array's bracket in front, the last one behind.
    first = (F.col("start") == 0) & (F.col("row") == 0)
    record = F.when(first, F.regexp_replace("record", r"^[\x{FEFF}\s]*\[", "")).otherwise(F.col("record"))
    record = F.trim(record, F.lit(" \t\r\n"))
    depth = lambda c, a, b: F.length(c) - F.length(F.replace(c, F.lit(a), F.lit(""))) - F.length(c) + F.length(F.replace(c, F.lit(b), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(record, r"\\\\.", ""), '"[^"]*+"', "")
    record = F.when(depth(bare, "[", "]") < 0, F.regexp_replace(record, r"\s*\]$", "")).otherwise(record)
    return rows.withColumn("record", record).filter(F.length("record") > 0)


def strings_of(rows: DataFrame, column: str = "record"):
    """The column as the dataset of strings that Spark's own CSV and JSON parsers take."""
    jvm = rows.sparkSession._jvm
    return getattr(rows.select(column)._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())
