"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """CSV has no nested values: arrays, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


# Line breaks inside a value as two characters each, so that every row stays on its line.
LINE_CODES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))
# Tells an empty text from a missing one.
EMPTY_CODE = "\\e"


def escaped(df: DataFrame) -> DataFrame:
    """Backslashes and line breaks of all text columns as codes; ``unescaped`` undoes it."""

    def code(value: Column) -> Column:
        for char, short in LINE_CODES:
            value = F.replace(value, F.lit(char), F.lit(short))
        return F.when(value == "", EMPTY_CODE).otherwise(value)

    return df.select(*[code(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in df.schema])


def unescaped(df: DataFrame) -> DataFrame:
    def decode(value: Column) -> Column:
        # The backslash itself comes last: until then each backslash begins a code.
        for char, short in reversed(LINE_CODES):
            value = F.replace(value, F.lit(short), F.lit(char))
        return value

    def text(value: Column) -> Column:
        return F.when(value == EMPTY_CODE, "").otherwise(decode(value))

    return df.select(*[text(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in df.schema])


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write as Parquet, CSV or JSON Lines. Read CSV back with ``escaped=True``."""
    writer = (escaped(flat_for_csv(df)) if fmt == "csv" else df).write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_documents_json(df: DataFrame, path: str) -> None:
    """Documents as JSON Lines."""
    write_corpus(df, path, "json")


def publish(spark: SparkSession, staging: str, target: str) -> None:
    """Move a finished staging folder to its place."""
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(staging)
    goal = jvm.org.apache.hadoop.fs.Path(target)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(goal.getParent())
    old = None
    if fs.exists(goal):
        # The old result goes only when the new one is in its place.
        old = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
        if not fs.rename(goal, old):
            raise OSError(f"could not move the old {target} aside")
    if not fs.rename(source, goal):
        if old is not None:
            fs.rename(old, goal)
        raise OSError(f"could not move {staging} to {target}")
    if old is not None:
        fs.delete(old, True)
