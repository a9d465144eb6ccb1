"""Row filters and cleaning steps of the preprocessing chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while planning when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def length_filter(df: DataFrame, column: str = "content", low: int = 50, high: int = 10_000) -> DataFrame:
    return df.filter(F.length(column).between(low, high))


def language_filter(df: DataFrame, language: str = "en", column: str = "lang") -> DataFrame:
    return df.filter(F.col(column) == language)


def clean(df: DataFrame, method: str = "standard", source: str = "content") -> DataFrame:
    """Add ``content_clean`` and drop rows that become empty."""
    if method == "standard":
        expr = tx.clean_text(F.col(source))
    elif method == "advanced":
        expr = F.array_join(tx.advanced_tokens(F.col(source)), " ")
    else:
        raise ValueError(f"unknown clean method {method!r}")
    return drop_empty(df.withColumn("content_clean", expr))


def drop_empty(df: DataFrame, column: str = "content_clean") -> DataFrame:
    return df.filter(F.length(column) > 0)


def normalize_whitespace(df: DataFrame, column: str = "content_clean") -> DataFrame:
    return df.withColumn(column, tx.squeeze_spaces(F.col(column)))


def extract_entities(df: DataFrame, source: str = "content") -> DataFrame:
    return df.withColumn("entities", tx.capitalised_names(F.col(source)))


def explode_entities(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    explode = F.explode_outer if keep_empty else F.explode
    return df.withColumn("entity", explode("entities"))


def schema_violations(df: DataFrame, json_col: str, required: list[str], types: dict[str, str]) -> DataFrame:
    """One row per violation: a missing required field, or a field of the wrong JSON type."""
    doc = F.try_parse_json(json_col)
    # Numbers without a fraction are integers; a boolean also passes as one, as in Python.
    kinds = {
        "string": ["STRING"],
        "integer": ["BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"],
        "number": ["BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN", "DOUBLE", "FLOAT", "DECIMAL"],
        "boolean": ["BOOLEAN"],
    }
    checks = []
    for field in required:
        absent = F.variant_get(doc, f"$.{field}", "variant").isNull()
        checks.append(F.when(absent, F.lit(f"Missing required field: {field}")))
    for field, kind in types.items():
        value = F.variant_get(doc, f"$.{field}", "variant")
        found = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
        wrong = value.isNotNull() & ~found.isin(kinds[kind])
        checks.append(F.when(wrong, F.lit(f"Field {field} must be {kind}")))
    return df.withColumn("violation", F.explode(F.array_compact(F.array(*checks))))
