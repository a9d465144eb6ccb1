"""Encode and decode text with a trained vocabulary: one narrow pass, no shuffle.

A vocabulary has at most 100 000 entries by configuration, so it is read once (with that bound
checked) and shipped to the tasks. Every task remembers the words it has encoded.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.batches import stretches

MAX_VOCAB = 100_000
WORD_CACHE = 200_000


def encode_column(
    text: Column,
    word_ids: Callable[[str], list[int]],
    before: list[int] | None = None,
    after: list[int] | None = None,
    max_length: int | None = None,
) -> Column:
    """Ids of every whitespace word in turn, optionally wrapped and truncated."""
    head, tail = array("i", before or []), array("i", after or [])

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cached = lru_cache(WORD_CACHE)(lambda word: array("i", word_ids(word)))
        for texts in batches:
            for start, n in stretches(texts):
                ids, ends, missing = array("i"), np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)
                for i, content in enumerate(texts.slice(start, n).to_pylist()):
                    begin = len(ids)
                    if content is None:
                        missing[i] = True
                    else:
                        ids.extend(head)
                        for word in content.split():
                            ids.extend(cached(word))
                        ids.extend(tail)
                        if max_length is not None:
                            kept = ids[begin:][:max_length]
                            del ids[begin:]
                            ids.extend(kept)
                    ends[i + 1] = len(ids)
                values = pa.array(np.frombuffer(ids, np.int32)) if ids else pa.array([], pa.int32())
                yield pa.ListArray.from_arrays(pa.array(ends, mask=missing), values)

    return encode(text)


def decode_column(ids: Column, tokens: dict[int, str], join: Callable[[list[str]], str], unknown: str) -> Column:
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if row is None else join([tokens.get(int(i), unknown) for i in row]) for row in batch])

    return decode(ids)


def vocab_dict(vocab: DataFrame) -> dict[str, int]:
    """token -> id, refusing tables above the configured vocabulary limit."""
    from textloom.session import collect_bounded

    return {r["token"]: int(r["id"]) for r in collect_bounded(vocab.select("token", "id"), MAX_VOCAB + 1000, "vocabulary")}
