"""Chains of named steps, and the operators of each family by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.operators import bpe, datasets, unigram, web, wordpiece
from textloom.sources import readers

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Chain:
    """Steps from DataFrame to DataFrame that become one plan.

    ``Chain().add("clean", clean).add("dedup", exact_dedup)``; the rows after each step are counted while
    the one action runs.
    """

    steps: list[tuple[str, Step]] = field(default_factory=list)

    def add(self, name: str, step: Step) -> Chain:
        if name in dict(self.steps):
            raise ValueError(f"step {name!r} is there already")
        self.steps.append((name, step))
        return self

    def plan(self, df: DataFrame, counters: dict[str, Observation] | None = None) -> DataFrame:
        for name, step in self.steps:
            df = df.transform(step)
            if counters is not None:
                counters[name] = Observation(name)
                df = df.observe(counters[name], F.count(F.lit(1)).alias("rows"))
        return df

    def run(self, df: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
        """Write the result in one action; rows per step. Fails when a step left no rows."""
        counters: dict[str, Observation] = {}
        write(self.plan(df, counters))
        rows = {name: seen.get["rows"] for name, seen in counters.items()}
        for name, n in rows.items():
            if n == 0:
                raise ValueError(f"step {name} left no rows")
        return rows


# (train, encode, decode)
TOKENIZERS = {
    "bpe": (bpe.bpe_train, bpe.bpe_encode, bpe.bpe_decode),
    "wordpiece": (wordpiece.wordpiece_train, wordpiece.wordpiece_encode, wordpiece.wordpiece_decode),
    "unigram": (unigram.unigram_train, unigram.unigram_encode, unigram.unigram_decode),
}
TASKS = {
    "classification": datasets.prepare_classification,
    "captioning": datasets.prepare_classification,
    "generation": datasets.prepare_pairs,
    "summarization": datasets.prepare_pairs,
    "qa": datasets.prepare_qa,
}
COLLECTORS = {"web": web.scrape_to_documents, "book": web.book_documents}
READERS = {"csv": readers.read_csv, "json": readers.read_json, "parquet": readers.read_parquet, "txt": readers.read_text, "html": readers.read_html}


def choose(family: dict[str, object], name: str) -> object:
    """The operators of that name; add to a family by assigning to its dict."""
    if name not in family:
        raise ValueError(f"unknown {name!r}; known: {', '.join(sorted(family))}")
    return family[name]
