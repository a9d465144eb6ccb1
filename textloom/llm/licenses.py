"""License notices: fixed phrases, and an exact set-similarity join with license templates."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import utf8
from textloom.session import pin

# Fixed values of the contract: phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Opening sentences of well-known public licenses.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-line": "Released under the MIT License",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-line": "Licensed under the GNU General Public License",
    "cc-by-line": "Licensed under CC BY 4.0",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "rights-line": "All rights reserved",
}
LEAST_CONTAINMENT = 0.8
# Words are runs of ASCII letters, digits and bytes above 127; A-Z become a-z, all else a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def blocks_of(text: bytes) -> Iterator[bytes]:
    """The lines of a text, and its paragraphs where they have several lines."""
    for paragraph in re.split(rb"\n[ \t\r]*\n", text):
        lines = paragraph.split(b"\n")
        yield from lines
        if len(lines) > 1:
            yield paragraph


def needed(size: int, least: float) -> int:
    return math.ceil(least * size - 1e-9)


def token_frequencies(docs: DataFrame, tokens: set[bytes]) -> DataFrame:
    """(token, n): in how many blocks of the whole corpus each template word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column("text")):
                for block in blocks_of(text or b""):
                    counts.update(tokens.intersection(words_of(block)))
        yield pa.RecordBatch.from_pydict({"token": [t.decode() for t in counts], "n": list(counts.values())})

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scanned(docs: DataFrame, order: dict[bytes, int], rare: set[int], shortest: int) -> DataFrame:
    """Per document its word count, its phrase matches and its blocks that could contain a template.

    A block is given as the ranks of its template words; it is kept if it has ``shortest`` of them at
    least (length filter) and one that stands in a template's prefix (prefix filter).
    """
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
    vocabulary = set(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in utf8(batch.column("text")):
                text = text or b""
                plain = text.translate(WORDS)
                words = plain.split()
                places, labels = [], set()
                if b"license" in plain:
                    for at in (i for i, w in enumerate(words) if w == b"license"):
                        for phrase, label in phrases:
                            start = at - len(phrase) + 1
                            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                                places.append(start)
                                labels.add(label)
                blocks = []
                for block in blocks_of(text):
                    found = vocabulary.intersection(words_of(block))
                    if len(found) >= shortest:
                        ranks = sorted(order[w] for w in found)
                        if not rare.isdisjoint(ranks):
                            blocks.append(ranks)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
            )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>"
    return docs.mapInArrow(run, schema)


def contained(blocks: DataFrame, templates: list[tuple[str, list[int]]], least: float) -> DataFrame:
    """(row, label, share): every block and template whose containment is ``least`` at least.

    ``blocks(row, block, tokens)`` and the templates hold ranks in rising global frequency. Blocks meet
    templates on the words of a template's prefix; the first common word's places bound the overlap;
    what is left is intersected. The prefix index has a few rows per template: it is broadcast.
    """
    spark = blocks.sparkSession
    index = [
        (token, label, tokens, i, needed(len(tokens), least))
        for label, tokens in templates
        for i, token in enumerate(tokens[: len(tokens) - needed(len(tokens), least) + 1])
    ]
    table = spark.createDataFrame(index, "token int, label string, template array<int>, i int, needed int")
    words = blocks.select("row", "block", "tokens", F.posexplode("tokens").alias("j", "token"))
    pairs = words.join(F.broadcast(table), "token").filter(F.size("tokens") >= F.col("needed"))
    pairs = pairs.groupBy("row", "block", "label").agg(
        F.min(F.struct("i", "j")).alias("at"), F.first("tokens").alias("tokens"), F.first("template").alias("template"), F.first("needed").alias("needed")
    )
    bound = F.least(F.size("template") - F.col("at.i"), F.size("tokens") - F.col("at.j"))
    share = F.size(F.array_intersect("tokens", "template")) / F.size("template")
    return pairs.filter(bound >= F.col("needed")).select("row", "label", share.alias("share")).filter(F.col("share") * F.size("template") >= F.col("needed"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where a phrase's words follow each other. ``labels`` adds the templates that a line or
    paragraph contains: ``least`` of the template's different words stand in the block. ``score`` is 1
    with a base match, else the largest such share, else 0. Null and empty texts have no words and no
    labels. Repeated rows and null ids are rows like others; other columns are ignored.
    """
    templates = templates or TEMPLATES
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = {label: set(words_of(text.encode())) for label, text in templates.items()}
    tokens = set().union(*sets.values())
    # One row per template word.
    counts = {r["token"].encode(): r["n"] for r in token_frequencies(docs, tokens).collect()}
    order = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (counts.get(t, 0), t)))}
    ranked = [(label, sorted(order[t] for t in words)) for label, words in sets.items()]
    rare = {t for _, ts in ranked for t in ts[: len(ts) - needed(len(ts), least) + 1]}
    shortest = min(needed(len(ts), least) for _, ts in ranked)
    rows = pin(scanned(docs, order, rare, shortest).withColumn("row", F.monotonically_increasing_id()), "license-scan")
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "tokens"))
    found = contained(blocks, ranked, least).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = rows.drop("blocks").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
