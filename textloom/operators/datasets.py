"""Labels, splits, chunks, templates, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.ordering import head_split, row_batches, row_index

# The public instruction template and the end-of-sequence mark.
ALPACA = (
    "Below is an instruction that describes a task. Write a response that appropriately "
    "completes the request.\n\n### Instruction:\n%s\n\n### Response:\n%s"
)
QUESTION_ANSWER = "Question: %s\nAnswer: %s"
EOS = "</s>"


def short_preview(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def label_map(df: DataFrame, label: str) -> DataFrame:
    """(label, label_id): sorted distinct labels numbered from 0."""
    return row_index(df.select(label).distinct(), label).select(label, (F.col("row_index") - 1).alias("label_id"))


def map_labels(df: DataFrame, label: str, mapping: dict | None = None) -> DataFrame:
    """Add ``label_id`` from a given mapping (default 0) or from the sorted distinct labels."""
    if mapping:
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        return df.withColumn("label_id", F.coalesce(F.create_map(*pairs)[F.col(label)], F.lit(0)))
    ids = label_map(df, label).withColumnRenamed(label, "_label")
    return df.join(ids, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def prepare_classification(df: DataFrame, key: list[str], mapping: dict | None = None, ratio: float = 0.8) -> DataFrame:
    """(key..., split, text, label) with labels as numbers and a head split."""
    rows = map_labels(head_split(df, key, ratio), "label", mapping)
    return rows.select(*key, "split", "text", F.col("label_id").alias("label"))


def prepare_pairs(df: DataFrame, key: list[str], fields: list[str], ratio: float = 0.8) -> DataFrame:
    """Head split of any fixed set of text fields: generation, summarization."""
    return head_split(df, key, ratio).select(*key, "split", *fields)


def prepare_qa(df: DataFrame, key: list[str], ratio: float = 0.8) -> DataFrame:
    if "answer_start" not in df.columns:
        df = df.withColumn("answer_start", F.lit(0))
    return prepare_pairs(df, key, ["context", "question", "answer", "answer_start"], ratio)


def per_class_split(df: DataFrame, label: str, key: str, n: int = 4000) -> DataFrame:
    """First ``n`` rows of each class in key order are ``train``.

    Only the first n keys per class pass the group limit; the boundary key per class then flags
    the rows, so a large class is never sorted whole.
    """
    w = Window.partitionBy(label).orderBy(key)
    heads = df.select(label, key).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    bounds = heads.groupBy(F.col(label).alias("_label")).agg(F.max(key).alias("_last"))
    # Rows without a class are a class of their own.
    flagged = df.join(bounds, F.col(label).eqNullSafe(F.col("_label")), "left")
    return flagged.withColumn("split", F.when(F.col(key) <= F.col("_last"), "train").otherwise("test")).drop("_label", "_last")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Per label, ``floor(share * n)`` rows in a seeded pseudo-random order are ``test``.

    The order is a digest of seed and key. Narrow (label, digest) rows are ranked globally by
    range partitions, so a label with a third of the rows spreads over many tasks.
    """
    digest = F.md5(F.concat_ws("_", F.lit(seed), F.col(key)))
    ranked = row_index(df.select(label, digest.alias("_h")), label, "_h")
    per_label = ranked.groupBy(label).agg(F.min("row_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    cut = F.col("_first") + F.floor(F.col("_n") * F.lit(float(test_share))) - 1
    bounds = ranked.join(per_label, label).filter(F.col("row_index") == cut).select(label, F.col("_h").alias("_cut"))
    flagged = df.withColumn("_h", digest).join(bounds, label, "left")
    is_test = F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))
    return flagged.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_h", "_cut")


def chunk_documents(df: DataFrame, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Rows (…, chunk_no, chunk): fixed-size chunks that overlap, in one linear pass over the text.

    The text is cut into steps; a chunk is a step plus the head of the next one. A last step that
    lies inside the previous chunk is dropped. Empty text has no chunk.
    """
    step = size - overlap
    df = df.withColumn("_steps", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    steps = F.col("_steps")
    n = F.size(steps)
    tail_covered = (n > 1) & (F.length(F.element_at(steps, -1)) <= overlap)
    chunks = F.transform(
        steps,
        lambda s, i: F.concat(s, F.substring(F.coalesce(F.get(steps, i + 1), F.lit("")), 1, overlap)),
    )
    kept = F.slice(chunks, F.lit(1), F.greatest(n - F.when(tail_covered, 1).otherwise(0), F.lit(0)))
    others = [c for c in df.columns if c not in (text, "_steps")]
    return df.filter(n > 0).select(*others, F.posexplode(kept).alias("chunk_no", "chunk"))


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, input, output): every user turn answered by the assistant's next turn.

    An equi-join on (conversation, turn): no per-conversation sort, so one long conversation
    does not end up in one task.
    """
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"])


def format_instructions(turns: DataFrame, add_eos: bool = True) -> DataFrame:
    """Instruction and question-answer renderings of each user/assistant pair."""
    end = EOS if add_eos else ""
    return question_answer_pairs(turns).select(
        "conv_id",
        "turn",
        F.concat(F.format_string(ALPACA, "input", "output"), F.lit(end)).alias("instruction"),
        F.concat(F.format_string(QUESTION_ANSWER, "input", "output"), F.lit(end)).alias("qa"),
    )


def format_chats(turns: DataFrame, add_eos: bool = True) -> DataFrame:
    """(conv_id, chat): the turns of a conversation rendered in order. One output row is one conversation."""
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit(EOS if add_eos else ""))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return grouped.select("conv_id", F.array_join(F.col("lines.line"), "\n").alias("chat"))


def chunk_list(df: DataFrame, key: str, size: int) -> DataFrame:
    """(batch_id, items): keys in order, ``size`` per row."""
    batches = row_batches(df.select(key), [key], size)
    return batches.groupBy("batch_id").agg(F.array_sort(F.collect_list(key)).alias("items"))


def pad_truncate(ids: Column, max_length: int = 512, pad_id: int = 0) -> tuple[Column, Column]:
    """(input_ids, attention_mask), both exactly ``max_length`` long."""

    def fit(values: Column, fill: int) -> Column:
        return F.slice(F.concat(values, F.array_repeat(F.lit(fill), max_length)), 1, max_length)

    return fit(ids, pad_id), fit(F.transform(ids, lambda _: F.lit(1)), 0)


def pad_batch(df: DataFrame, key: str, ids: str, batch_size: int, pad_id: int = 0) -> DataFrame:
    """Add ``batch_id`` and ``padded``: ids padded to the longest row of their batch.

    Only (key, length) is ranked and shuffled by batch; the ids join back by key.
    """
    sized = df.select(key, F.size(ids).alias("_n"))
    batches = row_batches(sized, [key], batch_size)
    longest = batches.groupBy("batch_id").agg(F.max("_n").alias("_max"))
    plan = batches.join(longest, "batch_id").select(key, "batch_id", (F.col("_max") - F.col("_n")).alias("_fill"))
    fill = F.array_repeat(F.lit(pad_id), F.col("_fill"))
    return df.join(plan, key).withColumn("padded", F.concat(F.col(ids), fill)).drop("_fill")


def one_hot(index: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: (i == index).cast("int"))
