"""The row-wise part of the preprocessing chain on a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import clean as cl
from textloom.plans.preprocess import PreprocessConfig


def preprocess_stream(docs: DataFrame, config: PreprocessConfig, event_time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Clean a stream and drop texts already seen within the watermark.

    The state holds a 256-bit digest per text, not the text. Of equal texts the first to arrive
    stays; "earliest of all" needs the batch chain.
    """
    docs = cl.length_filter(docs, "content", config.min_doc_length, config.max_doc_length)
    docs = cl.normalize_whitespace(cl.clean(docs, config.clean_method))
    docs = docs.withWatermark(event_time, delay).withColumn("_digest", F.sha2("content_clean", 256))
    docs = docs.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
    return cl.extract_entities(docs) if config.extract_entities else docs
