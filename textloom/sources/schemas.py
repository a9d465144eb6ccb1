"""Schemas of the known inputs."""

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


TASKS = {
    "classification": T.StructType(_strings("text", "label")),
    "generation": T.StructType(_strings("input", "output")),
    "qa": T.StructType(_strings("context", "question", "answer") + [T.StructField("answer_start", T.IntegerType())]),
    "summarization": T.StructType(_strings("document", "summary")),
    "captioning": T.StructType(_strings("text", "label")),
}
