"""Secrets in texts: fixed patterns, and random strings told from identifiers by Markov models.

Column expressions only; nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.textspans import Kind, clear, let, proposals, replaced

# Fixed values of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
# A run that could be a random string.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
CODES = 128
# The labelled samples: identifiers come from the words of this many documents, random strings from this many digests.
SAMPLE_DOCUMENTS = 2000
RANDOM_STRINGS = 4000
# Log-likelihood ratio from which a run counts as random.
LEAST_RATIO = 12.0


def pair_codes(value: Column) -> Column:
    """The neighbouring characters of an ASCII string, each pair as one number."""
    return let(
        F.split(value, ""),
        lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.ascii(a) * CODES + F.ascii(b)),
    )


def labelled_strings(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, strings: int = RANDOM_STRINGS) -> DataFrame:
    """(random, value): digests written in hexadecimal, base 64 and base 36, and ordinary words.

    The words are those of the documents whose doc_id has the smallest hashes, without texts that a
    fixed pattern matches. Both numbers bound the sample at any corpus size.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    base36 = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 36), 9, "0") for i in range(4)])
    made = spark.range(strings).select(F.explode(F.array(digest, F.translate(F.base64(F.unhex(digest)), "=", ""), base36)).alias("value"))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    texts = texts.filter(~(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("value")).distinct()
    return made.select(F.lit(True).alias("random"), "value").unionByName(words.select(F.lit(False).alias("random"), "value"))


def markov_ratios(labelled: DataFrame) -> DataFrame:
    """One row ``ratios``: per character pair, log of its transition's chance in random strings over that in identifiers."""
    spark = labelled.sparkSession
    pairs = labelled.select("random", F.explode(pair_codes(F.col("value"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    grid = spark.range(CODES * CODES).select(F.col("id").cast("int").alias("pair")).join(counts, "pair", "left").fillna(0)
    row = Window.partitionBy(F.floor(F.col("pair") / CODES))
    chance = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(row) + 0.5 * 66)
    ratio = grid.select("pair", F.log(chance("r") / chance("o")).alias("ratio"))
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def fitted(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, strings: int = RANDOM_STRINGS) -> list[float]:
    """The ratios: CODES * CODES numbers at any corpus size."""
    return markov_ratios(labelled_strings(docs, documents, strings)).first()["ratios"]


def secret_spans(docs: DataFrame, model: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``found``: array<struct<start, kind, end>> in text order (kind: number in KINDS).

    Fixed kinds: leftmost matches per kind, code points, end exclusive. A markov span is a run of 16
    characters or more whose ratio over all its pairs is ``least`` at least and that no fixed span overlaps.
    Null and empty texts have none. A column ``found`` of the input is replaced; others stay.
    """
    # One constant; an array of literals would be thousands of expressions.
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    long_value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 1)) >= 6
    kinds = [
        Kind(0, ASSIGN, long_value, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))),
        Kind(1, ACCESS, hint=F.contains(text, F.lit("AKIA"))),
        Kind(2, HEX),
        Kind(3, CANDIDATE),
    ]
    rows = docs.drop("found").withColumn("found", proposals(text, kinds))
    rows = rows.withColumn("found", clear(F.col("found"), lambda x: F.when(x["kind"] < 3, 0).otherwise(1), 2))
    score = lambda v: F.aggregate(pair_codes(v), F.lit(0.0), lambda s, p: s + F.get(ratios, p))
    return rows.withColumn("found", F.transform(F.filter("found", lambda x: (x["kind"] < 3) | (score(x["found"]) >= least)), lambda x: x.dropFields("found")))


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def without_secrets(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    return replaced(text, found, mark)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. See ``secret_spans``."""
    rows = secret_spans(docs.select("doc_id", "text"), fitted(docs))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )
