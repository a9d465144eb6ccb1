"""Named queries: sources and sinks, cleaning, de-duplication, entities."""

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import clean as cl
from textloom.operators import datasets as ds
from textloom.operators import dedup as dd
from textloom.operators import features as ft
from textloom.operators import joblog as jl
from textloom.plans import preprocess as pp
from textloom.plans.registry import query, table
from textloom.plans.sqltext import CLEAN_DOCS, CLEAN_TOKENS, WS, clean, in_list, squeeze, words
from textloom.session import fresh_path, spread
from textloom.sources import readers as rd
from textloom.sources import schemas
from textloom.sources import writers as wr


def documents(spark, sf):
    return spread(table(spark, sf, "documents").withColumnRenamed("text", "content"))


def cleaned(spark, sf):
    """(doc_id, lang, content, content_clean) of non-empty cleaned documents."""
    docs = documents(spark, sf).select("doc_id", "lang", "content")
    return cl.normalize_whitespace(cl.clean(docs))


# ---------------------------------------------------------------- sources and sinks

ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"


@query("read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def read_csv(spark, sf):
    path = fresh_path(spark, "orders-csv")
    wr.write_corpus(table(spark, sf, "orders").drop("o_orderdate"), path, "csv")
    return rd.read_csv(spark, path, ORDERS)


@query("read_json", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source, lang AS lang_tag FROM documents")
def read_json(spark, sf):
    path = fresh_path(spark, "documents-json")
    docs = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), "content", F.create_map(F.lit("lang"), "lang").alias("metadata"), "source"
    )
    wr.write_documents_json(docs, path)
    return rd.read_json(spark, path, schemas.DOCUMENT).select("id", "content", "source", F.col("metadata")["lang"].alias("lang_tag"))


@query(
    "read_parquet",
    "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1",
)
def read_parquet(spark, sf):
    lines = rd.read_parquet(spark, f"{sf}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity")
    )


def text_folder(spark, sf):
    path = fresh_path(spark, "documents-txt")
    table(spark, sf, "documents").select("text").write.text(path)
    return path


@query(
    "read_text",
    r"""SELECT content, COUNT(*) AS n
        FROM (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS content FROM documents) GROUP BY 1""",
)
def read_text(spark, sf):
    lines = rd.read_text(spark, text_folder(spark, sf))
    return lines.groupBy("content").agg(F.count(F.lit(1)).alias("n"))


@query(
    "load_corpus_texts",
    rf"""SELECT text, COUNT(*) AS n FROM (
           SELECT regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g') AS text
           FROM (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents))
         WHERE length(text) > 0 GROUP BY 1""",
)
def load_corpus_texts(spark, sf):
    lines = rd.load_corpus_texts(spark, text_folder(spark, sf))
    return lines.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("read_task_csv", "SELECT text, lang AS label FROM documents")
def read_task_csv(spark, sf):
    """Written with a further column and the label first; read by name."""
    path = fresh_path(spark, "task-csv")
    rows = table(spark, sf, "documents").select(F.col("lang").alias("label"), "doc_id", "text")
    wr.write_corpus(rows, path, "csv")
    return rd.read_task_csv(spark, path, "classification", escaped=True)


@query(
    "read_delimited_pairs",
    """SELECT n_name AS city1, r_name AS country1, CAST(n_nationkey AS VARCHAR) AS city2,
              CAST(r_regionkey AS VARCHAR) AS country2
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def read_delimited_pairs(spark, sf):
    path = fresh_path(spark, "pairs")
    pairs = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs.select("n_name", "r_name", "n_nationkey", "r_regionkey").write.csv(path, sep=" ")
    return rd.read_delimited_pairs(spark, path, ["city1", "country1", "city2", "country2"])


@query(
    "list_datasets",
    """SELECT 'supplier' AS name, true AS sized, COUNT(*) AS n FROM supplier
       UNION ALL SELECT 'nation', true, COUNT(*) FROM nation UNION ALL SELECT 'customer', true, COUNT(*) FROM customer""",
)
def list_datasets(spark, sf):
    """Three given tables written below one folder, listed, and counted through the listed paths."""
    root, names = fresh_path(spark, "datasets"), ("customer", "nation", "supplier")
    for name in names:
        table(spark, sf, name).write.parquet(f"{root}/{name}")
    found = rd.list_datasets(spark, root)
    counts = None
    for name in names:
        n = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return found.join(counts, "name").select("name", (F.col("size") > 0).alias("sized"), "n")


@query(
    "format_size",
    """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * l_orderkey * l_orderkey AS BIGINT) AS n FROM lineitem)
       SELECT l_orderkey, l_linenumber,
         CASE WHEN n < 1024 THEN printf('%.2f B', CAST(n AS DOUBLE))
              WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE)
              WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE)
              WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE)
              ELSE printf('%.2f TB', n / 1099511627776.0::DOUBLE) END AS shown
       FROM b""",
)
def format_size(spark, sf):
    # As a decimal: with larger keys the product leaves the 64-bit range.
    n = F.col("l_partkey").cast("decimal(38,0)") * F.col("l_orderkey") * F.col("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.format_size(n).alias("shown"))


@query(
    "write_corpus",
    " UNION ALL ".join(
        f"SELECT '{f}' AS format, doc_id, lang, text AS content FROM documents" for f in ("parquet", "csv", "json")
    ),
)
def write_corpus(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = fresh_path(spark, f"corpus-{fmt}")
        wr.write_corpus(docs, path, fmt)
        if fmt == "csv":
            back = rd.read_csv(spark, path, docs.schema, escaped=True)
        else:
            back = rd.read_parquet(spark, path) if fmt == "parquet" else rd.read_json(spark, path, docs.schema)
        back = back.select(F.lit(fmt).alias("format"), "doc_id", "lang", "content")
        out = back if out is None else out.unionByName(back)
    return out


@query("write_documents_json", "SELECT conv_id, turn, role, text FROM conversations")
def write_documents_json(spark, sf):
    path = fresh_path(spark, "conversations-json")
    turns = table(spark, sf, "conversations")
    wr.write_documents_json(turns, path)
    return rd.read_json(spark, path, turns.schema)


@query(
    "document_preview",
    """SELECT doc_id, substr(text, 1, 1000) || '...' AS preview,
              CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short_preview
       FROM documents""",
)
def document_preview(spark, sf):
    text = F.col("content")
    return documents(spark, sf).select(
        "doc_id",
        F.concat(F.substring(text, 1, 1000), F.lit("...")).alias("preview"),
        ds.short_preview(text).alias("short_preview"),
    )


# Pages that a task writes, about.
WRITTEN_PAGES = 1000


@query("read_html", "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages")
def read_html(spark, sf):
    """Pages written as one HTML file each and read back as whole files."""
    path = fresh_path(spark, "html")
    pages = table(spark, sf, "pages").select("page_id", "html")
    # A file costs far more than the bytes in it, so tasks are cut by pages; a scan has a task per stretch of bytes or row group.
    tasks = max(-(-pages.count() // WRITTEN_PAGES), spark.sparkContext.defaultParallelism)
    pages.repartition(tasks, "page_id").write.partitionBy("page_id").text(path)
    # The text writer ends every row with a line feed.
    pages = rd.read_html(spark, path).withColumn("html", F.regexp_replace("html", r"\n\z", ""))
    key = F.regexp_extract("url", r"page_id=(\d+)", 1).cast("bigint")
    return pages.select(key.alias("page_id"), F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("digest"))


@query("bounded_read", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def bounded_read(spark, sf):
    return rd.bounded_read(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 100)


# ---------------------------------------------------------------- cleaning


@query("clean_text", f"SELECT doc_id, {clean('text')} AS content_clean FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean_text(F.col("content")).alias("content_clean"))


@query("drop_empty", f"SELECT doc_id FROM documents WHERE length({clean('text')}) > 0")
def drop_empty(spark, sf):
    return cl.clean(documents(spark, sf)).select("doc_id")


@query("normalize_whitespace", f"WITH {CLEAN_DOCS} SELECT doc_id, content_clean FROM cleaned")
def normalize_whitespace(spark, sf):
    return cleaned(spark, sf).select("doc_id", "content_clean")


@query("length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 50 AND 10000")
def length_filter(spark, sf):
    return cl.length_filter(documents(spark, sf)).select("doc_id", "n_chars")


@query("language_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def language_filter(spark, sf):
    return cl.language_filter(documents(spark, sf), "en").select("doc_id", "source")


ADVANCED_BODY = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), "
    rf"'http[^{WS}]+|www[^{WS}]+|https[^{WS}]+', '', 'g'), '[@#][\p{{L}}\p{{N}}_]+', '', 'g'), "
    rf"'[^\p{{L}}\p{{N}}_{WS}]', ' ', 'g'), '\p{{Nd}}+', ' ', 'g')"
)


@query(
    "advanced_clean",
    f"""WITH w AS (SELECT doc_id, {words(ADVANCED_BODY)} AS ws FROM documents),
             k AS (SELECT doc_id, list_filter(ws, lambda x: length(x) > 2 AND x NOT IN ({in_list(tx.STOP_WORDS)})) AS ks FROM w)
        SELECT doc_id, array_to_string(ks, ' ') AS content_clean FROM k WHERE len(ks) > 0""",
)
def advanced_clean(spark, sf):
    return cl.clean(documents(spark, sf), "advanced").select("doc_id", "content_clean")


@query("strip_urls", rf"SELECT doc_id, regexp_replace(text, 'http[^{WS}]+|www[^{WS}]+|https[^{WS}]+', '', 'g') AS stripped FROM documents")
def strip_urls(spark, sf):
    return documents(spark, sf).select("doc_id", tx.strip_urls(F.col("content")).alias("stripped"))


@query("strip_mentions", r"SELECT doc_id, regexp_replace(text, '[@#][\p{L}\p{N}_]+', '', 'g') AS stripped FROM documents")
def strip_mentions(spark, sf):
    return documents(spark, sf).select("doc_id", tx.strip_mentions(F.col("content")).alias("stripped"))


@query(
    "strip_punct_digits",
    rf"SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_{WS}]', ' ', 'g'), '\p{{Nd}}+', ' ', 'g') AS stripped FROM documents",
)
def strip_punct_digits(spark, sf):
    return documents(spark, sf).select("doc_id", tx.blank_digits(tx.blank_punctuation(F.col("content"))).alias("stripped"))


@query(
    "strip_tweet_markup",
    rf"""SELECT conv_id, turn, replace(regexp_replace(regexp_replace('RT ' || text || ' #' || role, '^RT[{WS}]+', ''),
           'https?://[^{WS}]+', '', 'g'), '#', '') AS stripped FROM conversations""",
)
def strip_tweet_markup(spark, sf):
    posts = table(spark, sf, "conversations")
    marked = F.concat(F.lit("RT "), "text", F.lit(" #"), "role")
    return posts.select("conv_id", "turn", tx.strip_tweet_markup(marked).alias("stripped"))


@query(
    "remove_stopwords",
    f"""WITH {CLEAN_DOCS}
        SELECT doc_id, array_to_string(list_filter({words('content_clean')}, lambda x: x NOT IN ({in_list(tx.STOP_WORDS)})), ' ') AS kept
        FROM cleaned""",
)
def remove_stopwords(spark, sf):
    tokens = tx.words(F.col("content_clean"))
    return cleaned(spark, sf).select("doc_id", F.array_join(tx.drop_stop_words(tokens), " ").alias("kept"))


PUNCT_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r]')"


@query(
    "drop_punct_tokens",
    f"""SELECT doc_id, array_to_string(list_filter({PUNCT_TOKENS}, lambda x: NOT contains({in_list([tx.PUNCTUATION])}, x)), ' ') AS kept
        FROM documents""",
)
def drop_punct_tokens(spark, sf):
    tokens = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r]"), F.lit(0))
    return documents(spark, sf).select("doc_id", F.array_join(tx.drop_punctuation_tokens(tokens), " ").alias("kept"))


@query(
    "text_quality",
    rf"""WITH q AS (SELECT doc_id, text, CAST(length(text) AS DOUBLE) AS n,
             CAST(length(regexp_replace(text, '[\p{{L}}\p{{N}}{WS}]', '', 'g')) AS DOUBLE) AS special,
             {words('text')} AS ws FROM documents)
         SELECT doc_id, n >= 50 AND special / n <= 0.5 AND len(ws) > 0
                AND CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws) >= 0.1 AS good FROM q""",
)
def text_quality(spark, sf):
    return documents(spark, sf).select("doc_id", tx.text_quality(F.col("content")).alias("good"))


@query("require_columns", "SELECT lang AS label, COUNT(*) AS n FROM documents GROUP BY 1")
def require_columns(spark, sf):
    labelled = table(spark, sf, "documents").withColumnRenamed("lang", "label")
    return cl.require_columns(labelled, "text", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_violations",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN replace(props, '"k"', '"key"')
                         WHEN event_type = 'view' THEN replace(replace(props, ': ', ': "'), '}', '"}') ELSE props END AS p FROM events)
       SELECT event_id, 'Missing required field: k' AS violation FROM e WHERE json_extract(p, '$.k') IS NULL
       UNION ALL SELECT event_id, 'Field k must be integer' FROM e
       WHERE json_extract(p, '$.k') IS NOT NULL AND json_type(p, '$.k') NOT IN ('BIGINT', 'UBIGINT', 'BOOLEAN')""",
)
def schema_violations(spark, sf):
    """Errors lose their field and views carry text: both kinds of violation occur in every table."""
    renamed = F.replace("props", F.lit('"k"'), F.lit('"key"'))
    quoted = F.replace(F.replace("props", F.lit(": "), F.lit(': "')), F.lit("}"), F.lit('"}'))
    kind = F.col("event_type")
    props = F.when(kind == "error", renamed).when(kind == "view", quoted).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", props.alias("p"))
    return cl.schema_violations(rows, "p", ["k"], {"k": "integer"}).select("event_id", "violation")


# ---------------------------------------------------------------- de-duplication

DEDUPED = CLEAN_DOCS + """,
  deduped AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_clean ORDER BY doc_id) AS rn FROM cleaned) WHERE rn = 1
  )"""


@query("exact_dedup", f"WITH {DEDUPED} SELECT doc_id, content_clean FROM deduped")
def exact_dedup(spark, sf):
    docs = cleaned(spark, sf).select("doc_id", "content_clean")
    return dd.exact_dedup(docs, "content_clean", ("doc_id",))


@query(
    "first_row_per_key",
    """SELECT user_id, event_id, event_type, value FROM
         (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def first_row_per_key(spark, sf):
    events = table(spark, sf, "events")
    return dd.first_row_per_key(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


SHINGLE_SETS = """
  chars AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
  s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4])) AS s
        FROM chars)"""


@query(
    "shingles",
    f"""WITH {SHINGLE_SETS}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM s""",
)
def shingles(spark, sf):
    s = tx.shingles(F.col("content"))
    return documents(spark, sf).select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest")
    )


# Exact pairs: two sets with Jaccard >= t share one of the rarest n - ceil(t n) + 1 shingles of each.
NEAR_PAIRS = f"""{SHINGLE_SETS},
  z AS (SELECT doc_id, s, len(s) AS n FROM s WHERE len(s) > 0),
  e AS (SELECT doc_id, n, unnest(s) AS g FROM z),
  f AS (SELECT g, COUNT(*) AS df FROM e GROUP BY g),
  r AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS rk FROM e JOIN f USING (g)),
  rare AS (SELECT doc_id, n, g FROM r WHERE rk <= n - ceil(0.9 * n) + 1),
  c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y
        ON x.g = y.g AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.9 * greatest(x.n, y.n)),
  p AS (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.s, y.s)) AS common
        FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b),
  pairs AS (SELECT a, b, CAST(common AS DOUBLE) / (n - common) AS jaccard FROM p
            WHERE CAST(common AS DOUBLE) / (n - common) >= 0.9)"""


@query(
    "near_dup_pairs",
    f"""WITH {NEAR_PAIRS}
        SELECT b AS doc_id, min(a) AS partner, round(arg_min(jaccard, a), 6) AS jaccard FROM pairs GROUP BY b""",
)
def near_dup_pairs(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return dd.near_dup_links(docs, "doc_id", "text").withColumn("jaccard", F.round("jaccard", 6))


@query(
    "near_dup_dedup",
    f"""WITH RECURSIVE {NEAR_PAIRS},
          both_ways AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
          reach AS (SELECT x, x AS r FROM both_ways UNION SELECT e.y, reach.r FROM reach JOIN both_ways e ON e.x = reach.x),
          low AS (SELECT x, min(r) AS r FROM reach GROUP BY x),
          firsts AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)
        SELECT doc_id FROM firsts WHERE doc_id NOT IN (SELECT x FROM low WHERE r < x)""",
)
def near_dup_dedup(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return dd.near_dup_dedup(docs, "doc_id", "text").select("doc_id")


@query("distinct_count", f"WITH {CLEAN_DOCS} SELECT COUNT(DISTINCT content_clean) AS n FROM cleaned")
def distinct_count(spark, sf):
    # Distinct 256-bit digests: the shuffle carries 32 bytes per text, not the text.
    digests = cleaned(spark, sf).select(F.unhex(F.sha2("content_clean", 256)).alias("h")).distinct()
    return digests.agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- the preprocessing chain

CHAIN = f"""
  cleaned AS (SELECT doc_id, lang, text, {squeeze(clean('text'))} AS content_clean FROM documents
              WHERE length(text) BETWEEN 50 AND 10000 AND length({clean('text')}) > 0),
  deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_clean ORDER BY doc_id) AS rn FROM cleaned) WHERE rn = 1)"""

ENTITIES = (
    r"list_slice(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), "
    r"lambda w: regexp_full_match(w, '[A-Z][a-z]+')), 1, 10)"
)

DOC_CONFIG = pp.PreprocessConfig(id_col="doc_id", order=("doc_id",))


@query("preprocess", f"WITH {CHAIN} SELECT doc_id, content_clean, unnest(list_distinct({ENTITIES})) AS entity FROM deduped")
def preprocess(spark, sf):
    return pp.preprocess(documents(spark, sf), DOC_CONFIG).select("doc_id", "content_clean", "entity")


@query(
    "preprocess_stats",
    f"""WITH {CHAIN}
        SELECT (SELECT COUNT(*) FROM documents) AS original_count, (SELECT COUNT(*) FROM cleaned) AS cleaned_count,
               COUNT(*) AS deduped_count, CAST(SUM(len(list_distinct({ENTITIES}))) AS BIGINT) AS entity_count FROM deduped""",
)
def preprocess_stats(spark, sf):
    return jl.preprocess_stats(documents(spark, sf), DOC_CONFIG)


@query(
    "job_metrics",
    f"""WITH {CHAIN}, n AS (SELECT (SELECT COUNT(*) FROM documents) AS i, (SELECT COUNT(*) FROM deduped) AS o)
        SELECT i AS input_rows, o AS output_rows, i - o AS removed_rows, round(CAST(i - o AS DOUBLE) / i, 6) AS compression_ratio FROM n""",
)
def job_metrics(spark, sf):
    return jl.job_metrics(documents(spark, sf), pp.preprocess(documents(spark, sf), pp.PreprocessConfig(
        extract_entities=False, id_col="doc_id", order=("doc_id",))))


@query(
    "validate_nonempty",
    f"""WITH {CHAIN} SELECT 'original' AS step, COUNT(*) AS row_count FROM documents UNION ALL SELECT 'cleaned', COUNT(*) FROM cleaned
        UNION ALL SELECT 'deduped', COUNT(*) FROM deduped
        UNION ALL SELECT 'entities', CAST(SUM(len(list_distinct({ENTITIES}))) AS BIGINT) FROM deduped""",
)
def validate_nonempty(spark, sf):
    """Runs the chain once into the shared folder and reports the observed counters."""
    source, target = fresh_path(spark, "documents"), fresh_path(spark, "processed")
    wr.write_corpus(documents(spark, sf), source)
    counts = pp.run_preprocess(spark, source, target, DOC_CONFIG)
    steps = ["original", "cleaned", "deduped", "entities"]
    return spark.createDataFrame([(s, counts[s]) for s in steps], "step string, row_count bigint")


# ---------------------------------------------------------------- entities and keywords


@query("extract_entities", f"SELECT doc_id, array_to_string(list_sort(list_distinct({ENTITIES})), ',') AS entities FROM documents")
def extract_entities(spark, sf):
    found = cl.extract_entities(documents(spark, sf))
    return found.select("doc_id", F.array_join(F.array_sort("entities"), ",").alias("entities"))


@query("explode_entities", f"SELECT doc_id, unnest(list_distinct({ENTITIES})) AS entity FROM documents")
def explode_entities(spark, sf):
    return cl.explode_entities(cl.extract_entities(documents(spark, sf))).select("doc_id", "entity")


@query("entity_row_count", f"SELECT CAST(SUM(len(list_distinct({ENTITIES}))) AS BIGINT) AS n FROM documents")
def entity_row_count(spark, sf):
    return cl.extract_entities(documents(spark, sf)).agg(F.sum(F.size("entities")).alias("n"))
