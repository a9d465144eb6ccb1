"""Named queries: splits, joins, class frequencies, Naive Bayes, features, classical models."""

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import clean as cl
from textloom.operators import datasets as ds
from textloom.operators import features as ft
from textloom.operators import models as ml
from textloom.operators import naive_bayes as nb
from textloom.operators import vocab as vc
from textloom.operators.skew import lookup
from textloom.plans.catalog_corpus import cleaned, documents
from textloom.plans.catalog_tokens import FREQ_VOCAB, clean_words
from textloom.plans.registry import query, table
from textloom.plans.sqltext import CLEAN_DOCS, CLEAN_TOKENS, clean, in_list, squeeze, words
from textloom.session import pin, spread

# ---------------------------------------------------------------- labels and splits


def corpus(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))


LABELS = "l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM documents))"
CUT = "floor((SELECT COUNT(*) FROM {}) * 0.8::DOUBLE)"
DOC_SPLIT = f"CASE WHEN row_number() OVER (ORDER BY doc_id) <= {CUT.format('documents')} THEN 'train' ELSE 'eval' END"


@query("label_map", f"WITH {LABELS} SELECT lang AS label, label_id FROM l")
def label_map(spark, sf):
    return ds.label_map(corpus(spark, sf), "label")


CLASSIFICATION = f"WITH {LABELS} SELECT doc_id, {DOC_SPLIT} AS split, text, label_id AS label FROM documents JOIN l USING (lang)"


@query("prepare_classification", CLASSIFICATION)
def prepare_classification(spark, sf):
    return ds.prepare_classification(corpus(spark, sf), ["doc_id"])


@query("prepare_captioning", CLASSIFICATION.replace("label_id AS label", "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS label"))
def prepare_captioning(spark, sf):
    """The classification preparation with a given label mapping; unknown labels are 0."""
    return ds.prepare_classification(corpus(spark, sf), ["doc_id"], {"en": 1, "fr": 2})


QA_PAIRS = """
  qa AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u JOIN conversations a
         ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""
TURN_SPLIT = f"CASE WHEN row_number() OVER (ORDER BY conv_id, turn) <= {CUT.format('qa')} THEN 'train' ELSE 'eval' END"


def turn_pairs(spark, sf):
    return ds.question_answer_pairs(table(spark, sf, "conversations"))


@query("prepare_generation", f"WITH {QA_PAIRS} SELECT conv_id, turn, {TURN_SPLIT} AS split, input, output FROM qa")
def prepare_generation(spark, sf):
    return ds.prepare_pairs(turn_pairs(spark, sf), ["conv_id", "turn"], ["input", "output"])


@query(
    "prepare_qa",
    f"""WITH {QA_PAIRS} SELECT conv_id, turn, {TURN_SPLIT} AS split, output AS context, input AS question,
               split_part(output, '.', 1) AS answer, 0 AS answer_start FROM qa""",
)
def prepare_qa(spark, sf):
    rows = turn_pairs(spark, sf).select(
        "conv_id", "turn", F.col("output").alias("context"), F.col("input").alias("question"),
        F.split_part("output", F.lit("."), F.lit(1)).alias("answer"),
    )
    return ds.prepare_qa(rows, ["conv_id", "turn"])


@query("prepare_summarization", f"SELECT doc_id, {DOC_SPLIT} AS split, text AS document, split_part(text, chr(10), 1) AS summary FROM documents")
def prepare_summarization(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("document"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("summary")
    )
    return ds.prepare_pairs(rows, ["doc_id"], ["document", "summary"])


@query("head_split", f"SELECT doc_id, lang, {DOC_SPLIT} AS split FROM documents")
def head_split(spark, sf):
    return ds.head_split(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])


@query(
    "per_class_split",
    """SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 4000 THEN 'train' ELSE 'test' END AS split
       FROM labels""",
)
def per_class_split(spark, sf):
    return ds.per_class_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    "stratified_split",
    """SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42_' || doc_id))
              <= floor(COUNT(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM labels""",
)
def stratified_split(spark, sf):
    return ds.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    "chunk_documents",
    """WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
            c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((n - 512) / 462.0), 0) AS BIGINT) + 1)) AS chunk_no FROM t)
       SELECT doc_id, chunk_no, substr(text, chunk_no * 462 + 1, 512) AS chunk FROM c""",
)
def chunk_documents(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return ds.chunk_documents(docs, "text").withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def _template(text: str) -> str:
    parts = text.replace("'", "''").split("%s")
    return f"'{parts[0]}' || input || '{parts[1]}' || output || '{parts[2]}' || '{ds.EOS}'"


@query(
    "format_instructions",
    f"WITH {QA_PAIRS} SELECT conv_id, turn, {_template(ds.ALPACA)} AS instruction, {_template(ds.QUESTION_ANSWER)} AS qa FROM qa",
)
def format_instructions(spark, sf):
    return ds.format_instructions(table(spark, sf, "conversations"))


@query(
    "format_chats",
    f"""SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '{ds.EOS}', chr(10) ORDER BY turn) AS chat
        FROM conversations GROUP BY 1""",
)
def format_chats(spark, sf):
    return ds.format_chats(table(spark, sf, "conversations"))


@query(
    "chunk_list",
    """SELECT (rn - 1) // 100 AS batch_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS items
       FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""",
)
def chunk_list(spark, sf):
    lists = ds.chunk_list(table(spark, sf, "documents"), "doc_id", 100)
    return lists.select("batch_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


# ---------------------------------------------------------------- labelled words

STOPPED = f"list_filter({words('content_clean')}, lambda x: x NOT IN ({in_list(tx.STOP_WORDS)}))"

LABELLED = f"""{CLEAN_DOCS},
  lab AS (SELECT c.doc_id, quality AS label, {STOPPED} AS tokens FROM cleaned c JOIN labels USING (doc_id)),
  lt AS (SELECT doc_id, label, unnest(tokens) AS word FROM lab),
  freqs AS (SELECT word, label, COUNT(*) AS n FROM lt GROUP BY 1, 2),
  pn AS (SELECT word, CAST(SUM(CASE WHEN label = 1 THEN n ELSE 0 END) AS BIGINT) AS positive,
                CAST(SUM(CASE WHEN label = 0 THEN n ELSE 0 END) AS BIGINT) AS negative FROM freqs GROUP BY word)"""


def labelled(spark, sf):
    """(doc_id, label, tokens): labelled documents without stop words."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = documents(spark, sf).select("doc_id", "content").join(labels, "doc_id")
    docs = cl.normalize_whitespace(cl.clean(docs))
    return docs.select("doc_id", "label", tx.drop_stop_words(tx.words(F.col("content_clean"))).alias("tokens"))


def freqs(spark, sf):
    return nb.class_word_freqs(labelled(spark, sf), F.col("tokens"), "label")


@query("class_word_freqs", f"WITH {LABELLED} SELECT word, label, n FROM freqs")
def class_word_freqs(spark, sf):
    return freqs(spark, sf)


@query(
    "word_pos_neg_table",
    f"WITH {LABELLED} SELECT word, positive, negative, round(ln(positive + 1), 6) AS log_pos, round(ln(negative + 1), 6) AS log_neg FROM pn",
)
def word_pos_neg_table(spark, sf):
    t = nb.word_pos_neg_table(freqs(spark, sf))
    return t.withColumns({c: F.round(c, 6) for c in ("log_pos", "log_neg")})


RATIO = "CAST(positive + 1 AS DOUBLE) / (negative + 1)"


@query("pos_neg_ratio", f"WITH {LABELLED} SELECT word, positive, negative, round({RATIO}, 6) AS ratio FROM pn")
def pos_neg_ratio(spark, sf):
    return nb.pos_neg(freqs(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(
    "words_by_threshold",
    f"""WITH {LABELLED} SELECT 1 AS label, word, round({RATIO}, 6) AS ratio FROM pn WHERE {RATIO} >= 10
        UNION ALL SELECT 0, word, round({RATIO}, 6) FROM pn WHERE {RATIO} <= 0.5""",
)
def words_by_threshold(spark, sf):
    counts = freqs(spark, sf)
    high = nb.words_by_threshold(counts, 1, 10).select(F.lit(1).alias("label"), "word", "ratio")
    low = nb.words_by_threshold(counts, 0, 0.5).select(F.lit(0).alias("label"), "word", "ratio")
    return high.unionByName(low).withColumn("ratio", F.round("ratio", 6))


# ---------------------------------------------------------------- joins

TOKEN_COUNTS = f"{LABELLED}, dw AS (SELECT doc_id, word, COUNT(*) AS c FROM lt GROUP BY 1, 2)"


def labelled_words(spark, sf):
    return nb.doc_words(labelled(spark, sf), "doc_id", F.col("tokens"))


@query(
    "lookup_join",
    f"""WITH {TOKEN_COUNTS} SELECT doc_id, word, c, COALESCE(f.n, 0) AS freq FROM dw
        LEFT JOIN (SELECT * FROM freqs WHERE label = 0) f USING (word)""",
)
def lookup_join(spark, sf):
    """Words of each document with their count in class 0, 0 when never seen there."""
    all_counts = pin(freqs(spark, sf), "word-classes")
    negative = all_counts.filter("label = 0").select("word", F.col("n").alias("freq"))
    # Hot words are those of either class: the counts are of the many side.
    uses = all_counts.groupBy("word").agg(F.sum("n").alias("n"))
    joined = lookup(labelled_words(spark, sf), negative, "word", counts=uses, how="left")
    return joined.select("doc_id", "word", "c", F.coalesce("freq", F.lit(0)).alias("freq"))


@query(
    "vocab_semi_join",
    f"WITH {TOKEN_COUNTS} SELECT doc_id, word, c FROM dw WHERE word IN (SELECT word FROM pn WHERE positive + negative >= 5)",
)
def vocab_semi_join(spark, sf):
    known = pin(nb.pos_neg(freqs(spark, sf)).filter("positive + negative >= 5").selectExpr("word", "positive + negative AS n"), "known-words")
    # One row per word on the right: an inner lookup is the semi join, with hot words spread.
    return lookup(labelled_words(spark, sf), known.select("word"), "word", counts=known).select("doc_id", "word", "c")


@query(
    "stopword_anti_join",
    f"""WITH {CLEAN_TOKENS} SELECT doc_id, word, COUNT(*) AS c FROM toks
        WHERE word NOT IN ({in_list(tx.STOP_WORDS)}) GROUP BY 1, 2""",
)
def stopword_anti_join(spark, sf):
    """The stop-word list has a fixed length, so it is shipped to every task."""
    stop = spark.createDataFrame([(w,) for w in tx.STOP_WORDS], "word string")
    tokens = nb.doc_words(cleaned(spark, sf), "doc_id", clean_words())
    return tokens.join(F.broadcast(stop), "word", "left_anti").select("doc_id", "word", "c")


@query("pair_by_key", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def pair_by_key(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id")


SKIPGRAMS = f"""{FREQ_VOCAB},
  sg AS (SELECT v.id AS target, w.id AS context FROM toks a JOIN toks b
         ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - {{0}} AND a.pos + {{0}} AND a.pos <> b.pos
         JOIN fv v ON v.word = a.word JOIN fv w ON w.word = b.word)"""


SKIPGRAMS_2, SKIPGRAMS_5 = (SKIPGRAMS.replace("{0}", w) for w in ("2", "5"))


def skipgrams(spark, sf, window):
    docs = cleaned(spark, sf)
    vocab = vc.min_freq_vocab(docs, "doc_id", clean_words())
    return ft.skipgram_pairs(docs, clean_words(), vocab, window)


@query("window_range_join", f"WITH {SKIPGRAMS_2} SELECT target, context, COUNT(*) AS n FROM sg GROUP BY 1, 2")
def window_range_join(spark, sf):
    return skipgrams(spark, sf, 2)


@query(
    "skipgram_pairs",
    f"""WITH {SKIPGRAMS_5} SELECT target, COUNT(*) AS n_pairs, COUNT(DISTINCT context) AS n_contexts,
               CAST(SUM(context) AS BIGINT) AS context_sum FROM sg GROUP BY 1""",
)
def skipgram_pairs(spark, sf):
    """The pairs of every target word, summarised per target."""
    return skipgrams(spark, sf, 5).groupBy("target").agg(
        F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_contexts"), F.sum(F.col("n") * F.col("context")).alias("context_sum")
    )


# ---------------------------------------------------------------- Naive Bayes and logistic features

NB = f"""{LABELLED},
  t AS (SELECT COUNT(*) AS v, SUM(positive) AS np, SUM(negative) AS nn FROM pn),
  m AS (SELECT word, positive + negative AS n,
               ln((CAST(positive + 1 AS DOUBLE) / (np + v)) / (CAST(negative + 1 AS DOUBLE) / (nn + v))) AS ll FROM pn, t),
  pr AS (SELECT ln(CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END)) AS p FROM lab),
  sums AS (SELECT doc_id, SUM(ll) AS s FROM lt JOIN m USING (word) GROUP BY doc_id),
  scored AS (SELECT lab.doc_id, label, (SELECT p FROM pr) + COALESCE(s, 0) AS score FROM lab LEFT JOIN sums USING (doc_id))"""


@query("nb_train", f"WITH {NB} SELECT word, n, round(ll, 6) AS loglikelihood, round(p, 6) AS logprior FROM m, pr")
def nb_train(spark, sf):
    model = nb.nb_train(labelled(spark, sf), F.col("tokens"), "label")
    return model.withColumns({c: F.round(c, 6) for c in ("loglikelihood", "logprior")})


def nb_scored(spark, sf):
    docs = pin(labelled(spark, sf), "labelled")
    model = pin(nb.nb_train(docs, F.col("tokens"), "label"), "nb-model")
    return docs.select("doc_id", "label").join(nb.nb_predict(docs, "doc_id", F.col("tokens"), model), "doc_id")


@query("nb_predict", f"WITH {NB} SELECT doc_id, round(score, 6) AS score FROM scored")
def nb_predict(spark, sf):
    return nb_scored(spark, sf).select("doc_id", F.round("score", 6).alias("score"))


@query("nb_accuracy", f"WITH {NB} SELECT 1 - avg(abs(CASE WHEN score > 0 THEN 1 ELSE 0 END - label)) AS accuracy FROM scored")
def nb_accuracy(spark, sf):
    return nb.nb_accuracy(nb_scored(spark, sf), "label")


@query("nb_errors", f"WITH {NB} SELECT doc_id, label, round(score, 6) AS score FROM scored WHERE label <> CASE WHEN score > 0 THEN 1 ELSE 0 END")
def nb_errors(spark, sf):
    return nb.nb_errors(nb_scored(spark, sf), "label").withColumn("score", F.round("score", 6))


FREQ_FEATURES = f"""{LABELLED},
  ff AS (SELECT lab.doc_id, label, 1.0::DOUBLE AS x0, CAST(COALESCE(SUM(positive), 0) AS DOUBLE) AS x1, CAST(COALESCE(SUM(negative), 0) AS DOUBLE) AS x2
         FROM lab LEFT JOIN lt USING (doc_id, label) LEFT JOIN pn USING (word) GROUP BY 1, 2)"""


def feature_rows(spark, sf):
    docs = pin(labelled(spark, sf), "labelled")
    counts = nb.class_word_freqs(docs, F.col("tokens"), "label")
    return docs.select("doc_id", "label").join(nb.freq_features(docs, "doc_id", F.col("tokens"), counts), "doc_id")


@query("freq_features", f"WITH {FREQ_FEATURES} SELECT doc_id, x0, x1, x2 FROM ff")
def freq_features(spark, sf):
    return feature_rows(spark, sf).drop("label")


XS = ["x0", "x1", "x2"]


ALPHA, STEPS = 1e-9, 1500
# Each step is a row made from the one before; the cost is that of the theta before the last step.
GRADIENT_STEPS = "WITH RECURSIVE " + FREQ_FEATURES.replace("ff AS (", "ff AS MATERIALIZED (").strip() + f""",
  st AS (SELECT 0 AS it, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS cost UNION ALL
    SELECT it + 1, a0 - {ALPHA}::DOUBLE * avg(x0 * (h - label)), a1 - {ALPHA}::DOUBLE * avg(x1 * (h - label)), a2 - {ALPHA}::DOUBLE * avg(x2 * (h - label)),
           avg(greatest(z, 0) - label * z + ln(1 + exp(-abs(z))))
    FROM (SELECT *, 1 / (1 + exp(-z)) AS h FROM (SELECT st.*, ff.x0, ff.x1, ff.x2, ff.label, a0 * x0 + a1 * x1 + a2 * x2 AS z FROM st, ff WHERE it < {STEPS}))
    GROUP BY it, a0, a1, a2),
  th AS (SELECT a0, a1, a2, cost FROM st WHERE it = {STEPS})"""


@query(
    "gd_logistic",
    f"""{GRADIENT_STEPS} SELECT 'cost' AS name, round(cost, 6) AS value FROM th
        UNION ALL SELECT 'theta0', round(a0 * 1e6, 3) FROM th UNION ALL SELECT 'theta1', round(a1 * 1e6, 3) FROM th
        UNION ALL SELECT 'theta2', round(a2 * 1e6, 3) FROM th""",
)
def gd_logistic(spark, sf):
    """The cost, and the coefficients in millionths."""
    cost, theta = nb.gd_logistic(feature_rows(spark, sf), XS, "label", ALPHA, STEPS)
    rows = [("cost", round(cost, 6))] + [(f"theta{i}", round(t * 1e6, 3)) for i, t in enumerate(theta)]
    return spark.createDataFrame(rows, "name string, value double")


@query(
    "logistic_predict",
    f"""{GRADIENT_STEPS} SELECT doc_id, label, round(1 / (1 + exp(-(a0 * x0 + a1 * x1 + a2 * x2))), 6) AS probability,
               CASE WHEN 1 / (1 + exp(-(a0 * x0 + a1 * x1 + a2 * x2))) > 0.5 THEN 1 ELSE 0 END AS predicted FROM ff, th""",
)
def logistic_predict(spark, sf):
    rows = pin(feature_rows(spark, sf), "features")
    _, theta = nb.gd_logistic(rows, XS, "label", ALPHA, STEPS)
    scored = nb.logistic_predict(rows, XS, theta)
    return scored.select("doc_id", "label", F.round("probability", 6).alias("probability"), "predicted")


# ---------------------------------------------------------------- term weights

GRAMS = r"""
  tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM documents),
  grams AS (SELECT doc_id, unnest({grams}) AS term FROM tk),
  tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM grams GROUP BY 1, 2),
  nd AS (SELECT COUNT(*) AS n FROM documents),
  kept AS (SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM tf, nd GROUP BY term, n
           HAVING COUNT(*) >= 5 AND COUNT(*) <= n * 0.7::DOUBLE ORDER BY total DESC, term LIMIT {size})"""
ONE_TWO = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"

TFIDF = GRAMS.format(grams=ONE_TWO, size=5000) + """,
  raw AS (SELECT doc_id, term, tf, tf * (ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term), nd),
  tfidf AS (SELECT doc_id, term, tf, w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def weights(spark, sf):
    return ft.tfidf(documents(spark, sf), "doc_id", "content")


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM tfidf")
def tfidf(spark, sf):
    return weights(spark, sf).withColumn("weight", F.round("weight", 6))


TOP_TERMS = f"""WITH {TFIDF}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM tfidf)
  SELECT doc_id, rank, term, round(weight, 6) AS weight FROM rk WHERE rank <= 10"""


@query("top_terms_per_doc", TOP_TERMS)
def top_terms_per_doc(spark, sf):
    return ft.top_terms(weights(spark, sf), "doc_id", 10).withColumn("weight", F.round("weight", 6))


@query(
    "topic_keywords",
    f"""SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS keywords FROM ({TOP_TERMS}) WHERE rank <= 5 GROUP BY doc_id""",
)
def topic_keywords(spark, sf):
    top = ft.top_terms(weights(spark, sf), "doc_id", 5)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy("doc_id").agg(ordered.alias("k")).select("doc_id", F.array_join("k.term", ",").alias("keywords"))


COUNTS = GRAMS.format(grams=f"list_filter(t, lambda x: x NOT IN ({in_list(tx.STOP_WORDS)}))", size=2000)


@query("count_matrix", f"WITH {COUNTS} SELECT doc_id, term, tf FROM tf JOIN kept USING (term)")
def count_matrix(spark, sf):
    return ft.count_matrix(documents(spark, sf), "doc_id", "content")


# ---------------------------------------------------------------- vectors as features


def embeddings(spark, sf):
    return table(spark, sf, "embeddings")


@query("dominant_topic", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS topic FROM embeddings")
def dominant_topic(spark, sf):
    return embeddings(spark, sf).select("vec_id", ml.argmax(F.col("embedding")).alias("topic"))


@query(
    "sentence_vector",
    """WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
       SELECT label, i, round(SUM(x), 5) AS x FROM d GROUP BY 1, 2""",
)
def sentence_vector(spark, sf):
    sums = ft.sum_vectors(embeddings(spark, sf), "label", "embedding")
    return sums.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


@query(
    "hstack_features",
    """SELECT doc_id, array_to_string(list_transform([CAST(n_chars AS DOUBLE), quality, toxic], lambda x: printf('%.1f', x)), ' ')
              || ' ' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ' ') AS features
       FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id""",
)
def hstack_features(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.join(embeddings(spark, sf).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    stacked = ml.hstack(rows, ["n_chars", "quality", "toxic"], ["embedding"])
    values = ml.as_array(F.col("features"))
    shown = F.transform(values, lambda x, i: F.when(i < 3, F.format_string("%.1f", x)).otherwise(F.format_string("%.6f", x)))
    return stacked.select("doc_id", F.array_join(shown, " ").alias("features"))


@query("lda_topics")
def lda_topics(spark, sf):
    model = ml.lda_fit(ml.count_vectors(documents(spark, sf), "doc_id", "content"), 10)
    return ml.doc_topics(model).select("doc_id", F.round("topic_weight", 6).alias("topic_weight"), "topic")


@query("topic_top_words")
def topic_top_words(spark, sf):
    model = ml.lda_fit(ml.count_vectors(documents(spark, sf), "doc_id", "content"), 10)
    return ml.topic_top_words(model, 10)


@query("nmf_topics")
def nmf_topics(spark, sf):
    counts = ft.count_matrix(documents(spark, sf), "doc_id", "content")
    return ml.nmf_topics(counts, "doc_id", 10)


@query("word2vec")
def word2vec(spark, sf):
    # The fit reads its rows twice.
    docs = pin(cleaned(spark, sf).select(clean_words().alias("tokens")), "doc-tokens")
    return ml.word2vec(docs, F.col("tokens"))


@query("doc_vectors")
def doc_vectors(spark, sf):
    docs = pin(cleaned(spark, sf).select("doc_id", clean_words().alias("tokens")), "doc-tokens")
    vectors = pin(ml.word2vec(docs, F.col("tokens")), "word-vectors")
    return ft.doc_vectors(docs, "doc_id", F.col("tokens"), vectors, 100)


# ---------------------------------------------------------------- classical models

CLASSES = 10


def vector_rows(spark, sf):
    """(id, label, features, split): labelled vectors, stratified."""
    rows = ml.hstack(embeddings(spark, sf), [], ["embedding"]).select("vec_id", "label", "features")
    return pin(ds.stratified_split(rows, "label", "vec_id"), "vector-rows")


def _model_query(name):
    def run(spark, sf):
        rows = vector_rows(spark, sf)
        predicted = ml.fit_predict(name, rows.filter("split = 'train'"), rows.filter("split = 'test'"))
        return predicted.select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))

    return run


for _name in ("logistic_regression", "linear_svm", "random_forest"):
    query(_name)(_model_query(_name))


@query("multinomial_nb")
def multinomial_nb(spark, sf):
    """Multinomial Naive Bayes on term counts (it needs non-negative features)."""
    counts = ml.count_vectors(documents(spark, sf), "doc_id", "content")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = pin(ds.stratified_split(counts.rows.join(labels, "doc_id"), "label", "doc_id"), "count-rows")
    predicted = ml.fit_predict("multinomial_nb", rows.filter("split = 'train'"), rows.filter("split = 'test'"))
    return predicted.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("model_comparison")
def model_comparison(spark, sf):
    rows = vector_rows(spark, sf)
    return ml.compare_models(["logistic_regression", "linear_svm", "random_forest"], rows, "split")


@query("kmeans")
def kmeans(spark, sf):
    rows = ml.hstack(embeddings(spark, sf), [], ["embedding"])
    return ml.kmeans(rows).select("vec_id", "cluster")


@query("pca")
def pca(spark, sf):
    rows = ml.hstack(embeddings(spark, sf), [], ["embedding"])
    return ml.pca(rows, 2).select("vec_id", "pc1", "pc2")


@query("explained_variance")
def explained_variance(spark, sf):
    return ml.explained_variance(ml.hstack(embeddings(spark, sf), [], ["embedding"]), 5)
