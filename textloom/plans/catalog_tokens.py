"""Named queries: vocabularies, tokenizer training, encoding, padding."""

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bpe, datasets as ds, unigram, vocab as vc, wordpiece as wp
from textloom.plans.catalog_corpus import cleaned, documents
from textloom.plans.registry import query, table
from textloom.plans.sqltext import CLEAN_TOKENS, WS, words
from textloom.session import pin, scalar


def clean_words():
    return tx.words(F.col("content_clean"))


def counts(spark, sf):
    return vc.word_counts(cleaned(spark, sf), clean_words())


@query("word_counts", f"WITH {CLEAN_TOKENS} SELECT word, COUNT(*) AS n FROM toks GROUP BY word")
def word_counts(spark, sf):
    return counts(spark, sf)


SPECIAL_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS token, CAST({i} AS BIGINT) AS id" for i, t in enumerate(vc.WORDPIECE_SPECIALS))

CHARS = f"""
  ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents),
  chars AS ({SPECIAL_ROWS} UNION ALL SELECT token, row_number() OVER (ORDER BY token) + 4 FROM ch WHERE token <> '')"""


@query("char_vocab", f"WITH {CHARS} SELECT token, id FROM chars")
def char_vocab(spark, sf):
    return vc.char_vocab(documents(spark, sf), "content")


WORD_VOCAB = f"""{CLEAN_TOKENS},
  w AS (SELECT DISTINCT lower(word) AS word FROM toks),
  vocab AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM w
            UNION ALL SELECT t, (SELECT COUNT(*) FROM w) + i FROM (VALUES ('<sos>', 0), ('<eos>', 1), ('<unk>', 2), ('<pad>', 3)) v(t, i))"""


@query("word_vocab", f"WITH {WORD_VOCAB} SELECT word, id FROM vocab")
def word_vocab(spark, sf):
    return vc.word_vocab(cleaned(spark, sf), clean_words())


FREQ_VOCAB = f"""{CLEAN_TOKENS},
  st AS (SELECT word, COUNT(*) AS n, min(doc_id * 1000000 + pos) AS first FROM toks GROUP BY word HAVING COUNT(*) >= 5),
  fv AS (SELECT word, n, row_number() OVER (ORDER BY first) - 1 AS id FROM st)"""


@query("min_freq_vocab", f"WITH {FREQ_VOCAB} SELECT word, n, id FROM fv")
def min_freq_vocab(spark, sf):
    return vc.min_freq_vocab(cleaned(spark, sf), "doc_id", clean_words())


@query(
    "pair_counts",
    f"""WITH {CLEAN_TOKENS}, wc AS (SELECT word, COUNT(*) AS n FROM toks GROUP BY word),
             c AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM wc WHERE length(word) > 1)
        SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", CAST(SUM(n) AS BIGINT) AS n FROM c GROUP BY 1, 2""",
)
def pair_counts(spark, sf):
    return vc.pair_counts(counts(spark, sf), F.filter(F.split("word", ""), lambda c: c != ""))


# Fewer only where the corpus has no more pairs.
BPE_MERGES = 10_000

def train_merges(spark, sf):
    return pin(bpe.bpe_train(vc.word_counts(documents(spark, sf), tx.words(F.col("content"))), BPE_MERGES), "merges")


@query("bpe_train")
def bpe_train(spark, sf):
    return train_merges(spark, sf)


@query("bpe_encode")
def bpe_encode(spark, sf):
    ids = bpe.bpe_encode(F.col("content"), train_merges(spark, sf))
    return documents(spark, sf).select("doc_id", ids.alias("ids")).select(
        "doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join("ids", " ")).alias("digest")
    )


@query("bpe_decode", f"SELECT doc_id, array_to_string({words('text')}, ' ') AS decoded FROM documents")
def bpe_decode(spark, sf):
    """Encoding then decoding gives the words back, one space apart."""
    m = train_merges(spark, sf)
    encoded = documents(spark, sf).select("doc_id", bpe.bpe_encode(F.col("content"), m).alias("ids"))
    return encoded.select("doc_id", bpe.bpe_decode(F.col("ids"), m).alias("decoded"))


WORDPIECE_SIZE = 30_000

PIECES = f"""{CHARS}, {CLEAN_TOKENS.strip()},
  wc AS (SELECT word, COUNT(*) AS n FROM toks GROUP BY word),
  st AS (SELECT word, n, length(word) AS len, unnest(range(1, length(word))) AS i FROM wc WHERE length(word) > 1),
  sub AS (SELECT DISTINCT word, n, substr(word, i, l) AS token
          FROM (SELECT word, n, i, unnest(range(2, len - i + 2)) AS l FROM st)),
  sc AS (SELECT token, CAST(SUM(n) AS BIGINT) * length(token) AS score FROM sub GROUP BY token),
  pieces AS (SELECT token, row_number() OVER (ORDER BY score DESC, length(token) DESC, token) AS rk FROM sc)"""


@query(
    "wordpiece_train",
    f"""WITH {PIECES}
        SELECT token, id FROM chars UNION ALL
        SELECT token, rk - 1 + (SELECT COUNT(*) FROM chars) FROM pieces WHERE rk <= {WORDPIECE_SIZE} - (SELECT COUNT(*) FROM chars)""",
)
def wordpiece_train(spark, sf):
    return train_wordpiece(spark, sf)


def train_wordpiece(spark, sf):
    chars = vc.char_vocab(documents(spark, sf), "content")
    return pin(wp.wordpiece_train(counts(spark, sf), chars, WORDPIECE_SIZE), "wordpiece")


@query("wordpiece_encode")
def wordpiece_encode(spark, sf):
    ids = wp.wordpiece_encode(F.col("content_clean"), train_wordpiece(spark, sf))
    return cleaned(spark, sf).select("doc_id", ids.alias("ids")).select(
        "doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join("ids", " ")).alias("digest")
    )


@query("wordpiece_decode", f"WITH {CLEAN_TOKENS} SELECT doc_id, replace(content_clean, ' ', '') AS glued FROM cleaned")
def wordpiece_decode(spark, sf):
    """Every character is in the vocabulary, so the decoded pieces spell the text."""
    vocab = train_wordpiece(spark, sf)
    encoded = cleaned(spark, sf).select("doc_id", wp.wordpiece_encode(F.col("content_clean"), vocab).alias("ids"))
    decoded = encoded.select("doc_id", wp.wordpiece_decode(F.col("ids"), vocab).alias("decoded"))
    return decoded.select("doc_id", F.replace("decoded", F.lit(" "), F.lit("")).alias("glued"))


UNIGRAM_SIZE = 32_000


def train_unigram(spark, sf):
    words_ = vc.word_counts(cleaned(spark, sf), clean_words())
    return pin(unigram.unigram_train(words_, UNIGRAM_SIZE, coverage=1.0), "unigram")


@query("unigram_train")
def unigram_train(spark, sf):
    return train_unigram(spark, sf)


@query("unigram_encode")
def unigram_encode(spark, sf):
    ids = unigram.unigram_encode(F.col("content_clean"), train_unigram(spark, sf))
    return cleaned(spark, sf).select("doc_id", ids.alias("ids")).select(
        "doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join("ids", " ")).alias("digest")
    )


@query("unigram_decode", f"WITH {CLEAN_TOKENS} SELECT doc_id, array_to_string({words('content_clean')}, ' ') AS decoded FROM cleaned")
def unigram_decode(spark, sf):
    vocab = train_unigram(spark, sf)
    encoded = cleaned(spark, sf).select("doc_id", unigram.unigram_encode(F.col("content_clean"), vocab).alias("ids"))
    return encoded.select("doc_id", unigram.unigram_decode(F.col("ids"), vocab).alias("decoded"))


@query("save_vocab", f"WITH {WORD_VOCAB} SELECT word, id FROM vocab")
def save_vocab(spark, sf):
    return vc.saved_and_loaded(vc.word_vocab(cleaned(spark, sf), clean_words()))


@query("load_vocab", f"WITH {WORD_VOCAB} SELECT id, word FROM vocab")
def load_vocab(spark, sf):
    return vc.saved_and_loaded(vc.word_vocab(cleaned(spark, sf), clean_words()), by_id=True)


@query("vocab_size", f"WITH {WORD_VOCAB} SELECT COUNT(*) AS n FROM vocab")
def vocab_size(spark, sf):
    return vc.word_vocab(cleaned(spark, sf), clean_words()).agg(F.count(F.lit(1)).alias("n"))


TOKENIZER_PATHS = "CASE lang WHEN 'en' THEN 'models/bpe/' WHEN 'de' THEN 'models/word_piece/' WHEN 'fr' THEN 'models/SP/' ELSE 'models/' END || source"


@query(
    "token_counts",
    f"""WITH p AS (SELECT *, lower({TOKENIZER_PATHS}) AS path FROM documents)
        SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS num_tokens,
               CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview,
               CASE WHEN path LIKE '%bpe%' THEN 'bpe' WHEN path LIKE '%wordpiece%' OR path LIKE '%word\\_piece%' ESCAPE '\\' THEN 'wordpiece'
                    WHEN path LIKE '%sentencepiece%' OR path LIKE '%sp%' THEN 'sentencepiece' ELSE 'bpe' END AS tokenizer_type
        FROM p""",
)
def token_counts(spark, sf):
    text = F.col("content")
    return documents(spark, sf).select(
        "doc_id",
        F.size(tx.words(text)).cast("bigint").alias("num_tokens"),
        ds.short_preview(text).alias("preview"),
        vc.tokenizer_type(F.expr(TOKENIZER_PATHS)).alias("tokenizer_type"),
    )


CHAR_IDS = "list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 256 THEN unicode(c) ELSE 0 END)"


def char_ids(text):
    """Ids of a BPE vocabulary without merges: the code point of a base character, else 0."""
    return F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 256, F.ascii(c)).otherwise(0))


@query(
    "pad_truncate",
    f"""WITH t AS (SELECT doc_id, {CHAR_IDS} AS ids FROM documents)
        SELECT doc_id, array_to_string(list_resize(ids, 512, 0), ' ') AS input_ids,
               array_to_string(list_resize(list_transform(ids, lambda x: 1), 512, 0), ' ') AS attention_mask FROM t""",
)
def pad_truncate(spark, sf):
    encoded = documents(spark, sf).select("doc_id", char_ids(F.col("content")).alias("ids"))
    ids, mask = ds.pad_truncate(F.col("ids"), 512)
    return encoded.select("doc_id", F.array_join(ids, " ").alias("input_ids"), F.array_join(mask, " ").alias("attention_mask"))


@query(
    "pad_batch",
    f"""WITH t AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id, {CHAR_IDS} AS ids FROM documents),
             m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM t)
        SELECT doc_id, batch_id, CAST(longest AS BIGINT) AS padded_length, md5(array_to_string(list_resize(ids, longest, 0), ' ')) AS digest FROM m""",
)
def pad_batch(spark, sf):
    encoded = documents(spark, sf).select("doc_id", char_ids(F.col("content")).alias("ids"))
    return ds.pad_batch(encoded, "doc_id", "ids", 8).select(
        "doc_id", "batch_id", F.size("padded").cast("bigint").alias("padded_length"), F.md5(F.array_join("padded", " ")).alias("digest")
    )


@query(
    "one_hot",
    """WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents))
       SELECT doc_id, array_to_string(list_transform(range((SELECT COUNT(*) FROM l)), lambda i: CASE WHEN i = id THEN 1 ELSE 0 END), ' ') AS vector
       FROM documents JOIN l USING (lang)""",
)
def one_hot(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = ds.label_map(docs, "lang")
    size = scalar(labels.agg(F.count(F.lit(1)).alias("n")), F.col("n"))
    hot = ds.one_hot(F.col("label_id"), F.col("size"))
    return docs.join(labels, "lang").withColumn("size", size).select("doc_id", F.array_join(hot, " ").alias("vector"))


@query(
    "next_token_pairs",
    f"""WITH {CLEAN_TOKENS}, nx AS (SELECT word AS token, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next_token FROM toks)
        SELECT token, next_token, COUNT(*) AS n FROM nx WHERE next_token IS NOT NULL GROUP BY 1, 2""",
)
def next_token_pairs(spark, sf):
    return vc.next_token_pairs(cleaned(spark, sf), clean_words())
