"""Column expressions on text. Everything here stays inside whole-stage codegen where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words used by the tweet and topic preparation steps.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan",
    "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
]

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Java's Unicode whitespace misses the four separators that Python counts as space.
_SPACE = r"\s\x1c-\x1f"
_NOT_WORD_OR_SPACE = rf"(?U)[^\p{{L}}\p{{N}}_{_SPACE}]"
_WORD = rf"(?U)[^{_SPACE}]+"


def words(text: Column) -> Column:
    """Whitespace-separated words, Unicode spaces included."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def remove_special(text: Column) -> Column:
    return F.regexp_replace(text, _NOT_WORD_OR_SPACE, "")


def clean_text(text: Column) -> Column:
    """Keep word characters and whitespace, lower-case, strip spaces."""
    return F.trim(F.lower(remove_special(text)))


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)http\S+|www\S+|https\S+", "")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, r"[@#][\p{L}\p{N}_]+", "")


def blank_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, _NOT_WORD_OR_SPACE, " ")


def blank_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", " ")


def strip_tweet_markup(text: Column) -> Column:
    """Drop a leading retweet mark, links, and the # sign of hashtags."""
    text = F.regexp_replace(text, r"^RT\s+", "")
    text = F.regexp_replace(text, r"(?U)https?://\S+", "")
    return F.replace(text, F.lit("#"), F.lit(""))


def without(tokens: Column, unwanted: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(unwanted))


def drop_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    return without(tokens, STOP_WORDS if stop_words is None else stop_words)


def drop_punctuation_tokens(tokens: Column) -> Column:
    """Drop tokens that occur inside the punctuation string (a substring test)."""
    return F.filter(tokens, lambda t: ~F.contains(F.lit(PUNCTUATION), t))


def advanced_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower, drop links, mentions, punctuation and digits; keep words over two letters."""
    body = F.lower(text)
    body = blank_digits(blank_punctuation(strip_mentions(strip_urls(body))))
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(words(body), lambda t: ~t.isin(stop) & (F.length(t) > 2))


def text_quality(text: Column, min_length: int = 50) -> Column:
    """At least ``min_length`` chars, at most half special, at least a tenth distinct words."""
    n = F.length(text)
    special = n - F.length(remove_special_or_underscore(text))
    tokens = words(text)
    distinct_share = F.size(F.array_distinct(tokens)) / F.size(tokens)
    ok = (n >= min_length) & (special / n <= 0.5) & (F.size(tokens) > 0) & (distinct_share >= 0.1)
    return F.coalesce(ok, F.lit(False))


def remove_special_or_underscore(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)[^\p{{L}}\p{{N}}{_SPACE}]", "")


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct character k-shingles; empty when the text is shorter than k."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def capitalised_names(text: Column, limit: int = 10) -> Column:
    """Distinct among the first ``limit`` capitalised words."""
    hits = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-z]+\b"), F.lit(0))
    return F.array_distinct(F.slice(hits, 1, limit))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""
    if n == 1:
        return tokens
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    heads = F.slice(ngrams(tokens, n - 1), F.lit(1), size)
    return F.zip_with(heads, F.slice(tokens, F.lit(n), size), lambda head, last: F.concat(head, F.lit(" "), last))


def format_size(n_bytes: Column) -> Column:
    """Bytes as ``x.xx UNIT`` in steps of 1024, halves rounded to even."""
    expr = None
    for power, unit in [(4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")]:
        shown = F.format_string(f"%.2f {unit}", F.bround(n_bytes / F.lit(1024.0**power), 2))
        expr = shown if expr is None else F.when(n_bytes < 1024.0 ** (power + 1), shown).otherwise(expr)
    return expr


def quote_url(text: Column) -> Column:
    """Percent-encode like a URL path: spaces as %20, slashes kept."""
    out = F.url_encode(text)
    for found, wanted in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def unescape_entities(text: Column) -> Column:
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
