"""Tokens of short posts: handles dropped, long runs shortened, emoticons kept whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.stem import stem_tokens
from textloom.functions.text import drop_punctuation_tokens, drop_stop_words, strip_tweet_markup

# The token classes of the published tokenizer for short posts, in its order.
# Eyes, optional nose, mouth; or the same mirrored; or a whole or broken heart.
EMOTICON = r"[<>]?[:;=8][\-o*']?[)\](\[dDpP/:}{@|\\]|[)\](\[dDpP/:}{@|\\][\-o*']?[:;=8][<>]?|</?3"
TOKEN = "|".join(
    [
        r"https?://\S+",
        # Telephone numbers
        r"(?:\+?[01][ *\-.)]*)?(?:\(?\d{3}[ *\-.)]*)?\d{3}[ *\-.)]*\d{4}",
        EMOTICON,
        # Tags, arrows, handles, topics, e-mail addresses
        r"<[^>\s]+>",
        r"-+>|<-+",
        r"@\w+",
        r"#+\w+[\w'\-]*\w+",
        r"[\w.+\-]+@[\w\-]+\.(?:[\w\-]\.?)+[\w\-]",
        # Words with apostrophes or dashes, numbers with marks, other words, dots, anything else
        r"[^\W\d_](?:[^\W\d_]|['\-_])+[^\W\d_]",
        r"[+\-]?\d+[,/.:\-]\d+[+\-]?",
        r"\w+",
        r"\.(?:\s*\.)+",
        r"\S",
    ]
)
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def tweet_tokens(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_!@#$%&*])@[A-Za-z0-9_]{1,15}(?![A-Za-z0-9_])", " ")
    text = F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1$1")
    found = F.regexp_extract_all(text, F.lit(rf"(?U){TOKEN}"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike(rf"\A(?:{EMOTICON})\z"), t).otherwise(F.lower(t)))


def process_tweet(text: Column) -> Column:
    """Markup off, tokens, stop words and punctuation off, stems."""
    tokens = drop_punctuation_tokens(drop_stop_words(tweet_tokens(strip_tweet_markup(text))))
    return stem_tokens(tokens)
