"""The published Porter (1980) suffix stripper with the usual irregular forms."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose stem is listed.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# The suffix tables of steps 2, 3 and 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _shape(stem: str) -> str:
    """Vowel (v) or consonant (c) for each letter; y is a vowel after a consonant."""
    out: list[str] = []
    for ch in stem:
        out.append("v" if ch in "aeiou" or (ch == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(word: str) -> bool:
    if len(word) == 2:
        return _shape(word) == "vc"
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    """Apply the first rule whose suffix fits, if the stem before it is long enough."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            long_enough = _measure(stem + "l" if suffix == "logi" else stem) > 0
            return stem + new if long_enough else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def _long_suffix(word: str) -> str:
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else word
    return word


def stem_word(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _swap(word, sorted(STEP2, key=lambda r: len(r[0]), reverse=True))
    word = _swap(word, STEP3)
    word = _long_suffix(word)
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_column(word: Column) -> Column:
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem_word(w))

    return stems(word)


def stem_tokens(tokens: Column) -> Column:
    """Stem every token; a task remembers the words it has seen."""

    @F.pandas_udf("array<string>")
    def stems(rows: pd.Series) -> pd.Series:
        cached = lru_cache(200_000)(stem_word)
        return rows.map(lambda r: None if r is None else [cached(t) for t in r])

    return stems(tokens)
