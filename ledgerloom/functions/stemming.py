"""Words as a full-text index keeps them: folded, without marks, stemmed by Porter's rules."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of M. F. Porter, "An algorithm for suffix stripping", 1980.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

LETTERS = re.compile(r"[^\W_]+")


def _consonants(word: str) -> str:
    """The word as a pattern of c and v."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _consonants(stem)))


def _cvc(stem: str) -> bool:
    return len(stem) > 2 and _consonants(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of other letters than a-z and very long ones stay as they are."""
    if len(word) < 3 or len(word) > 64 or not word.isascii() or not word.isalpha():
        return word
    # step 1a
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # step 1b
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _consonants(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    # step 1c
    if word.endswith("y") and "v" in _consonants(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for suffix, other in table:
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + other
                break
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    # step 5
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def plain_tokens(text: str) -> list[str]:
    """Letters and digits in lower case without marks."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return LETTERS.findall(text.lower())


def stemmed_tokens(text: str) -> list[str]:
    return [stem(w) for w in plain_tokens(text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stemmed tokens of each text; null for null."""
    for batch in texts:
        yield pd.Series([stemmed_tokens(t) if t is not None else None for t in batch])


def unstemmed(text: Column) -> Column:
    """Runs of letters and digits in lower case, inside the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
