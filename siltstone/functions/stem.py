"""What built-in functions cannot express, as Arrow batches: stemmed tokens (accents folded, suffixes stripped after Porter, 1980), rounding by the exact binary value."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

_TOKEN = re.compile(r"[^\W_]+")
_VOWELS = "aeiou"
#: Fixed values of the published algorithm: suffix and replacement, by step.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for steps in (STEP2, STEP3):
        for suffix, by in sorted(steps, key=lambda s: -len(s[0])):
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + by
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root[-1:] in ("s", "t")):
                word = root
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(texts: pd.Series) -> pd.Series:
    """Folded, stemmed tokens in order; empty for null."""
    return texts.map(lambda t: [stem(w) for w in _TOKEN.findall(folded(t))] if t else [])


@F.pandas_udf(DoubleType())
def rounded_2(values: pd.Series) -> pd.Series:
    """Two places by the exact binary value: 0.175 gives 0.17, where round and bround give 0.18."""
    return values.map(lambda x: round(x, 2), na_action="ignore")
