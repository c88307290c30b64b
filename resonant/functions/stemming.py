"""The Porter stemmer with its customary extensions, and the pandas function that applies it.

Written from the published algorithm (Porter 1980). A token's stem depends on the token alone, so
each worker remembers the stems it has seen, up to a bound.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Words with their own stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffix rules of steps 2 to 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    s = shape(word)
    return s[-3:] == "cvc" and word[-1] not in "wxy" or len(s) == 2 and s == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    stem = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in shape(w[: -len(e)])), None)
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem


def _longest(w: str, rules) -> tuple[str, str] | None:
    fits = [r for r in rules if w.endswith(r[0])]
    return max(fits, key=lambda r: len(r[0])) if fits else None


def _double_suffix(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]):
        return _double_suffix(w[:-2])
    rule = _longest(w, STEP2)
    if rule and rule[0] != "alli":
        stem = w[: -len(rule[0])]
        return stem + rule[1] if measure(stem) else w
    return w[:-1] if w.endswith("logi") and measure(w[:-3]) else w


@lru_cache(maxsize=200_000)
def stem(token: str) -> str:
    w = token.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _double_suffix(w)
    if (rule := _longest(w, STEP3)) and measure(w[: -len(rule[0])]):
        w = w[: -len(rule[0])] + rule[1]
    if rule := _longest(w, [(s, "") for s in STEP4]):
        rest = w[: -len(rule[0])]
        if measure(rest) > 1 and (rule[0] != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if (m := measure(rest)) > 1 or m == 1 and not _short_end(rest):
            w = rest
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def stemmed(tokens: Column) -> Column:
    """Stems of an array of tokens, without those of one letter."""
    return F.filter(_stems(tokens), lambda t: F.length(t) > 1)
