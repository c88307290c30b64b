"""Posts to tokens: cleaning, hashtag words, and normalisation for retrieval."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import constants as C
from ..functions import text as X
from ..functions.stemming import stemmed

LONGEST_WORD, MOST_WORDS = 20, 5


def break_word(s: str, words: frozenset[str]) -> list[str] | None:
    """s as the fewest dictionary words of 2 to 20 letters; then the largest sum of squared lengths, then the first in order.

    None if there is none, if it takes 6 words or more, or if it has a short word that is not a common one.
    """

    @lru_cache(maxsize=None)
    def best(end: int):
        if end == 0:
            return 0, 0, ()
        options = []
        for start in range(max(0, end - LONGEST_WORD), end - 1):
            if s[start:end] in words and (before := best(start)) is not None:
                options.append((before[0] + 1, before[1] - (end - start) ** 2, (*before[2], s[start:end])))
        return min(options, default=None)

    for end in range(0, len(s), 200):  # keeps the recursion shallow
        best(end)
    found = best(len(s))
    if found is None or found[0] > MOST_WORDS or any(len(w) == 3 and w not in C.TAG_SHORT_WORDS for w in found[2]):
        return None
    return list(found[2])


def tag_words(tag: str, words: frozenset[str]) -> list[str]:
    """The words of a hashtag without its #."""
    if re.search("[A-Z]", tag):
        return [p.lower() for p in re.findall(r"[A-Z][a-z]+|[a-z]+|\d+", tag)] or [tag.lower()]
    tag = tag.lower()
    if tag in C.TAG_MAP:
        return C.TAG_MAP[tag]
    if not tag.isalnum():
        return [tag]
    if len(tag) > 5 and tag.startswith("not") and tag[3:] in words:
        return ["not", tag[3:]]
    for suffix in sorted(C.TAG_SUFFIXES, key=len, reverse=True):
        head = tag.removesuffix(suffix)
        if head != tag and len(head) > 2:
            if left := break_word(head, words):
                return [*left, suffix]
            if head in words:
                return [head, suffix]
    return break_word(tag, words) or [tag]


def tag_dictionary(lemmas) -> frozenset[str]:
    """Single alphabetic words of two letters or more, and the fixed extra ones."""
    own = {w.lower() for w in lemmas if w and "_" not in w and w.isalpha() and len(w) > 1}
    return frozenset(own | set(C.TAG_EXTRA_WORDS) | set(C.TAG_SUFFIXES))


def spelled_hashtags(c: Column, words: frozenset[str]) -> Column:
    """Every hashtag replaced by itself in lower case and its words, each once. words: a dictionary of bounded size."""
    seen: dict[str, str] = {}

    def spell(m: re.Match) -> str:
        if m[1] not in seen:
            if len(seen) > 20_000:
                seen.clear()
            seen[m[1]] = " " + " ".join(dict.fromkeys([m[1].lower(), *tag_words(m[1], words)])) + " "
        return seen[m[1]]

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else re.sub(r"#(\w+)", spell, t))

    return F.when(c.contains("#"), run(c)).otherwise(c)


def clean_tokens(posts: DataFrame, words: frozenset[str], *, text: str = "text") -> DataFrame:
    """posts with `tokens`."""
    return posts.withColumn("tokens", X.post_tokens(spelled_hashtags(X.cleaned_posts(F.col(text)), words)))


def for_retrieval(tokens: Column) -> Column:
    """Stems of the a-z words of two letters or more that are no stop words."""
    return stemmed(X.content_words(F.filter(tokens, lambda t: t.rlike("^[a-z]+$"))))


def lyric_words(cleaned: Column) -> Column:
    """What `lyric_tokens` stems."""
    return X.content_words(X.treebank_words(cleaned))


def lyric_tokens(cleaned: Column) -> Column:
    return stemmed(lyric_words(cleaned))
