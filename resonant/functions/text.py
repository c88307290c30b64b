"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import constants as C


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def safe_lower(c: Column) -> Column:
    """Lower-cased and trimmed; null becomes empty."""
    return F.lower(F.trim(_or_empty(c)))


def normalize_id(c: Column) -> Column:
    """Runs of other characters than a-z0-9 become one underscore; an empty id is "unknown"."""
    out = F.btrim(F.regexp_replace(F.lower(_or_empty(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", "unknown").otherwise(out)


def normalize_title(c: Column) -> Column:
    """For deduplication: other characters than a-z0-9 and spaces become a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_or_empty(c)), "[^a-z0-9 ]+", " "), r"\s+", " "))


def checker_title(c: Column) -> Column:
    """For the duplicate report: parentheses and other characters than a-z0-9 and spaces go."""
    out = F.regexp_replace(F.lower(F.trim(_or_empty(c))), r"\(.*?\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]+", ""), r"\s+", " "))


def checker_artist(c: Column) -> Column:
    """As `checker_title`, cut at the first "feat", then at the first "with"."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_or_empty(c))), "feat.*", ""), "with.*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]+", ""), r"\s+", " "))


def credit_free(c: Column) -> Column:
    """A name cut before its first guest credit."""
    out = F.trim(F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("’"), F.lit("'")))
    for mark in C.CREDIT_MARKS:
        out = F.trim(F.substring_index(out, mark, 1))
    return out


def slug(c: Column) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(F.trim(_or_empty(c))), r"\s+", "_"), F.lit("_")), F.lit(120))


def english_share(c: Column) -> Column:
    """Share of A-Za-z among all characters."""
    return F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / F.greatest(F.length(c), F.lit(1))


def is_original_page(url: Column) -> Column:
    return ~F.lower(url).rlike("|".join(map(re.escape, C.TRANSLATION_MARKS)))


def without_brackets(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(_or_empty(c), C.BRACKETS, by)


def bracket_free_lines(c: Column) -> Column:
    """Brackets removed, lines trimmed, empty lines dropped."""
    lines = F.transform(F.split(without_brackets(c, ""), r"\R"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def bracket_phrases(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(_or_empty(c), F.lit(C.BRACKETS), 1), lambda p: F.regexp_replace(F.trim(p), r"\s+", " "))


def phrase_class(c: Column) -> Column:
    """What a bracketed phrase is; the first rule that fits."""
    p = F.trim(F.lower(c))
    any_of = lambda words: p.rlike("|".join(map(re.escape, words)))
    return (
        F.when(p.rlike(C.REPEAT_PHRASE), "repeat_marker")
        .when(any_of(C.SECTION_KEYWORDS), "section_marker")
        .when(any_of(C.META_KEYWORDS), "metadata")
        .when(p.rlike(C.SPEAKER_PHRASE) & (F.length(F.regexp_replace(p, "[^ ]", "")) <= 3), "speaker_or_tag")
        .otherwise("other")
    )


def section_pattern() -> str:
    return r"(?i)^\s*(" + "|".join(C.SECTION_WORDS) + ")" + C.SECTION_TAIL


def without_section_lines(c: Column) -> Column:
    """Blank lines, section headings and repetition marks dropped."""
    keep = lambda x: (F.trim(x) != "") & ~x.rlike(section_pattern()) & ~x.rlike(C.REPEAT_LINE)
    return F.array_join(F.filter(F.split(_or_empty(c), r"\R"), keep), "\n")


def expanded_lyrics(c: Column) -> Column:
    for pattern, by in C.LYRIC_CONTRACTIONS:
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_lyrics(c: Column, *, brackets: bool = True, sections: bool = True) -> Column:
    """Text of a-z words: brackets, section lines, apostrophes, case, contractions, URLs, other characters, spaces."""
    out = without_brackets(c) if brackets else _or_empty(c)
    out = without_section_lines(out) if sections else out
    out = expanded_lyrics(F.lower(F.regexp_replace(out, "[’`´]", "'")))
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+", " "), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def corpus_lines(c: Column, is_english: Callable[[Column], Column] | None = None) -> Column:
    """Lines of a raw text without credits, stage directions, a leading foreign block and an overlong opening."""
    is_english = is_english or (lambda line: english_share(line) >= 0.6)
    lines = F.filter(F.transform(F.split(_or_empty(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    told = F.filter(lines, lambda x: ~F.lower(x).rlike(C.METADATA_PATTERN) & ~x.rlike(C.PARENTHESISED_LINE))
    first = F.array_position(F.transform(told, is_english), F.lit(True))
    rest = F.when(first > 1, F.slice(told, first.cast("int"), F.greatest(F.size(told), F.lit(1)))).otherwise(told)
    return F.when(F.length(F.get(rest, F.lit(0))) > 120, F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))).otherwise(rest)


def too_short(cleaned: Column) -> Column:
    """Fewer than 3 lines or 50 words."""
    return (F.size(F.split(cleaned, "\n")) < 3) | (F.size(F.filter(F.split(cleaned, r"\s+"), lambda x: x != "")) < 50)


def words(c: Column) -> Column:
    """The a-z words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_or_empty(c)), F.lit("([a-z]+)"), 1)


def joined(tokens: Column) -> Column:
    return F.array_join(F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != ""), " ")


def treebank_words(cleaned: Column) -> Column:
    """Words of a cleaned text with the fused forms split as treebanks do."""
    out = F.regexp_replace(cleaned, r"\b(can)(not)\b", "$1 $2")
    out = F.regexp_replace(out, r"\b(gim|lem)(me)\b", "$1 $2")
    out = F.regexp_replace(out, r"\b(gon|wan)(na)\b", "$1 $2")
    out = F.regexp_replace(out, r"\b(got)(ta)\b", "$1 $2")
    return F.filter(F.split(out, r"\s+"), lambda x: x != "")


def content_words(tokens: Column) -> Column:
    """Words of two letters or more that are no stop words."""
    return F.filter(tokens, lambda x: (F.length(x) > 1) & ~x.isin(list(C.STOP_WORDS)))


def is_source_token(c: Column) -> Column:
    """Whether query expansion may start from the token."""
    return c.rlike("^[a-z]{3,}$") & ~c.isin(list(C.STOP_WORDS)) & ~c.isin(list(C.NOT_EXPANDED))


def is_emoji(c: Column) -> Column:
    return c.rlike(r"\p{So}")


def is_punctuation(c: Column) -> Column:
    return F.trim(c).rlike(r"^\p{P}*$")


def emojis(c: Column) -> Column:
    """Single emoji code points in order."""
    return F.regexp_extract_all(_or_empty(c), F.lit("(" + C.EMOJI + ")"), 1)


def expanded_posts(c: Column) -> Column:
    """Contractions in posts expanded, the longest forms first; case is ignored."""
    out = F.regexp_replace(_or_empty(c), "[’‘]", "'")
    for short in sorted(C.POST_CONTRACTIONS, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", C.POST_CONTRACTIONS[short])
    return out


def cleaned_posts(c: Column) -> Column:
    """A post up to its hashtags: variation selectors, URLs, user names, slang marks, contractions."""
    out = F.regexp_replace(_or_empty(c), "[︎️]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+|www\.\S+", " "), r"(?U)@\w+", " ")
    for pattern, by in C.SLANG_PATTERNS:
        out = F.regexp_replace(out, pattern, by)
    return expanded_posts(out)


def post_tokens(tagged: Column) -> Column:
    """Tokens of a post whose hashtags are already words."""
    spaced = F.lower(F.regexp_replace(tagged, r"([\x{2711}-\x{10FFFF}])", " $1 "))
    raw = F.regexp_extract_all(spaced, F.lit(r"(?U)([a-z]+(?:'[a-z]+)?|\d+|[^\w\s])"), 1)
    slang = F.create_map(*(F.lit(x) for pair in C.SLANG.items() for x in pair))
    squashed = F.transform(raw, lambda t: F.regexp_replace(t, r"(.)\1{2,}", "$1$1"))
    spoken = F.flatten(F.transform(squashed, lambda t: F.split(F.coalesce(F.try_element_at(slang, t), t), " ")))
    return F.filter(spoken, lambda t: ~t.isin("@", "#", "&", "") & ~is_punctuation(t))


def likely_english(c: Column, least: float = 0.1) -> Column:
    """Whether a tenth of the words of a text are English stop words."""
    found = words(c)
    listed = F.array(*(F.lit(w) for w in C.STOP_WORDS))
    return F.size(F.filter(found, lambda w: F.array_contains(listed, w))) >= least * F.greatest(F.size(found), F.lit(1))
