"""Operator 8: quality rules, a threshold table compiled into one Spark projection.

RULES names ratios of measured counts with their bounds; `rules` turns the table into column
expressions, so the whole verdict is evaluated in the JVM without user functions, in one pass and
without a shuffle. Words are runs of characters other than ASCII white space.

Exactness: 64-bit hashes of the five-word windows only tell texts without any repeated window from
the rest; the rest sort the windows themselves.

Defined results. Null text: no words, so it fails. Repeated rows each get their row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Common words of the corpus languages.
STOP_WORDS = (
    "a and are as at be but by for from had has have he her his in is it not of on or that the they this to was were which with you "
    "al como con de del el en es la las lo los más no para por que se su un una y "
    "au avec ce dans des du est et il le les ne ou par pas plus pour qui sur une "
    "als auch auf das dem den der die ein eine für im ist mit nicht sich sie und von zu"
).split()
WINDOW = 5


class Rule(NamedTuple):
    name: str
    count: str  # measured count
    per: str  # what it is divided by
    least: float | None  # smallest allowed ratio
    most: float | None  # largest allowed ratio
    from_words: int  # texts of fewer words are not judged by this rule


RULES = (
    Rule("length", "word_chars", "n_words", 1.5, 60.0, 1),
    Rule("symbols", "n_symbols", "n_words", None, 0.1, 10),
    Rule("shouting", "n_bangs", "n_words", None, 0.5, 10),
    Rule("stop words", "n_stop", "n_words", 0.02, None, 50),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.8, 10),
    Rule("cut lines", "n_cut_lines", "n_lines", None, 0.5, 10),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _length_of(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, kept, "")).cast("long")


def _windows(words: Column, n: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), f)).otherwise(F.array())


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows found twice or more, for a text that has such a window."""
    placed = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))

    def at(ordered: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(ordered, k)["w"] == F.get(ordered, k + d)["w"], F.lit(False))
        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.when(same(k, -1) | same(k, 1), F.get(ordered, k)["i"])), lambda x: x.isNotNull()))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["to"])).alias("n"), (i + WINDOW).alias("to"))
    return F.aggregate(let(placed, at), zero, step, lambda a: a["n"]).cast("long")


def measured(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use."""
    source = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    cut = source.select(
        "doc_id", "t",
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    word = lambda i, j: F.get("words", i + j)
    counted = cut.select(
        "doc_id", "words", "lines", n.alias("n"),
        _length_of(F.col("t"), SPACE).alias("word_chars"),
        _length_of(F.col("t"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _length_of(F.col("t"), r"[^!]+").alias("n_bangs"),
        _windows(F.col("words"), n, lambda i: F.xxhash64(*(word(i, j) for j in range(WINDOW)))).alias("hashes"),
    )
    n = F.col("n")
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    # Filters on a non-deterministic column stay above this projection; pushed below it, they would
    # repeat the cutting of words inside the functions over words.
    n_words = F.when(F.monotonically_increasing_id() >= 0, n.cast("long"))
    return counted.select(
        "doc_id", n_words.alias("n_words"), "word_chars", "n_symbols", "n_bangs",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: F.rtrim(line).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_cut_lines"),
        F.size(F.filter("words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.when(repeats, _repeat_words(F.col("words"), n)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression."""
    out = F.lit(True)
    for r in rules:
        ratio = F.col(r.count) / F.greatest(F.col(r.per), F.lit(1))
        held = F.lit(True)
        if r.least is not None:
            held = held & (ratio >= r.least)
        if r.most is not None:
            held = held & (ratio <= r.most)
        out = out & (held | (F.col("n_words") < r.from_words))
    return out


def report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row the counts, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured(documents, doc_id=doc_id, text=text).select(*columns, failed.alias("base_failed"), (~failed & passes(rules)).alias("kept"))


def keep_good(documents: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    packed = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).alias("body"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(packed, doc_id="row", text="body").where(~failed & passes(rules)).select("doc_id.*")
