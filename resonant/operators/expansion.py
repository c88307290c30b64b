"""Query expansion over a thesaurus, with gates that the corpus itself sets.

A post's tokens are expanded in order, and later ones see what earlier ones added, so the expansion
of one post is sequential; posts are independent, and run as pandas batches with the thesaurus as a
dictionary of each worker. The three passes (source gate, provisional expansion for the gate of
new terms, final expansion) are DataFrames with one small collected gate between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window as Win, functions as F

from ..functions import constants as C
from ..functions import text as X

EXPANDED = "tokens array<string>, trace array<struct<term:string,source:string>>, events array<struct<kind:string,term:string,source:string,reason:string>>"


@dataclass(frozen=True)
class Limits:
    """Bounds of an expansion."""

    max_synsets: int = 15
    top_synsets: int = 8
    min_overlap: int = 1
    max_per_token: int = 3
    max_total: int = 30
    min_count: int = 2
    fallback_count: int = 10
    fallback_synsets: int = 3
    similar: bool = True


@dataclass(frozen=True)
class Gates:
    """Tokens that are not expanded and terms that are not added because the corpus is full of them."""

    sources: frozenset[str] = frozenset()
    terms: frozenset[str] = frozenset()


@dataclass
class Thesaurus:
    """word -> [(synset, pos, signature)] by rank; synset -> [(lemma, count)]; synset -> similar synsets."""

    senses: dict[str, list[tuple[str, str, frozenset[str]]]] = field(default_factory=dict)
    lemmas: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    similar: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, synsets: DataFrame, lemmas: DataFrame, similar: DataFrame, *, most_rows: int = 2_000_000) -> Thesaurus:
        """From tables synset(synset_id, word, rank, pos, sig), lemma(synset_id, lemma, cnt), similar(synset_id, other_id); their size is checked."""
        if synsets.limit(most_rows + 1).count() > most_rows or lemmas.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"a thesaurus of more than {most_rows} rows is not held in memory")
        out = cls()
        for r in synsets.orderBy("word", "rank").collect():
            out.senses.setdefault(r["word"], []).append((r["synset_id"], r["pos"], frozenset(t for t in r["sig"] or () if _eligible(t))))
        for r in lemmas.orderBy("synset_id", "lemma").collect():
            out.lemmas.setdefault(r["synset_id"], []).append((r["lemma"], r["cnt"]))
        for r in similar.orderBy("synset_id", "other_id").collect():
            out.similar.setdefault(r["synset_id"], []).append(r["other_id"])
        return out


_STOP, _HELD = frozenset(C.STOP_WORDS), frozenset(C.NOT_EXPANDED)
_CONTEXT = dict.fromkeys(C.MONEY_TERMS, frozenset(C.MONEY_WORDS)) | dict.fromkeys(C.HOUSING_TERMS, frozenset(C.HOUSING_WORDS))
_HINTS = {"to": "v"} | dict.fromkeys("very so too really more most less".split(), "a") | dict.fromkeys("a an the my your his her their".split(), "n")


def _eligible(t: str) -> bool:
    return len(t) > 2 and t.isascii() and t.isalpha() and t.islower() and t not in _STOP and t not in _HELD


def blocked(term: str, context: set[str], gates: Gates) -> str | None:
    """Why a term may not be added, or None."""
    if term in gates.terms:
        return "newterm_df_gate"
    if term in C.NOT_ADDED:
        return "newterm_blocklist"
    if term in _HELD:
        return "do_not_expand_term"
    if term in _STOP:
        return "stopword"
    if term in C.DRIFTING:
        if term not in _CONTEXT:
            return "anti_drift_always"
        if not _CONTEXT[term] & context:
            return "anti_drift_missing_context"
    return None


def expand(tokens: list[str], t: Thesaurus, gates: Gates = Gates(), limits: Limits = Limits()) -> tuple[list[str], list[tuple[str, str]], list[tuple[str, str, str, str]]]:
    """(tokens and new terms, (term, source) of the new ones, events of blocked terms and skipped sources)."""
    order = list(dict.fromkeys(tokens))
    eligible = [w for w in order if _eligible(w)]
    present, trace, events = set(order), [], []
    for at, source in enumerate(order):
        if len(trace) >= limits.max_total:
            break
        if not _eligible(source):
            continue
        skip = lambda reason: events.append(("skipped", "", source, reason))  # noqa: E731, B023
        if source in gates.sources and source not in C.GATE_EXEMPT:
            skip("high_freq_gate")
            continue
        senses = t.senses.get(source, [])
        if not senses:
            skip("no_synsets")
            continue
        if len(senses) > limits.max_synsets:
            skip("too_many_synsets")
            continue
        context = set(eligible) - {source}
        allowed = lambda pos: pos in "nar" or pos == "v" and source in C.VERB_SOURCES  # noqa: E731, B023
        hint = _HINTS.get(order[at - 1]) if at else None
        near = [s for s in senses if hint is None or s[1] == hint][: limits.top_synsets] or senses[: limits.top_synsets]
        overlap = [len(s[2] & context) for s in near]
        best = max(range(len(near)), key=lambda i: (overlap[i], -i))
        chosen = near[best] if overlap[best] >= limits.min_overlap else None
        if chosen and not allowed(chosen[1]):
            skip(f"pos_blocked:{chosen[1]}")
            continue

        def candidates(synset: str, least: int) -> list[str]:
            found = []
            for lemma, count in sorted(t.lemmas.get(synset, []), key=lambda x: (x[1], x[0]), reverse=True):  # noqa: B023
                if count < least or len(lemma) < 3 or not (lemma.isascii() and lemma.isalpha()) or lemma.lower() in present:
                    continue
                if reason := blocked(lemma.lower(), context, gates):  # noqa: B023
                    events.append(("blocked", lemma.lower(), source, reason))  # noqa: B023
                else:
                    found.append(lemma.lower())
            return found

        options: list[str] = []
        if chosen:
            for synset in [chosen[0], *(t.similar.get(chosen[0], []) if chosen[1] == "a" and limits.similar else [])]:
                options += candidates(synset, limits.min_count)
        if not options:
            for synset, pos, _ in senses[: limits.fallback_synsets]:
                if allowed(pos):
                    options += candidates(synset, limits.fallback_count)
        for term in list(dict.fromkeys(options))[: min(limits.max_per_token, limits.max_total - len(trace))]:
            present.add(term)
            trace.append((term, source))
    return [*tokens, *(term for term, _ in trace)], trace, events


def expanded(posts: DataFrame, thesaurus: Thesaurus, gates: Gates = Gates(), limits: Limits = Limits()) -> DataFrame:
    """(post_idx, clean, tokens, trace, events) of (post_idx, tokens)."""
    shared = posts.sparkSession.sparkContext.broadcast((thesaurus, gates, limits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, g, l = shared.value
        for rows in batches:
            out = [expand(list(x), t, g, l) for x in rows["tokens"]]
            yield pd.DataFrame({
                "post_idx": rows["post_idx"], "clean": rows["tokens"], "tokens": [o[0] for o in out],
                "trace": [[{"term": a, "source": b} for a, b in o[1]] for o in out],
                "events": [[dict(zip(("kind", "term", "source", "reason"), e)) for e in o[2]] for o in out],
            })

    return posts.select("post_idx", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInPandas(run, f"post_idx long, clean array<string>, {EXPANDED}")


def frequent_sources(posts: DataFrame, *, min_df: int = 200, share: float = 0.05, most: int = 500) -> DataFrame:
    """(term, df) of tokens in many posts, exempt ones left out; the most frequent if there are too many."""
    n = posts.agg(F.count("*")).scalar()
    df = posts.select("post_idx", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= min_df) & (F.col("df") >= share * n) & ~F.col("term").isin(list(C.GATE_EXEMPT))).orderBy(F.desc("df"), "term").limit(most)


def frequent_terms(posts: DataFrame, *, min_df: int = 150, share: float = 0.03, most: int = 400) -> DataFrame:
    """(term, df) of new terms that many expanded posts got; posts: (post_idx, clean, tokens)."""
    n = posts.agg(F.count("*")).scalar()
    df = posts.select(F.explode(F.array_except("tokens", "clean")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= min_df) & (F.col("df") >= share * n)).orderBy(F.desc("df"), "term").limit(most)


def process(posts: DataFrame, thesaurus: Thesaurus, limits: Limits = Limits(), **bounds) -> DataFrame:
    """The three passes over (post_idx, tokens)."""
    sources = frozenset(r["term"] for r in frequent_sources(posts, **{k: v for k, v in bounds.items() if k in ("min_df", "share", "most")}).collect())
    first = expanded(posts, thesaurus, Gates(sources), limits)
    terms = frozenset(r["term"] for r in frequent_terms(first, **{k: v for k, v in bounds.items() if k in ("min_df", "share", "most")}).collect())
    return expanded(posts, thesaurus, Gates(sources, terms), limits)


def _ranked(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    total = counts.groupBy(group[0]).agg(F.sum("n").alias("total"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), *group[1:]))), 1, 5), lambda x: F.concat(x[group[1]], F.lit(":"), (-x["n"]).cast("string"))), " ").alias("detail"))
    return total.orderBy(F.desc("total"), F.asc(group[0])).limit(top).withColumn("rank", F.row_number().over(Win.orderBy(F.desc("total"), group[0])))


def added_report(processed: DataFrame, top: int = 50) -> DataFrame:
    """The terms added most, with their five main sources."""
    return _ranked(processed.select(F.explode("trace").alias("t")).select("t.*"), ["term", "source"], top)


def event_report(processed: DataFrame, kind: str, top: int) -> DataFrame:
    """The terms blocked or the sources skipped most, with their five main reasons."""
    rows = processed.select(F.explode("events").alias("e")).select("e.*").where(F.col("kind") == kind)
    return _ranked(rows, ["term" if kind == "blocked" else "source", "reason"], top)
