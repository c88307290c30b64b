"""Eight-dimensional emotion vectors from words, emoji and audio features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import constants as C
from ..functions import text as X
from . import vectors as V

NEUTRAL = C.EMOTIONS.index("neutral")


def weights(spark: SparkSession, lexicon: DataFrame) -> DataFrame:
    """(word, emotion, w) from a lexicon (word, label)."""
    rows = ", ".join(f"('{a}', '{b}', {w}D)" for a, b, w in C.LABEL_WEIGHTS)
    return lexicon.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, emotion, w)")), "label").groupBy("word", "emotion").agg(F.sum("w").alias("w"))


def _vector(rows: DataFrame, key: str) -> DataFrame:
    """(key, vec) of summed weights in rows (key, emotion, w)."""
    sums = rows.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("emotion") == e, F.col("w"))), F.lit(0.0)).alias(e) for e in C.EMOTIONS))
    return sums.select(key, F.array(*C.EMOTIONS).alias("vec"))


def from_words(docs: DataFrame, word_weights: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, vec) of (key, tokens): every occurrence adds its weights; shares, or neutral without a hit."""
    hits = docs.select(key, F.explode("tokens").alias("word")).groupBy(key, "word").agg(F.count("*").alias("n")).join(word_weights, "word")
    found = _vector(hits.select(key, "emotion", (F.col("w") * F.col("n")).alias("w")), key)
    return V.aligned(docs.select(key), found, key, len(C.EMOTIONS)).select(key, V.share("vec", NEUTRAL).alias("vec"))


def emoji_table(emoji: DataFrame, word_weights: DataFrame) -> DataFrame:
    """(emoji, vec) of (emoji, phrase): the words of all of an emoji's phrases."""
    tokens = emoji.groupBy("emoji").agg(F.flatten(F.collect_list(X.words(F.col("phrase")))).alias("tokens"))
    return from_words(tokens, word_weights, key="emoji")


def from_emoji(posts: DataFrame, table: DataFrame, *, key: str = "post_idx", text: str = "text") -> DataFrame:
    """(key, vec, used, seen): summed vectors of a post's emoji; used are those in the table."""
    listed = posts.select(key, X.emojis(F.col(text)).alias("e"))
    rows = listed.select(key, F.explode("e").alias("emoji")).groupBy(key, "emoji").agg(F.count("*").alias("n")).join(table, "emoji")
    summed = rows.groupBy(key).agg(F.sum("n").alias("used"), *(F.sum(F.col("n") * F.col("vec")[i]).alias(e) for i, e in enumerate(C.EMOTIONS)))
    out = listed.join(summed.select(key, "used", F.array(*C.EMOTIONS).alias("vec")), key, "left")
    return out.select(key, V.share(F.coalesce("vec", F.array(*[F.lit(0.0)] * 8)), NEUTRAL).alias("vec"), F.coalesce("used", F.lit(0)).alias("used"), F.size("e").cast("long").alias("seen"))


def melody(valence, energy, danceability, acousticness, tempo) -> Column:
    """Emotion shares of audio features; a missing feature counts as 0."""
    v, e, d, a = (F.coalesce(V._c(c), F.lit(0.0)) for c in (valence, energy, danceability, acousticness))
    t = F.least(F.greatest((F.coalesce(V._c(tempo), F.lit(0.0)) - 60) / 120, F.lit(0.0)), F.lit(1.0))
    raw = F.array(
        0.60 * v + 0.15 * (1 - a) + 0.10 * (1 - F.abs(e - 0.5)),
        0.55 * e + 0.25 * (1 - v) + 0.20 * t,
        0.40 * (1 - v) + 0.35 * (1 - e) + 0.25 * a,
        0.45 * (1 - v) + 0.30 * a + 0.25 * (1 - e),
        0.50 * t + 0.30 * e + 0.20 * (1 - d),
        0.45 * (1 - v) + 0.35 * e + 0.20 * (1 - d),
        0.35 * v + 0.30 * e + 0.20 * d + 0.15 * t,
        0.35 * (1 - 2 * F.abs(v - 0.5)) + 0.35 * (1 - 2 * F.abs(e - 0.5)) + 0.30 * a,
    )
    return V.share(raw, NEUTRAL)


def from_audio(songs: DataFrame, features: DataFrame, *, key: str = "song_id") -> DataFrame:
    """(key, vec) for every song; one without features is neutral."""
    own = features.select(key, melody("valence", "energy", "danceability", "acousticness", "tempo").alias("vec"))
    neutral = F.array(*(F.lit(float(i == NEUTRAL)) for i in range(8)))
    return songs.select(key).join(own, key, "left").select(key, F.coalesce("vec", neutral).alias("vec"))


def query_blend(lex, emoji, model, lex_share: float = 0.3, emoji_share: float = 0.3) -> Column:
    """Extended: weighted sum of three vectors; the shares and the rest add to 1."""
    both = F.zip_with(V._c(lex), V._c(emoji), lambda x, y: lex_share * x + emoji_share * y)
    return F.zip_with(both, V._c(model), lambda x, y: x + (1 - lex_share - emoji_share) * y)
