"""Aggregates behind the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as Win, functions as F

from ..functions import constants as C
from ..functions import text as X


def label_distribution(rows: DataFrame, *labels: str) -> DataFrame:
    """How many rows have each label, in the labels' order."""
    labels = labels or ("label",)
    return rows.groupBy(*labels).agg(F.count("*").alias("n")).orderBy(*labels)


def expansion_percentiles(posts: DataFrame) -> DataFrame:
    """One row: mean, median and 90th percentile of expanded over clean length; posts without clean tokens are left out."""
    r = posts.select((F.col("n_expanded") / F.nullif(F.col("n_clean"), F.lit(0))).alias("r"))
    return r.agg(F.avg("r").alias("mean"), F.percentile("r", 0.5).alias("p50"), F.percentile("r", 0.9).alias("p90"), F.count("r").alias("n"))


def ratio_histogram(posts: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n) of the expansion ratio between its extremes."""
    r = posts.select((F.col("n_expanded") / F.nullif(F.col("n_clean"), F.lit(0))).alias("r")).where("r is not null")
    ends = r.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    spot = F.when(hi == lo, 1).otherwise(F.least(F.floor((F.col("r") - lo) / (hi - lo) * bins) + 1, F.lit(bins)))
    return r.groupBy(spot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def length_histogram(lengths: DataFrame, per_decade: int = 5) -> DataFrame:
    """(bin, n) of positive lengths n on a logarithmic scale."""
    return lengths.where("n > 0").groupBy(F.floor(F.log10(F.col("n").cast("double")) * per_decade + 1e-9).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def length_medians(lengths: DataFrame) -> DataFrame:
    """One row: median of the positive lengths n and how many there are."""
    return lengths.where("n > 0").agg(F.percentile("n", 0.5).alias("median"), F.count("*").alias("n"))


def top_words(counts: DataFrame, k: int = 20) -> DataFrame:
    """(term, cnt) of the most frequent terms, domain words left out and some masked."""
    kept = counts.where(~F.col("term").isin(list(C.DOMAIN_STOP_WORDS))).orderBy(F.desc("cnt"), "term").limit(k)
    return kept.select(F.when(F.col("term").isin(list(C.CENSORED)), F.concat(F.left("term", F.lit(1)), F.repeat(F.lit("*"), F.length("term") - 1))).otherwise(F.col("term")).alias("term"), "cnt")


def bracket_report(songs: DataFrame, *, top: int = 200, examples: int = 5) -> DataFrame:
    """(phrase, class, n, examples) of bracketed phrases in (song_id, lyrics): the most frequent, with the first songs that hold them."""
    held = songs.select("song_id", F.explode(X.bracket_phrases(F.col("lyrics"))).alias("phrase"))
    by_song = held.groupBy("phrase", "song_id").agg(F.count("*").alias("n"))
    first = by_song.groupBy("phrase").agg(F.sum("n").alias("n"))
    kept = first.orderBy(F.desc("n"), "phrase").limit(top)
    order = Win.partitionBy("phrase").orderBy("song_id")
    some = by_song.select("phrase", "song_id").join(kept.select("phrase"), "phrase").withColumn("k", F.row_number().over(order)).where(F.col("k") <= examples)
    listed = some.groupBy("phrase").agg(F.array_sort(F.collect_list("song_id")).alias("examples"))
    return kept.join(listed, "phrase").select("phrase", X.phrase_class(F.col("phrase")).alias("class"), "n", "examples")


def yearly_charts(weeks: DataFrame) -> DataFrame:
    """(year, title, artist) of weekly charts (day, title, artist): each song once a year, names without guest credits."""
    return weeks.select(F.year("day").alias("year"), X.credit_free(F.col("title")).alias("title"), X.credit_free(F.col("artist")).alias("artist")).distinct()


def size_evaluation(sizes: DataFrame) -> DataFrame:
    """One row: smallest and largest cluster and how many are small, from (cluster, size, is_small)."""
    return sizes.agg(F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum(F.col("is_small").cast("int")).alias("n_small"))
