"""TF-IDF, clusters over a range of K, cluster merging and descriptions."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from ..functions import constants as C
from ..sources.tables import written
from . import kmeans
from . import retrieval as R
from . import vectors as V


def ngrams(tokens: Column, most: int = 1) -> Column:
    """Words, and runs of up to `most` words. The words are bound once: an expression used inside a lambda would be evaluated for every word."""

    def runs(words: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(tokens), lambda words: F.concat(words, *(runs(words, n) for n in range(2, most + 1)))), 1)


def tfidf(docs: DataFrame, *, min_df: int = 1, max_df_ratio: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(doc_id, term, weight): tf (ln((1 + n) / (1 + df)) + 1) with rows of length 1; the most frequent terms if there are too many."""
    n_docs = docs.agg(F.count("*")).scalar()
    tf = written(R.term_counts(docs), "counts")
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt")).where((F.col("df") >= min_df) & (F.col("df") <= max_df_ratio * n_docs))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("cnt"), "term").limit(max_features)
    rows = tf.join(vocabulary.select("term", "df"), "term")
    raw = rows.select("doc_id", "term", (F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Win.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / size).alias("weight"))


def topic_stop_words() -> tuple[str, ...]:
    """The general stop words and those of the topic model, each once."""
    return tuple(dict.fromkeys((*C.STOP_WORDS, *C.TOPIC_STOP_WORDS)))


def without_stop_words(tokens: Column, words: tuple[str, ...] | None = None) -> Column:
    """Tokens of two letters or more that are no stop words; a token is looked up in a hash set, whatever the number of words."""
    listed = topic_stop_words() if words is None else words
    return F.filter(tokens, lambda x: (F.length(x) > 1) & ~x.isin(*listed) if listed else F.length(x) > 1)


def ngram_tfidf(docs: DataFrame, *, most: int = 2, min_df: int = 2, max_features: int | None = 50_000, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, term, weight) of words and runs of up to `most` words, formed after the stop words are gone; no stop words: an empty tuple."""
    kept = docs.select("doc_id", ngrams(without_stop_words(F.col("tokens"), stop_words), most).alias("tokens"))
    return tfidf(kept, min_df=min_df, max_features=max_features)


def cluster_sizes(assigned: DataFrame, k: int, small: int = 30) -> DataFrame:
    """(cluster, size, is_small) for every cluster, empty ones included."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(assigned.groupBy("cluster").agg(F.count("*").alias("size")), "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"), (F.coalesce("size", F.lit(0)) < small).alias("is_small"))


def top_terms(weights: DataFrame, assigned: DataFrame, top: int = 12) -> DataFrame:
    """(cluster, rank, term, mean): the terms of the largest mean weight; documents without a term count as 0."""
    size = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    mean = weights.join(assigned, "doc_id").groupBy("cluster", "term").agg(F.sum("weight").alias("s")).join(size, "cluster").select("cluster", "term", F.round(F.col("s") / F.col("size"), 9).alias("mean")).where("mean > 0")
    order = Win.partitionBy("cluster").orderBy(F.desc("mean"), "term")
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def centroids(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, vec): mean vectors."""
    flat = vectors.join(assigned, "id").select("cluster", F.posexplode("vec").alias("i", "x"))
    mean = flat.groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


def centroid_pairs(centers: DataFrame) -> DataFrame:
    """(i, j, sim) of every two of the K centroids, i < j."""
    a, b = (centers.select(F.col("cluster").alias(n), F.col("vec").alias("v" + n)) for n in "ij")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", V.cosine("vi", "vj").alias("sim"))


def top_pairs(pairs: DataFrame, n: int = 50) -> DataFrame:
    """(rank, i, j, sim) of the n most similar pairs."""
    best = pairs.orderBy(F.desc("sim"), "i", "j").limit(n)
    return best.select(F.row_number().over(Win.orderBy(F.desc("sim"), "i", "j")).alias("rank"), "i", "j", "sim")


def pairs_above(pairs: DataFrame, threshold: float = 0.57) -> DataFrame:
    """(i, j, sim) of the pairs that reach the threshold, the most similar first."""
    return pairs.where(F.col("sim") >= threshold).orderBy(F.desc("sim"), "i", "j")


def merge_map(pairs: DataFrame, k: int, threshold: float = 0.57) -> DataFrame:
    """(old_id, new_id): clusters linked by pairs of at least the threshold, also through others, become one.

    New ids run from the largest group down, equal sizes by their smallest member. The smallest
    label spreads along the links, at most k rounds over at most k * k pairs.
    """
    spark = pairs.sparkSession
    links = pairs_above(pairs, threshold)
    both = written(links.select("i", "j").unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))), "links")
    labels = spark.range(k).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("root"))
    for _ in range(k):
        near = both.join(labels.select(F.col("i").alias("j"), "root"), "j").groupBy("i").agg(F.min("root").alias("near"))
        moved = written(labels.join(near, "i", "left").select("i", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")), "labels")
        labels = moved.select("i", "root")
        if moved.where("old != root").isEmpty():
            break
    size = labels.groupBy("root").agg(F.count("*").alias("n"))
    new = size.withColumn("new_id", F.row_number().over(Win.orderBy(F.desc("n"), "root")) - 1)
    return labels.join(new, "root").select(F.col("i").alias("old_id"), "new_id")


def remapped(assigned: DataFrame, mapping: DataFrame, default: int = 0) -> DataFrame:
    return assigned.join(F.broadcast(mapping), F.col("cluster") == F.col("old_id"), "left").select(*(c for c in assigned.columns if c != "cluster"), F.coalesce("new_id", F.lit(default)).alias("cluster"))


def inertia(vectors: DataFrame, assigned: DataFrame, centers: DataFrame) -> DataFrame:
    """One row: the sum of squared distances to the own centroid."""
    j = vectors.join(assigned, "id").join(F.broadcast(centers.withColumnRenamed("vec", "c")), "cluster")
    return j.agg(F.sum(F.aggregate(F.zip_with("vec", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)).alias("inertia"))


def silhouette(vectors: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """One row: the mean cosine silhouette of all rows.

    With unit vectors the mean distance to a cluster is one minus the product with the cluster's mean
    unit vector, so sums by cluster replace all pairs. Rows alone in their cluster count as 0.
    """
    u = vectors.join(assigned, "id").select("id", "cluster", F.transform("vec", lambda x: x / F.greatest(V.norm("vec"), F.lit(1e-12))).alias("u"))
    flat = u.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"))
    sums = flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s")).join(u.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    j = u.withColumn("all", sums.agg(F.collect_list(F.struct("cluster", "s", "n"))).scalar())
    own = F.get(F.filter("all", lambda c: c["cluster"] == F.col("cluster")), F.lit(0))
    a = (own["n"] - 1 - (V.dot("u", own["s"]) - 1)) / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), lambda c: 1 - V.dot("u", c["s"]) / c["n"]))
    s = F.when(own["n"] <= 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    return j.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def fit_kmeans(vectors: DataFrame, k: int, *, seeds: int = 10, seed: int = 42, max_iter: int = 300) -> KMeansModel:
    """The best of several starts by training cost."""
    rows = vectors.select("id", array_to_vector("vec").alias("features")).cache()
    try:
        models = [KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features").fit(rows) for i in range(seeds)]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()


def refit(vectors: DataFrame, scan: list[tuple[int, float, float]], path: str, **options) -> KMeansModel:
    """A model of the scan's best K, fitted again and saved."""
    model = fit_kmeans(vectors, best_k(scan), **options)
    model.write().overwrite().save(path)
    return model


def assign(model: KMeansModel, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors.select("id", array_to_vector("vec").alias("features"))).select("id", F.col("prediction").alias("cluster"))


def scan_k(vectors: DataFrame, ks, *, seeds: int = 10, seed: int = 42, max_iter: int = 300) -> list[tuple[int, float, float]]:
    """(k, cost, silhouette) for each k by its best start, equal costs by the first; all fits share their passes over the vectors."""
    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL").cache()
    try:
        best: dict[int, kmeans.Fit] = {}
        for f in kmeans.fit_all(rows, ks, starts=seeds, seed=seed, max_iter=max_iter):
            if f.k not in best or f.cost < best[f.k].cost:
                best[f.k] = f
        return [(f.k, f.cost, x) for f, x in zip(best.values(), kmeans.silhouettes(rows, list(best.values())))] if best else []
    finally:
        rows.unpersist()


def best_k(scan: list[tuple[int, float, float]]) -> int:
    return max(scan, key=lambda r: (r[2], -r[0]))[0]
