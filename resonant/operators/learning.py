"""Text classification: stratified split, multinomial logistic regression, evaluation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from . import retrieval as R, vectors as V
from ..sources.tables import written
from .topics import ngrams


def stratified(rows: DataFrame, label: str = "label", *, test: float = 0.2, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """rows with is_test: just so large a share of every class, chosen by a seeded hash of the key."""
    place = F.row_number().over(Win.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key))
    size = F.count("*").over(Win.partitionBy(label))
    return rows.withColumn("is_test", place <= F.round(size * test))


class TextClassifier:
    """TF-IDF of words and word pairs, then logistic regression (C as in public libraries: penalty 1 / (C n)).

    features: the vocabulary's bound, by corpus frequency; as large a number as wanted keeps every term.
    tol: L-BFGS stops at a gradient or an improvement of this share of the loss; 1e-4 is the usual tolerance of public libraries.
    """

    def __init__(self, *, most: int = 2, min_df: int = 2, features: int = 50_000, c: float = 1.0, max_iter: int = 2000, tol: float = 1e-4):
        self.most, self.min_df, self.features, self.c, self.max_iter, self.tol = most, min_df, features, c, max_iter, tol
        self.words: CountVectorizerModel
        self.model: LogisticRegressionModel

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_terms", ngrams(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b(\w\w+)\b"), 1), self.most))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return Normalizer(inputCol="_idf", outputCol="features").transform(self.idf.transform(self.words.transform(self._counted(rows))))

    def fit(self, rows: DataFrame) -> TextClassifier:
        """rows: (text, label)."""
        counts = self._counted(rows)
        # each text is counted where it is read and terms by an aggregate that can spill; lists of terms are never kept
        per_row = R.term_counts(counts.select(F.monotonically_increasing_id().alias("doc_id"), F.col("_terms").alias("tokens")))
        df = per_row.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt"))
        found = df.where(F.col("df") >= self.min_df).orderBy(F.desc("cnt"), "term").limit(self.features)
        self.words = CountVectorizerModel.from_vocabulary([r["term"] for r in found.select("term").collect()], inputCol="_terms", outputCol="_tf")
        counted = written(self.words.transform(counts).select("_tf", "label"), "counted")
        self.idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
        features = Normalizer(inputCol="_idf", outputCol="features").transform(self.idf.transform(counted)).select("features", "label")
        self.model = LogisticRegression(family="multinomial", regParam=1 / (self.c * max(counted.count(), 1)), standardization=False, maxIter=self.max_iter, tol=self.tol).fit(features)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with `p` (class probabilities) and `predicted`."""
        out = self.model.transform(self._vectors(rows))
        return out.select(*rows.columns, vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("predicted"))


def renormalized(p) -> Column:
    s = F.greatest(V.total(p), F.lit(1e-8))
    return F.transform(V._c(p), lambda x: x / s)


def in_top(p, label, k: int = 2) -> Column:
    """Whether the label is among the k most likely classes; of equally likely ones the later."""
    own = F.get(V._c(p), V._c(label))
    better = F.filter(V._c(p), lambda x, i: (x > own) | ((x == own) & (i > V._c(label))))
    return F.size(better) < k


def top_k_accuracy(rows: DataFrame, k: int = 2) -> DataFrame:
    return rows.agg(F.avg(in_top("p", "label", k).cast("int")).alias("accuracy"))


def threshold_hits(rows: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Share of rows whose label is among the classes that reach the threshold, or is the likeliest if none does."""
    return rows.agg(F.avg(F.get(V.multi_hot("p", threshold), F.col("label"))).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_report(rows: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1)."""
    n = confusion(rows)
    hit = n.where("label = predicted").select("label", F.col("n").alias("hit"))
    real = n.groupBy("label").agg(F.sum("n").alias("support"))
    said = n.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    j = real.join(said, "label", "left").join(hit, "label", "left").select("label", "support", F.coalesce("said", F.lit(0)).alias("said"), F.coalesce("hit", F.lit(0)).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.col("hit") / F.col("support")
    return j.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
