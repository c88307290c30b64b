"""Vocabulary, weights and ranked retrieval over long tables of (doc_id, term).

Nothing is a matrix: tokens, postings and weights are rows, so every step is a hash aggregate or an
equi-join that Catalyst can plan. Scoring joins only the postings of terms that queries have.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as Win, functions as F

from ..sources.tables import written

K1, B = 1.5, 0.75
#: Tokens that a worker counts at once.
PIECE = 1 << 18


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, term) for every token of (doc_id, tokens); n is the length with all tokens."""
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("term"))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about PIECE tokens together."""
    if batch.num_rows:
        last = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // PIECE
        first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])).tolist()
        for a, b in zip(first, [*first[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _counts(pairs: bool):
    """For mapInArrow over (doc_id, tokens): every row's different terms, or pairs of words that follow each other, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            tokens = batch.column(1)
            row = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
            coded = pc.dictionary_encode(pc.list_flatten(tokens), null_encoding="encode")
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            n = np.bincount(row, minlength=batch.num_rows)
            if pairs:
                follows = np.flatnonzero(row[1:] == row[:-1])
                row, code, other = row[follows], code[follows], code[follows + 1]
                number, code = np.unique(code * max(len(words), 1) + other, return_inverse=True)
            most = int(code.max()) + 1 if len(code) else 1
            own, tf = np.unique(row * most + code, return_counts=True)
            row, code = np.divmod(own, most)
            if pairs:
                one, two = np.divmod(number[code], max(len(words), 1))
                terms = pc.binary_join_element_wise(words.take(pa.array(one)), words.take(pa.array(two)), " ")
            else:
                terms = words.take(pa.array(code))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(n[row]), terms, pa.array(tf)], ["doc_id", "n", "term", "tf"])

    return run


def term_counts(docs: DataFrame, *, pairs: bool = False) -> DataFrame:
    """(doc_id, n, term, tf), n the number of all tokens; pairs: of words that follow each other, joined by a space, by document alone (n is the least).

    A document is counted where it is read, so that neither tokens nor counts are shuffled. Only where an id has several rows are their counts added up.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "tokens").mapInArrow(_counts(pairs), f"doc_id {kind}, n long, term string, tf long")
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return out
    if pairs:
        return out.groupBy("doc_id", "term").agg(F.min("n").alias("n"), F.sum("tf").alias("tf")).select("doc_id", "n", "term", "tf")
    return out.groupBy("doc_id", "n", "term").agg(F.sum("tf").alias("tf"))


def length_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl (0 for no documents), total, shortest, longest."""
    n = F.size("tokens").cast("long")
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df, cnt): in how many documents a term occurs, and how often."""
    return term_counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt"))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their position (from 0) in the order of a column without repeats, and no task that sorts them all.

    Ranges of the column are sorted apart; the ranges' sizes, one row each, give where they start.
    """
    ranged = written(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    size = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    start = size.select("_part", (F.sum("n").over(Win.orderBy("_part")) - F.col("n")).alias("_start"))
    place = F.row_number().over(Win.partitionBy("_part").orderBy(by)).cast("long") - 1
    return ranged.join(F.broadcast(start), "_part").withColumn(name, place + F.col("_start")).drop("_part", "_start")


def vocabulary(docs: DataFrame, *, existing: DataFrame | None = None, min_df: int = 5, max_df_ratio: float = 0.5) -> DataFrame:
    """(term, df, col_idx); an existing vocabulary (term, ...) is kept whole, else bounds on df apply."""
    df = document_frequency(docs).select("term", "df")
    if existing is not None:
        kept = existing.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    else:
        most = docs.agg(F.floor(F.count("*") * max_df_ratio).alias("m")).scalar()
        kept = df.where((F.col("df") >= min_df) & (F.col("df") <= most))
    return numbered(kept, "term", "col_idx")


def idf(n_docs: Column, df: Column, scheme: str = "bm25") -> Column:
    if scheme == "bm25":
        return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
    if scheme == "tfidf":
        return F.log(n_docs / (df + 1))
    raise ValueError(f"unknown idf scheme: {scheme}")


def bm25(weight: Column, tf: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / avgdl))


def _scalars(docs: DataFrame) -> tuple[Column, Column]:
    stats = length_stats(docs)
    return stats.select("n_docs").scalar(), stats.select("avgdl").scalar()


def doc_weights(docs: DataFrame, *, scheme: str = "bm25", k1: float = K1, b: float = B, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight) of documents, for all terms or those of `terms`."""
    n_docs, avgdl = _scalars(docs)
    tf = term_counts(docs)
    if terms is not None:
        tf = tf.join(terms.select("term").distinct(), "term", "left_semi")
    tf = written(tf, "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(df, "term")
    weight = idf(n_docs, F.col("df"), scheme)
    value = bm25(weight, F.col("tf"), F.col("n"), avgdl, k1, b) if scheme == "bm25" else F.col("tf") / F.col("n") * weight
    return joined.select("doc_id", "term", value.alias("weight"))


def query_weights(queries: DataFrame, docs: DataFrame, *, scheme: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, term, weight): a query is weighted as a short document, with the documents' df and average length."""
    if scheme not in ("bm25", "tfidf"):
        raise ValueError(f"unknown mode: {scheme}")
    n_docs, avgdl = _scalars(docs)
    q = term_counts(queries.select(F.col("query_id").alias("doc_id"), "tokens"))
    df = token_rows(docs).join(q.select("term").distinct(), "term").select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(n_docs, F.col("df"), scheme)
    value = bm25(weight, F.col("tf"), F.col("n"), avgdl, k1, b) if scheme == "bm25" else F.col("tf") / F.col("n") * weight
    return q.join(df, "term").select(F.col("doc_id").alias("query_id"), "term", value.alias("weight"))


def top_k(scores: DataFrame, k: int, *, by: str = "score", group: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with their rank; equal scores by the larger id."""
    order = Win.partitionBy(group).orderBy(F.desc(by), F.desc(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scores(query: DataFrame, doc: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score): sums of products over common terms."""
    pair = query.withColumnRenamed("weight", "qw").join(doc.withColumnRenamed("weight", "dw"), "term")
    return pair.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), digits).alias("score"))


def part_of_weight(scheme: str, tf: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """A weight without its idf."""
    return bm25(F.lit(1.0), tf, n, avgdl, k1, b) if scheme == "bm25" else tf / n


def ranked_scores(queries: DataFrame, postings: DataFrame, terms: DataFrame, avgdl: float, *, scheme: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) from postings (term, doc_id, part: the weight without its idf) and terms (term, idf).

    The idf of both sides goes to the query's, which is written and so has a known size: Spark broadcasts it up to its
    own bound and beyond that joins by term, where adaptive execution splits the postings of frequent terms. Postings that
    are asked for are dealt by document first, so that a score is added up where its parts are made and the parts aren't shuffled.
    """
    q = term_counts(queries.select(F.col("query_id").alias("doc_id"), "tokens")).join(terms, "term")
    q = q.select(F.col("doc_id").alias("query_id"), "term", (part_of_weight(scheme, F.col("tf"), F.col("n"), F.lit(avgdl), k1, b) * F.col("idf") * F.col("idf")).alias("qw"))
    q = written(q, "query")
    own = postings.select("term", "doc_id", "part").join(q.select("term").distinct(), "term", "left_semi").repartition("doc_id")
    pair = own.join(q, "term")
    return pair.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("part")), 6).alias("score"))


def retrieve(docs: DataFrame, queries: DataFrame, *, k: int = 100, scheme: str = "bm25", include_zero: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query.

    Documents are counted for the terms of the queries only, in one scan; these postings are written, and df is counted from them.
    include_zero fills up queries with fewer than k matches with documents of score 0, the largest
    ids first; no more than 2k ids can be needed for that.
    """
    if scheme not in ("bm25", "tfidf"):
        raise ValueError(f"unknown mode: {scheme}")
    n_docs, avgdl = length_stats(docs).select("n_docs", "avgdl").first()
    asked = written(queries.select(F.explode("tokens").alias("term")).distinct(), "terms")
    tf = written(token_rows(docs.repartition("doc_id")).join(asked, "term").groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf")), "postings")
    terms = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", idf(F.lit(n_docs), F.col("df"), scheme).alias("idf"))
    postings = tf.select("term", "doc_id", part_of_weight(scheme, F.col("tf"), F.col("n"), F.lit(avgdl)).alias("part"))
    found = ranked_scores(queries, postings, terms, avgdl, scheme=scheme)
    if include_zero:
        best = top_k(found, k)
        last = docs.select("doc_id").orderBy(F.desc("doc_id")).limit(2 * k)
        short = queries.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
        fill = short.select("query_id", F.explode(last.agg(F.collect_list("doc_id")).scalar()).alias("doc_id"))
        found = best.drop("rank").unionByName(fill.join(best, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0)))
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")


class Index(NamedTuple):
    """A stored retrieval index."""

    documents: DataFrame  # doc_id, n (tokens)
    vocabulary: DataFrame  # term, df, col_idx
    idf: DataFrame  # term, idf
    postings: DataFrame  # term, doc_id, part, weight
    metadata: DataFrame  # one row: n_docs, avgdl, vocab_size, scheme, k1, b, min_df, max_df_ratio, max_df


def build_index(docs: DataFrame, *, scheme: str = "bm25", k1: float = K1, b: float = B, min_df: int = 1, max_df_ratio: float = 1.0, existing: DataFrame | None = None) -> Index:
    """Every table of an index over (doc_id, tokens); terms outside the vocabulary have no postings. `save_index` writes it."""
    n_docs, avgdl = length_stats(docs).select("n_docs", "avgdl").first()
    tf = written(term_counts(docs), "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    max_df = int(n_docs * max_df_ratio)
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df)) if existing is None else existing.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    words = numbered(kept, "term", "col_idx")
    weights = words.select("term", idf(F.lit(n_docs), F.col("df"), scheme).alias("idf"))
    part = part_of_weight(scheme, F.col("tf"), F.col("n"), F.lit(avgdl), k1, b)
    postings = tf.join(weights, "term").select("term", "doc_id", part.alias("part"), (part * F.col("idf")).alias("weight"))
    one = words.agg(F.count("*").alias("vocab_size")).select(
        F.lit(n_docs).alias("n_docs"), F.lit(avgdl).alias("avgdl"), "vocab_size", F.lit(scheme).alias("scheme"), F.lit(k1).alias("k1"), F.lit(b).alias("b"),
        F.lit(min_df).alias("min_df"), F.lit(max_df_ratio).alias("max_df_ratio"), F.lit(max_df).cast("long").alias("max_df"),
    )
    return Index(docs.select("doc_id", F.size("tokens").cast("long").alias("n")), words, weights, postings, one)


def query_index(index: Index, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) of (query_id, tokens) from a stored index, with nothing counted again."""
    m = index.metadata.first()
    found = ranked_scores(queries, index.postings, index.idf, m["avgdl"], scheme=m["scheme"], k1=m["k1"], b=m["b"])
    return top_k(found, k).select("query_id", "rank", "doc_id", "score")


def with_titles(ranked: DataFrame, songs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """ranked with title and artist of (key, title, artist); "Unknown" where there is none."""
    named = songs.select(key, "title", "artist")
    return ranked.join(named, key, "left").select(*ranked.columns, *(F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("title", "artist")))


def display_lines(titled: DataFrame, *, width: int = 50) -> DataFrame:
    """(query_id, rank, line, score): one printable line for each hit; longer names end in dots."""
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(F.col(c))
    return titled.select("query_id", "rank", F.format_string("%2d. %s - %s", F.col("rank"), cut("title"), cut("artist")).alias("line"), "score")


def rerank(candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, *, sem: float = 0.5, emo: float = 0.3, topic: float = 0.2, pop: float = 0.0) -> DataFrame:
    """Extended: weighted sum of retrieval score, emotion and topic cosine, and popularity, ranked within each query."""
    from .vectors import cosine

    j = candidates.join(query_vectors.select("query_id", F.col("emotion").alias("qe"), F.col("topic").alias("qt")), "query_id")
    j = j.join(doc_vectors.select("doc_id", F.col("emotion").alias("de"), F.col("topic").alias("dt"), *(["popularity"] if pop else [])), "doc_id")
    fused = sem * F.col("score") + emo * cosine("qe", "de") + topic * cosine("qt", "dt") + (pop * F.col("popularity") if pop else F.lit(0.0))
    return top_k(j.select("query_id", "doc_id", F.round(fused, 6).alias("fused")), 1 << 30, by="fused")
