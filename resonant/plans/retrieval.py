"""Queries on vocabularies, weights and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as Win, functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import expansion, reports, retrieval as R, topics as T
from ..sources.tables import spread_table as table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.words(F.col("text")).alias("tokens"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.words(F.col("text")).alias("tokens"))


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_idx"), X.words(F.col("text")).alias("tokens"))


def bm25_topk(s, d):
    return R.retrieve(_docs(s, d), _queries(s, d), k=10)


def tfidf_topk(s, d):
    return R.retrieve(_docs(s, d), _queries(s, d), k=10, scheme="tfidf")


def bm25_doc_weights(s, d):
    return R.doc_weights(_docs(s, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_doc_weights(s, d):
    return R.doc_weights(_docs(s, d), scheme="tfidf").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def bm25_query_weights(s, d):
    return R.query_weights(_queries(s, d), _docs(s, d)).select("query_id", "term", F.round("weight", 6).alias("weight"))


def _idf(s, d, scheme):
    docs = _docs(s, d)
    n = docs.agg(F.count("*")).scalar()
    return R.document_frequency(docs).select("term", "df", F.round(R.idf(n, F.col("df"), scheme), 9).alias("idf"))


def idf_bm25(s, d):
    return _idf(s, d, "bm25")


def idf_tfidf(s, d):
    return _idf(s, d, "tfidf")


def vocab_pruned_index(s, d):
    return R.vocabulary(_docs(s, d))


def vocab_counts(s, d):
    return R.document_frequency(_docs(s, d)).select("term", "cnt")


def doc_length_stats(s, d):
    return R.length_stats(_docs(s, d)).withColumn("avgdl", F.round("avgdl", 6))


def stopword_antijoin(s, d):
    words = s.sql("SELECT explode(array(" + ", ".join('"%s"' % w for w in C.STOP_WORDS) + ")) AS term").distinct()
    return R.token_rows(_docs(s, d)).join(F.broadcast(words), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


def bigram_counts(s, d):
    return R.term_counts(_docs(s, d), pairs=True).groupBy("term").agg(F.sum("tf").alias("cnt"), F.count("doc_id").alias("df"))


def sklearn_tfidf(s, d):
    docs = _docs(s, d).select("doc_id", F.filter("tokens", lambda x: F.length(x) > 1).alias("tokens"))
    return T.tfidf(docs, min_df=5, max_df_ratio=0.5).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_global_top(s, d):
    docs = _docs(s, d).select("doc_id", F.filter("tokens", lambda x: F.length(x) > 1).alias("tokens"))
    sums = T.tfidf(docs, min_df=5, max_df_ratio=0.5).groupBy("term").agg(F.round(F.sum("weight"), 5).alias("total"), F.count("*").alias("df"))
    order = Win.orderBy(F.desc("total"), "term")
    return sums.orderBy(F.desc("total"), "term").limit(200).withColumn("rank", F.row_number().over(order))


def hf_source_gate(s, d):
    """Tokens in at least 5 % of the posts."""
    return expansion.frequent_sources(_posts(s, d), min_df=5)


def newterm_gate(s, d):
    """New terms in at least 3 % of the posts, where the next turn of a conversation plays the expansion."""
    turns = table(s, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("tokens"))
    after = Win.partitionBy("conv_id").orderBy("turn")
    both = turns.select("conv_id", "turn", F.col("tokens").alias("clean"), F.lead("tokens").over(after).alias("tokens")).where("tokens is not null")
    return expansion.frequent_terms(both, min_df=3)


def length_histogram(s, d):
    return reports.length_histogram(_docs(s, d).select(F.size("tokens").cast("long").alias("n")))


def expansion_percentiles(s, d):
    out = reports.expansion_percentiles(_docs(s, d).select(F.size("tokens").alias("n_expanded"), F.size(F.array_distinct("tokens")).alias("n_clean")))
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "p50", "p90")), "n")


def top_words(s, d):
    return reports.top_words(vocab_counts(s, d), 20)


def label_distribution(s, d):
    return reports.label_distribution(table(s, d, "labels"), "quality", "toxic")


def stats_summary(s, d):
    docs, posts = R.length_stats(_docs(s, d)), R.length_stats(_posts(s, d))
    one = docs.select(F.col("n_docs").alias("n_docs"), F.round("avgdl", 6).alias("avg_doc_len"))
    return one.select("*", posts.select("n_docs").scalar().alias("n_posts"), F.round(posts.select("avgdl").scalar(), 6).alias("avg_post_len"), vocab_counts(s, d).agg(F.count("*")).scalar().alias("vocab"))


def page_title_link_extract(s, d):
    """Title and first link text of every page."""
    p = table(s, d, "pages")
    return p.select("page_id", F.trim(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)).alias("title"), F.regexp_extract("html", r"(?s)<a href=[^>]*>(.*?)</a>", 1).alias("first_link"), X.is_original_page(F.col("url")).alias("original"))


def weekly_dates(s, d):
    """Every chart week of a year."""
    days = s.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2023-01-01")), F.to_date(F.lit("2023-12-31")), F.expr("interval 7 days"))).alias("day"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"))


def align_left_drop(s, d):
    """Labelled documents with tokens, missing ones dropped."""
    ids = table(s, d, "labels").select("doc_id").distinct()
    return ids.join(_docs(s, d), "doc_id", "left").where(F.size(F.coalesce("tokens", F.array())) > 0).select("doc_id", F.size("tokens").cast("long").alias("n"))


_TOK = "SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS tokens FROM documents"
_BASE = f"""
WITH d AS ({_TOK}), st AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM d),
t AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cnt FROM tf GROUP BY term)"""
_Q = """,
q AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS tokens FROM benchmark),
qt AS (SELECT query_id, len(tokens) AS ql, unnest(tokens) AS term FROM q),
qtf AS (SELECT query_id, ql, term, count(*) AS tf FROM qt GROUP BY ALL)"""
_BM = "ln((st.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * {len} / st.avgdl))"
_TI = "tf / {len}::DOUBLE * ln(st.n / (df + 1))"


def _top(weight: str) -> str:
    return f"""{_BASE}{_Q},
dw AS (SELECT doc_id, term, {weight.format(len="dl")} AS w FROM tf JOIN df USING (term), st),
qw AS (SELECT query_id, term, {weight.format(len="ql")} AS w FROM qtf JOIN df USING (term), st),
sc AS (SELECT query_id, doc_id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL),
rk AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INT AS rank, doc_id, score FROM sc)
SELECT * FROM rk WHERE rank <= 10"""


_POSTS = "SELECT conv_id * 1000 + turn AS post_idx, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS tokens FROM conversations WHERE role = 'user'"
_LIST = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_SK = f"""
WITH d AS (SELECT doc_id, list_filter(tokens, lambda x: length(x) > 1) AS tokens FROM ({_TOK})), n AS (SELECT count(*)::DOUBLE AS n FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n WHERE df >= 5 AND df <= 0.5 * n),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r)"""

ORACLE_SQL = {
    "bm25_topk": _top(_BM),
    "tfidf_topk": _top(_TI),
    "bm25_doc_weights": f"{_BASE} SELECT doc_id, term, round({_BM.format(len='dl')}, 6) AS weight FROM tf JOIN df USING (term), st",
    "tfidf_doc_weights": f"{_BASE} SELECT doc_id, term, round({_TI.format(len='dl')}, 6) AS weight FROM tf JOIN df USING (term), st",
    "bm25_query_weights": f"{_BASE}{_Q} SELECT query_id, term, round({_BM.format(len='ql')}, 6) AS weight FROM qtf JOIN df USING (term), st",
    "idf_bm25": f"{_BASE} SELECT term, df, round(ln((st.n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM df, st",
    "idf_tfidf": f"{_BASE} SELECT term, df, round(ln(st.n / (df + 1)), 9) AS idf FROM df, st",
    "vocab_pruned_index": f"{_BASE} SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS col_idx FROM df, st WHERE df BETWEEN 5 AND floor(st.n * 0.5)",
    "vocab_counts": f"{_BASE} SELECT term, cnt FROM df",
    "doc_length_stats": f"WITH d AS ({_TOK}) SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl, sum(len(tokens))::BIGINT AS total, min(len(tokens))::BIGINT AS shortest, max(len(tokens))::BIGINT AS longest FROM d",
    "stopword_antijoin": f"WITH t AS (SELECT unnest(tokens) AS term FROM ({_TOK})) SELECT term, count(*) AS n FROM t WHERE term NOT IN ({_LIST(C.STOP_WORDS)}) GROUP BY term",
    "bigram_counts": f"WITH d AS ({_TOK}), b AS (SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS term FROM d) SELECT term, count(*) AS cnt, count(DISTINCT doc_id) AS df FROM b GROUP BY term",
    "sklearn_tfidf": f"{_SK} SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_global_top": f"{_SK}, g AS (SELECT term, round(sum(weight), 5) AS total, count(*) AS df FROM w GROUP BY term), k AS (SELECT *, (row_number() OVER (ORDER BY total DESC, term))::INT AS rank FROM g) SELECT term, total, df, rank FROM k WHERE rank <= 200",
    "hf_source_gate": f"WITH p AS ({_POSTS}), n AS (SELECT count(*) AS n FROM p), f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM p) GROUP BY term) SELECT term, df FROM f, n WHERE df >= 5 AND df >= 0.05 * n AND term NOT IN ({_LIST(C.GATE_EXEMPT)}) ORDER BY df DESC, term LIMIT 500",
    "newterm_gate": """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS tokens FROM conversations),
b AS (SELECT tokens AS clean, lead(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS tokens FROM t), k AS (SELECT * FROM b WHERE tokens IS NOT NULL), n AS (SELECT count(*) AS n FROM k),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_filter(list_distinct(tokens), lambda x: NOT list_contains(clean, x))) AS term FROM k) GROUP BY term)
SELECT term, df FROM f, n WHERE df >= 3 AND df >= 0.03 * n ORDER BY df DESC, term LIMIT 400""",
    "length_histogram": f"SELECT floor(log10(len(tokens)) * 5 + 1e-9)::INT AS bin, count(*) AS count FROM ({_TOK}) WHERE len(tokens) > 0 GROUP BY 1",
    "expansion_percentiles": f"WITH r AS (SELECT len(tokens) / nullif(len(list_distinct(tokens)), 0)::DOUBLE AS r FROM ({_TOK})) SELECT round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90, count(r) AS n FROM r",
    "top_words": f"{_BASE} SELECT CASE WHEN term IN ({_LIST(C.CENSORED)}) THEN left(term, 1) || repeat('*', length(term) - 1) ELSE term END AS term, cnt FROM df WHERE term NOT IN ({_LIST(C.DOMAIN_STOP_WORDS)}) ORDER BY cnt DESC, df.term LIMIT 20",
    "label_distribution": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "stats_summary": f"{_BASE}, p AS ({_POSTS}) SELECT st.n::BIGINT AS n_docs, round(st.avgdl, 6) AS avg_doc_len, (SELECT count(*) FROM p) AS n_posts, round((SELECT avg(len(tokens)) FROM p), 6) AS avg_post_len, (SELECT count(*) FROM df) AS vocab FROM st",
    "page_title_link_extract": "SELECT page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS title, regexp_extract(html, '(?s)<a href=[^>]*>(.*?)</a>', 1) AS first_link, NOT regexp_matches(lower(url), '" + "|".join(C.TRANSLATION_MARKS) + "') AS original FROM pages",
    "weekly_dates": "SELECT strftime(d, '%Y-%m-%d') AS day FROM generate_series(DATE '2023-01-01', DATE '2023-12-31', INTERVAL 7 DAY) AS t(d)",
    "align_left_drop": f"SELECT doc_id, len(tokens)::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM labels) JOIN ({_TOK}) USING (doc_id) WHERE len(tokens) > 0",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
