"""Queries that go through files: tables written by the package's sinks and read back by its readers, with their SQL."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import emotion, graph as G, reports, retrieval as R, topics as T, vectors as V
from ..sources import tables as S
from ..sources.tables import spread_table as table
from . import retrieval as PR, vectors as PV


_folder = S.new_place


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", X.words(F.col("text")).alias("tokens"))


def _index(s, d):
    path = _folder(s, "index")
    S.save_index(R.build_index(_docs(s, d)), path)
    return S.read_index(s, path)


def stored_index_topk(s, d):
    return R.query_index(_index(s, d), PR._queries(s, d), k=10)


def stored_index_metadata(s, d):
    return _index(s, d).metadata.withColumn("avgdl", F.round("avgdl", 6))


def stored_index_pruned(s, d):
    """An index with bounds on df, and its documents' lengths."""
    path = _folder(s, "index")
    S.save_index(R.build_index(_docs(s, d), min_df=5, max_df_ratio=0.5), path)
    index = S.read_index(s, path)
    per_term = index.postings.groupBy("term").agg(F.count("*").alias("n_postings"), F.round(F.sum("weight"), 4).alias("total"))
    return index.vocabulary.join(per_term, "term").select("term", "df", "col_idx", "n_postings", "total")


def idf_export(s, d):
    path = _folder(s, "idf")
    S.write_idf(_index(s, d), path)
    return s.read.schema("term string, df long, idf double").json(path).select("term", "df", F.round("idf", 9).alias("idf"))


def titled_hits(s, d):
    """The best documents with the title and artist of a catalogue that lacks some of them."""
    hits = R.retrieve(_docs(s, d), PR._queries(s, d), k=10)
    songs = table(s, d, "part").where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), F.col("p_brand").alias("artist"))
    return R.display_lines(R.with_titles(hits, songs))


def stored_candidates(s, d):
    path = _folder(s, "candidates")
    S.write_candidates(R.retrieve(_docs(s, d), PR._queries(s, d), k=10), path)
    nested = s.read.schema("query_id long, candidates array<struct<rank:int,doc_id:long,score:double>>").json(path)
    return nested.select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.*")


def _catalogue(s, d):
    h = PV._halves(s, d)
    return h, h.where(f"id % {PV.QUERY_STEP} = 0").select(F.col("id").alias("query_id"), F.col("emotion").alias("qe"), F.col("topic").alias("qt"))


def _stored_graph(s, d):
    vectors = PV._vectors(s, d)
    edges = G.similarity_graph(vectors)
    path = _folder(s, "graph")
    edges = S.written(edges, "edges")
    S.write_graph(edges, G.graph_stats(edges, vectors.count()), path)
    PV._halves(s, d).write.parquet(f"{path}/vectors")
    return S.read_graph(s, path, f"{path}/vectors")


def stored_graph(s, d):
    """Statistics of a stored graph and of its nodes' vectors."""
    edges, metadata, vectors = _stored_graph(s, d)
    return metadata.select("num_edges", F.round("avg_degree", 6).alias("avg_degree"), F.round("sparsity", 6).alias("sparsity")).withColumns(
        {"total": edges.agg(F.round(F.sum("weight"), 4)).scalar(), "n_vectors": vectors.agg(F.count("*")).scalar(), "width": vectors.agg(F.max(F.size("emotion") + F.size("topic")).cast("long")).scalar()}
    )


def stored_recommendations(s, d):
    """Recommendations of one call over a stored graph, written and read."""
    edges, _, nodes = _stored_graph(s, d)
    _, queries = _catalogue(s, d)
    path = _folder(s, "recommendations")
    S.write_recommendations(G.recommend(edges, nodes, queries, fixed=3), path)
    nested = s.read.schema("query_id long, recommendations array<struct<rank:int,doc_id:long,score:double>>").json(path)
    return nested.select("query_id", F.explode("recommendations").alias("c")).select("query_id", "c.*")


def aligned_positions(s, d):
    """Posts whose position has a row in both vector tables."""
    v = PV._halves(s, d).withColumnRenamed("id", "post_idx")
    posts = s.range(0, 10_000).select((F.col("id") * 3).alias("post_idx"))
    out = G.aligned_queries(posts, v.where("post_idx % 2 = 0").select("post_idx", F.col("emotion").alias("vec")), v.select("post_idx", F.col("topic").alias("vec")))
    return out.select("query_id", F.round(F.get("qe", F.lit(0)), 6).alias("e"), F.round(F.get("qt", F.lit(0)), 6).alias("t"))


def align_policies(s, d):
    """Labelled and unknown ids with tokens, under both policies."""
    ids = table(s, d, "labels").select("doc_id").distinct().unionByName(s.range(10**9, 10**9 + 5).select(F.col("id").alias("doc_id")))
    out = None
    for policy in ("drop", "empty"):
        own = V.align_tokens(ids, _docs(s, d), "doc_id", policy).select(F.lit(policy).alias("policy"), "doc_id", F.size("tokens").cast("long").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def topic_terms_without_stops(s, d):
    """Document frequency and total weight of the terms that the topic model keeps."""
    docs = _docs(s, d).select("doc_id", T.without_stop_words(F.col("tokens")).alias("tokens"))
    return T.tfidf(docs, min_df=5, max_df_ratio=0.5).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 4).alias("total"))


def _posts(s, d):
    users = table(s, d, "conversations").where("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), X.words(F.col("text")).alias("tokens"))


def post_ngram_tfidf(s, d):
    return T.ngram_tfidf(_posts(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 4).alias("total"))


def classifier_ngram_tfidf(s, d):
    docs = _docs(s, d).join(table(s, d, "labels").select("doc_id").distinct(), "doc_id")
    return T.ngram_tfidf(docs, stop_words=()).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 3).alias("total"))


def pairs_above_threshold(s, d):
    return T.pairs_above(PV.cluster_centroid_sims(s, d), 0.05)


def stored_clusters(s, d):
    """How many rows each artefact of a clustering has after a round trip."""
    assigned, path = PV._assigned(s, d), _folder(s, "clusters")
    scan = s.sql("SELECT * FROM VALUES (3, 1.5D, 0.2D), (4, 1.25D, 0.3D) AS t(k, cost, silhouette)")
    merged = T.merge_map(PV.cluster_centroid_sims(s, d), PV.K, threshold=0.1)
    terms = assigned.groupBy("cluster").agg(F.count("*").alias("mean")).select("cluster", F.lit(1).alias("rank"), F.concat(F.lit("a\tb"), F.col("cluster").cast("string")).alias("term"), "mean")
    S.write_clusters(path, scan=scan, assigned=assigned, sizes=T.cluster_sizes(assigned, PV.K), terms=terms, merged=merged)
    read = {n: s.read.csv(f"{path}/{n}", sep="\t", header=True) for n in ("scan", "keywords")} | {n: s.read.json(f"{path}/{n}") for n in ("sizes", "merged", "assignments")}
    out = None
    for name, rows in read.items():
        own = rows.agg(F.lit(name).alias("artefact"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def stored_model(s, d):
    """A k-means model that is saved and loaded assigns every row as before."""
    v, path = PV._vectors(s, d), _folder(s, "model")
    model = T.refit(v, [(4, 2.0, 0.1), (PV.K, 1.0, 0.2)], path, seeds=2, max_iter=20)
    loaded = KMeansModel.load(path)
    both = T.assign(model, v).join(T.assign(loaded, v).withColumnRenamed("cluster", "again"), "id")
    return both.agg(F.count("*").alias("n"), F.sum((F.col("cluster") == F.col("again")).cast("long")).alias("same"), (F.max("cluster") + 1).alias("k"))


def tokens_csv(s, d):
    path = _folder(s, "tokens")
    rows = _docs(s, d).select(F.col("doc_id").cast("string").alias("song_id"), "tokens")
    S.write_tokens_csv(rows, path)
    return S.read_tokens_csv(s, path).select("song_id", F.col("token_count").cast("long").alias("token_count"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def tokens_csv_last_wins(s, d):
    """Every id is written many times, in the order of documents over files; padded and empty ones are there, too."""
    path = _folder(s, "tokens")
    rows = _docs(s, d).select((F.col("doc_id") % 50).alias("k"), "doc_id", "tokens")
    ids = F.when(F.col("k") == 7, "").otherwise(F.concat(F.lit(" id"), F.col("k").cast("string")))
    S.write_tokens_csv(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(ids.alias("song_id"), "tokens"), path)
    return S.read_tokens_csv(s, path, last_wins=True).select("song_id", F.size("tokens").cast("long").alias("n"))


def _as_text(value: DataFrame, path: str) -> None:
    value.coalesce(1).write.text(path)


def json_array_scan(s, d):
    """A JSON array and the same rows line by line, both told apart by their first character; and all files of a folder by pattern."""
    nation, path = table(s, d, "nation").select("n_nationkey", "n_name"), _folder(s, "json")
    _as_text(nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")), f"{path}/array")
    S.write_json(nation.coalesce(1), f"{path}/lines")
    schema, out = "n_nationkey long, n_name string", None
    for kind, rows in (("array", S.read_json_any(s, f"{path}/array", schema)), ("lines", S.read_json_any(s, f"{path}/lines", schema)), ("files", S.read_json_files(s, f"{path}/array", "part-*.txt", schema))):
        own = rows.select(F.lit(kind).alias("kind"), "n_nationkey", "n_name")
        out = own if out is None else out.unionByName(own)
    return out


def json_map_scan(s, d):
    path = _folder(s, "map")
    entry = F.struct(F.col("n_name").alias("k"), F.struct(F.col("n_name").alias("artist"), F.col("n_nationkey").cast("string").alias("song"), F.col("n_regionkey").cast("string").alias("lyrics")).alias("v"))
    _as_text(table(s, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")), path)
    return S.read_json_map(s, path)


def vocabulary_scan(s, d):
    path = _folder(s, "vocabulary")
    counts = table(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    _as_text(counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n")))).alias("value")), path)
    return S.read_vocabulary(s, path)


def posts_jsonl(s, d):
    """Posts by line with the fallbacks of their text, without the last fallback, and the first ones only."""
    path = _folder(s, "posts")
    turns = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), X.words(F.col("text")).alias("w"), "turn")
    none = F.array().cast("array<string>")
    rows = turns.select("id", F.when(F.col("turn") % 3 == 0, F.slice("w", 1, 3)).otherwise(none).alias("expanded_tokens"), F.when(F.col("turn") % 2 == 0, F.slice("w", 1, 2)).otherwise(none).alias("clean_tokens"), F.concat(F.lit("raw "), F.col("id").cast("string")).alias("raw_text"))
    S.write_json(rows.coalesce(1).sortWithinPartitions("id").drop("id"), path)
    out = None
    for kind, posts in (("all", S.read_posts(s, path)), ("clean", S.read_posts(s, path, prefer="clean_tokens", raw_text=False)), ("first", S.read_posts(s, path, limit=5))):
        own = posts.select(F.lit(kind).alias("kind"), "post_idx", "text")
        out = own if out is None else out.unionByName(own)
    return out


def lexicon_scan(s, d):
    path = _folder(s, "lexicon")
    rows = table(s, d, "part").select(F.concat(F.lit(" W"), (F.col("p_partkey") % 40).cast("string")).alias("word"), F.when(F.col("p_size") % 2 == 0, "Joy").otherwise("fear").alias("label"), (F.col("p_partkey") % 3 == 0).cast("int").cast("string").alias("flag"))
    rows.write.csv(path, sep="\t", ignoreLeadingWhiteSpace=False)
    return S.read_lexicon(s, path)


def emoji_scan(s, d):
    path = _folder(s, "emoji")
    rows = table(s, d, "part").select(F.col("p_name").alias("phrase"), F.element_at(F.array(F.lit("😀"), F.lit("❤")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("emoji"))
    rows.write.csv(path, sep="\t")
    return S.read_emoji(s, path).groupBy("emoji", "phrase").agg(F.count("*").alias("n"))


def merge_map_scan(s, d):
    path = _folder(s, "merge")
    groups = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("g"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "g"))), lambda x: x["g"])
    _as_text(groups.agg(F.to_json(F.struct(listed.alias("groups"))).alias("value")), path)
    return S.read_merge_map(s, path)


def labelled_scan(s, d):
    """A labelled table of unknown columns; texts that are empty and labels that are unknown go."""
    path = _folder(s, "labelled")
    rows = table(s, d, "part").select(F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("sentence"), F.element_at(F.array(*(F.lit(x) for x in ("joy", " FEAR", "2", "9"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("emotion"))
    S.write_json(rows, path)
    return S.read_labelled(s, path, ("joy", "fear", "anger")).groupBy("text", "label").agg(F.count("*").alias("n"))


def vectors_scan(s, d):
    """Stored vectors aligned with more ids than there are; a vector of another width would be an error."""
    path = _folder(s, "vectors")
    PV._vectors(s, d).select("id", "vec").write.parquet(path)
    ids = s.range(0, 3000)
    return V.aligned(ids, s.read.parquet(path), "id", 64).select("id", F.round(V.norm("vec"), 6).alias("norm"))


def text_folder(s, d):
    path = _folder(s, "texts")
    table(s, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(f"{path}/deep/er")
    return S.read_folder(s, path).agg(F.sum(F.length("value")).alias("n_chars"))


def tsv_clean(s, d):
    path = _folder(s, "tsv")
    S.write_tsv(table(s, d, "part").select("p_partkey", S.tsv_safe(F.concat("p_name", F.lit("\t\n"), "p_brand")).alias("name")), path)
    return s.read.csv(path, sep="\t", header=True, schema="p_partkey long, name string")


def yearly_charts(s, d):
    weeks = table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("Song "), (F.col("o_custkey") % 40).cast("string")).alias("title"), F.concat(F.lit("A"), (F.col("o_custkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " feat. B").otherwise("")).alias("artist"))
    return reports.yearly_charts(weeks)


def bracket_examples(s, d):
    """Bracketed phrases with the first songs that hold them."""
    songs = table(s, d, "part").select(F.format_string("s%06d", "p_partkey").alias("song_id"), F.concat(F.lit("["), F.col("p_brand"), F.lit("]\nla ["), F.col("p_size").cast("string"), F.lit("x] [Verse "), (F.col("p_size") % 7).cast("string"), F.lit("]")).alias("lyrics"))
    return reports.bracket_report(songs).select("phrase", "class", "n", F.array_join("examples", ",").alias("examples"))


def length_medians(s, d):
    return reports.length_medians(_docs(s, d).select(F.size("tokens").alias("n")))


def ratio_histogram(s, d):
    return reports.ratio_histogram(_docs(s, d).select(F.size("tokens").alias("n_expanded"), F.size(F.array_distinct("tokens")).alias("n_clean")))


def english_detector(s, d):
    return table(s, d, "documents").select("doc_id", X.likely_english(F.col("text")).alias("english"))


def query_emotion_blend(s, d):
    h = PV._halves(s, d)
    out = h.select("id", emotion.query_blend("emotion", F.slice("topic", 1, 8), V.one_hot(F.col("label") % 8, 8)).alias("v"))
    return out.select("id", *(F.round(F.get("v", F.lit(i)), 6).alias(e) for i, e in enumerate(C.EMOTIONS)))


def rerank_popularity(s, d):
    """Neighbours of the queries by similarity, emotion, topic and popularity."""
    h = PV._halves(s, d)
    c = V.neighbours(PV._vectors(s, d).where(f"id % {PV.QUERY_STEP} = 0"), PV._vectors(s, d), top=20).select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id"), F.round("sim", 6).alias("score"))
    docs = h.withColumnRenamed("id", "doc_id").withColumn("popularity", F.col("label") / 10.0)
    return R.rerank(c, h.withColumnRenamed("id", "query_id"), docs, sem=0.4, pop=0.1).select("query_id", "rank", "doc_id", "fused")


_TOK = PR._TOK
_STOPS = PR._LIST(T.topic_stop_words())
_USER = "SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS tokens FROM conversations WHERE role = 'user'"
_FUSED = PV.ORACLE_SQL["rerank_fusion"]


def _ngrams(source: str, stops: str | None) -> str:
    kept = f"list_filter(tokens, lambda x: length(x) > 1{f' AND NOT list_contains([{stops}], x)' if stops else ''})"
    return f"""
d AS (SELECT doc_id, {kept} AS tokens FROM ({source})), n AS (SELECT count(*)::DOUBLE AS n FROM d),
g AS (SELECT doc_id, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term),
v AS (SELECT term, df FROM df WHERE df >= 2 ORDER BY cnt DESC, term LIMIT 50000),
r AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


_PHRASES = "SELECT p_partkey, format('s{:06d}', p_partkey) AS song_id, unnest([p_brand, p_size::VARCHAR || 'x', 'Verse ' || (p_size % 7)]) AS phrase FROM part"
_JSON = "SELECT n_nationkey, n_name FROM nation"
_TURNS = "SELECT conv_id * 1000 + turn AS id, turn, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS post_idx, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations"
ORACLE_SQL = {
    "stored_index_topk": PR.ORACLE_SQL["bm25_topk"],
    "stored_index_metadata": f"{PR._BASE} SELECT st.n::BIGINT AS n_docs, round(st.avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS vocab_size, 'bm25' AS scheme, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b, 1 AS min_df, 1.0::DOUBLE AS max_df_ratio, st.n::BIGINT AS max_df FROM st",
    "stored_index_pruned": f"""{PR._BASE}, v AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS col_idx FROM df, st WHERE df BETWEEN 5 AND floor(st.n * 0.5)),
w AS (SELECT term, {PR._BM.format(len='dl')} AS weight FROM tf JOIN df USING (term), st) SELECT term, df, col_idx, n_postings, total FROM v JOIN (SELECT term, count(*) AS n_postings, round(sum(weight), 4) AS total FROM w GROUP BY term) USING (term)""",
    "idf_export": PR.ORACLE_SQL["idf_bm25"],
    "titled_hits": f"""WITH h AS ({PR.ORACLE_SQL["bm25_topk"]}), p AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_type || ' ' || p_brand AS title, p_brand AS artist FROM part WHERE p_partkey % 3 <> 0),
j AS (SELECT query_id, rank, score, coalesce(title, 'Unknown') AS title, coalesce(artist, 'Unknown') AS artist FROM h LEFT JOIN p USING (doc_id))
SELECT query_id, rank, lpad(rank::VARCHAR, 2, ' ') || '. ' || CASE WHEN length(title) > 50 THEN left(title, 47) || '...' ELSE title END || ' - ' || artist AS line, score FROM j""",
    "stored_candidates": PR.ORACLE_SQL["bm25_topk"],
    "stored_graph": f"WITH {PV._TOPM}, n AS (SELECT count(*)::DOUBLE AS n FROM e) SELECT count(*) AS num_edges, round(count(*) / any_value(n), 6) AS avg_degree, round(1 - count(*) / any_value(n * n), 6) AS sparsity, round(sum(weight), 4) AS total, any_value(n)::BIGINT AS n_vectors, 28::BIGINT AS width FROM g, n",
    "stored_recommendations": PV.ORACLE_SQL["ppr_topk"],
    "aligned_positions": "SELECT vec_id AS query_id, round(embedding[1]::DOUBLE, 6) AS e, round(embedding[9]::DOUBLE, 6) AS t FROM embeddings WHERE vec_id % 6 = 0 AND vec_id < 30000",
    "align_policies": f"""WITH i AS (SELECT DISTINCT doc_id FROM labels UNION ALL SELECT range FROM range(1000000000, 1000000005)), j AS (SELECT i.doc_id, coalesce(len(tokens), 0)::BIGINT AS n FROM i LEFT JOIN ({_TOK}) t ON t.doc_id = i.doc_id)
SELECT 'drop' AS policy, * FROM j WHERE n > 0 UNION ALL SELECT 'empty', * FROM j""",
    "topic_terms_without_stops": PR._SK.replace("length(x) > 1", f"length(x) > 1 AND NOT list_contains([{_STOPS}], x)") + " SELECT term, count(*) AS df, round(sum(weight), 4) AS total FROM w GROUP BY term",
    "post_ngram_tfidf": f"WITH {_ngrams(_USER, _STOPS)} SELECT term, count(*) AS df, round(sum(weight), 4) AS total FROM w GROUP BY term",
    "classifier_ngram_tfidf": f"WITH {_ngrams(f'SELECT * FROM ({_TOK}) WHERE doc_id IN (SELECT doc_id FROM labels)', None)} SELECT doc_id, count(*) AS n_terms, round(sum(weight), 3) AS total FROM w GROUP BY doc_id",
    "pairs_above_threshold": f"WITH {PV._SIM} SELECT i, j, sim FROM s WHERE sim >= 0.05",
    "stored_clusters": f"SELECT 'scan' AS artefact, 2::BIGINT AS n UNION ALL SELECT 'keywords', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'sizes', {PV.K} UNION ALL SELECT 'merged', {PV.K} UNION ALL SELECT 'assignments', count(*) FROM embeddings",
    "stored_model": f"SELECT count(*) AS n, count(*) AS same, {PV.K} AS k FROM embeddings",
    "tokens_csv": f"SELECT doc_id::VARCHAR AS song_id, len(tokens)::BIGINT AS token_count, md5(coalesce(array_to_string(tokens, ' '), '')) AS digest FROM ({_TOK})",
    "tokens_csv_last_wins": f"SELECT 'id' || (doc_id % 50) AS song_id, len(arg_max(tokens, doc_id))::BIGINT AS n FROM ({_TOK}) WHERE doc_id % 50 <> 7 GROUP BY doc_id % 50",
    "json_array_scan": " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_JSON})" for k in ("array", "lines", "files")),
    "json_map_scan": "SELECT n_name AS key, n_name AS artist, n_nationkey::VARCHAR AS song, n_regionkey::VARCHAR AS lyrics FROM nation",
    "vocabulary_scan": "SELECT 'r' || n_regionkey AS term, count(*) AS cnt FROM nation GROUP BY n_regionkey",
    "posts_jsonl": f"""WITH t AS ({_TURNS}), x AS (SELECT post_idx, CASE WHEN turn % 3 = 0 AND len(w) > 0 THEN array_to_string(w[1:3], ' ') END AS e, CASE WHEN turn % 2 = 0 AND len(w) > 0 THEN array_to_string(w[1:2], ' ') END AS c, 'raw ' || id AS r FROM t)
SELECT 'all' AS kind, post_idx, coalesce(e, c, r) AS text FROM x UNION ALL SELECT 'clean', post_idx, coalesce(c, '') FROM x UNION ALL SELECT 'first', post_idx, coalesce(e, c, r) FROM x WHERE post_idx < 5""",
    "lexicon_scan": "SELECT DISTINCT 'w' || (p_partkey % 40) AS word, CASE WHEN p_size % 2 = 0 THEN 'joy' ELSE 'fear' END AS label FROM part WHERE p_partkey % 3 = 0",
    "emoji_scan": "SELECT CASE WHEN p_partkey % 2 = 0 THEN '😀' ELSE '❤' END AS emoji, trim(p_name) AS phrase, count(*) AS n FROM part GROUP BY ALL",
    "merge_map_scan": "SELECT n_nationkey::INT AS old_id, n_regionkey::INT AS new_id FROM nation",
    "labelled_scan": "WITH x AS (SELECT trim(p_name) AS text, [0, 1, 2, NULL][p_partkey % 4 + 1]::INT AS label FROM part WHERE p_partkey % 10 <> 0) SELECT text, label, count(*) AS n FROM x WHERE label IS NOT NULL GROUP BY ALL",
    "vectors_scan": f"WITH e AS ({PV._E}) SELECT i.range AS id, round(coalesce(sqrt(list_dot_product(vec, vec)), 0), 6) AS norm FROM range(3000) i LEFT JOIN e ON e.id = i.range",
    "text_folder": "SELECT sum(length(coalesce(text, '')) + 1)::BIGINT AS n_chars FROM documents",
    "tsv_clean": "SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part",
    "yearly_charts": "SELECT DISTINCT year(o_orderdate::DATE)::INT AS year, 'Song ' || (o_custkey % 40) AS title, 'A' || (o_custkey % 40) AS artist FROM orders",
    "bracket_examples": f"""WITH p AS ({_PHRASES}), c AS (SELECT phrase, count(*) AS n, array_to_string(list_sort(list(DISTINCT song_id))[1:5], ',') AS examples FROM p GROUP BY phrase)
SELECT phrase, CASE WHEN ends_with(phrase, 'x') THEN 'repeat_marker' WHEN starts_with(phrase, 'Verse') THEN 'section_marker' ELSE 'other' END AS class, n, examples FROM c ORDER BY n DESC, phrase LIMIT 200""",
    "length_medians": f"SELECT median(len(tokens))::DOUBLE AS median, count(*) AS n FROM ({_TOK}) WHERE len(tokens) > 0",
    "ratio_histogram": f"""WITH r AS (SELECT len(tokens) / nullif(len(list_distinct(tokens)), 0)::DOUBLE AS r FROM ({_TOK})), k AS (SELECT r FROM r WHERE r IS NOT NULL), e AS (SELECT min(r) AS lo, max(r) AS hi FROM k)
SELECT (CASE WHEN hi = lo THEN 1 ELSE least(floor((r - lo) / (hi - lo) * 20) + 1, 20) END)::INT AS bin, count(*) AS n FROM k, e GROUP BY 1""",
    "english_detector": f"SELECT doc_id, len(list_filter(tokens, lambda x: list_contains([{PR._LIST(C.STOP_WORDS)}], x))) >= 0.1 * greatest(len(tokens), 1) AS english FROM ({_TOK})",
    "query_emotion_blend": f"WITH e AS ({PV._E}) SELECT id, {', '.join(f'round(0.3 * vec[{i + 1}] + 0.3 * vec[{i + 9}] + (1 - 0.3::DOUBLE - 0.3::DOUBLE) * (label % 8 = {i})::INT, 6) AS {e}' for i, e in enumerate(C.EMOTIONS))} FROM e",
}
ORACLE_SQL["rerank_popularity"] = _FUSED.replace("0.5 * k.sim", "0.4 * k.sim").replace(", 0)), 0), 6) AS fused", ", 0)), 0) + 0.1 * (u.label / 10.0::DOUBLE), 6) AS fused").replace("JOIN h b ON b.id = dst WHERE", "JOIN h b ON b.id = dst JOIN e u ON u.id = dst WHERE")
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
