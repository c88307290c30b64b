"""Queries on vectors, graphs, topics and classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import graph as G, learning as L, retrieval as R, topics as T, vectors as V
from ..sources.tables import spread_table as table, written

K = 10
#: The stated query set of the searches: every id that is divisible by 20, against all rows.
QUERY_STEP = 20


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _halves(s, d):
    """Emotion and topic part of every vector."""
    v = _vectors(s, d)
    return v.select("id", F.slice("vec", 1, 8).alias("emotion"), F.slice("vec", 9, 20).alias("topic"), "label")


def _assigned(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def _probabilities(s, d):
    v = _vectors(s, d).select("id", F.slice("vec", 1, 8).alias("x"), (F.col("label") % 8).alias("label"))
    return v.select("id", "label", L.renormalized(F.transform("x", lambda x: F.abs(x))).alias("p"))


def combine_vectors_norms(s, d):
    v = _halves(s, d).withColumn("c", V.combined("emotion", "topic"))
    return v.select("id", F.round(V.norm("c"), 6).alias("norm"), F.round(F.get("c", F.lit(0)), 6).alias("first"), F.size("c").cast("long").alias("n"))


def knn_graph_topm(s, d):
    return G.similarity_graph(_vectors(s, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


def knn_graph_threshold(s, d):
    return G.similarity_graph(_vectors(s, d), strategy="threshold", threshold=0.4).select("src", "dst", F.round("weight", 6).alias("weight"))


def graph_stats(s, d):
    v = _vectors(s, d)
    out = G.graph_stats(G.similarity_graph(v), v.count())
    return out.select("num_edges", *(F.round(c, 6).alias(c) for c in ("avg_degree", "sparsity", "min_weight", "max_weight")))


def _asked(s, d):
    """The nodes, and the queries among them."""
    h = _halves(s, d)
    return h, h.where(f"id % {QUERY_STEP} = 0").select(F.col("id").alias("query_id"), F.col("emotion").alias("qe"), F.col("topic").alias("qt"))


def teleport_vector(s, d):
    h, q = _asked(s, d)
    return G.teleport(q, h).select("query_id", "id", F.round("v", 9).alias("v"))


def ppr_fixed_iter(s, d):
    out = G.walks(G.similarity_graph(_vectors(s, d)), *_asked(s, d), fixed=3)
    return out.select("query_id", "id", F.round("score", 9).alias("score"))


def ppr_topk(s, d):
    return G.recommend(G.similarity_graph(_vectors(s, d)), *_asked(s, d), fixed=3)


def ppr_converged(s, d):
    """Recommendations after the walk has settled for every query."""
    return G.recommend(G.similarity_graph(_vectors(s, d)), *_asked(s, d))


def topic_onehot(s, d):
    v = _assigned(s, d).select("id", V.one_hot(F.col("cluster") * 3, 20).alias("v"))
    return v.select("id", V.total("v").alias("ones"), F.array_position("v", 1.0).alias("at"))


def cluster_sizes_stats(s, d):
    return T.cluster_sizes(_assigned(s, d), 12, small=45)


def cluster_centroid_sims(s, d):
    return T.centroid_pairs(T.centroids(_vectors(s, d), _assigned(s, d))).select("i", "j", F.round("sim", 6).alias("sim"))


def cluster_pairs_topn(s, d):
    return cluster_centroid_sims(s, d).orderBy(F.desc("sim"), "i", "j").limit(20)


def cluster_merge_groups(s, d):
    return T.merge_map(cluster_centroid_sims(s, d), K, threshold=0.1)


def remapped_sizes(s, d):
    return T.remapped(_assigned(s, d), cluster_merge_groups(s, d)).groupBy("cluster").agg(F.count("*").alias("size"))


def topic_top_terms(s, d):
    docs = table(s, d, "documents").select("doc_id", F.filter(X.words(F.col("text")), lambda x: F.length(x) > 1).alias("tokens"))
    assigned = table(s, d, "documents").select("doc_id", F.col("lang").alias("cluster"))
    return T.top_terms(T.tfidf(docs, min_df=5, max_df_ratio=0.5), assigned).select("cluster", "rank", "term", F.round("mean", 6).alias("mean"))


def inertia(s, d):
    v, a = _vectors(s, d), _assigned(s, d)
    return T.inertia(v.select("id", "vec"), a, T.centroids(v, a)).select(F.round("inertia", 4).alias("inertia"))


def silhouette_cosine(s, d):
    return T.silhouette(_vectors(s, d).select("id", "vec"), _assigned(s, d), K).select(F.round("silhouette", 6).alias("silhouette"), "n")


def multihot_threshold(s, d):
    return _probabilities(s, d).select("id", F.array_join(V.multi_hot("p", 0.2).cast("array<string>"), "").alias("hot"))


def topk_accuracy(s, d):
    return L.top_k_accuracy(_probabilities(s, d)).select(F.round("accuracy", 6).alias("accuracy"))


def threshold_hit_accuracy(s, d):
    return L.threshold_hits(_probabilities(s, d)).select(F.round("accuracy", 6).alias("accuracy"))


def confusion_matrix(s, d):
    return L.confusion(table(s, d, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted")))


def class_report(s, d):
    out = L.class_report(table(s, d, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted")))
    return out.select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def rerank_fusion(s, d):
    """Neighbours of the queries, ranked again by similarity, emotion and topic."""
    h = _halves(s, d)
    c = V.neighbours(_vectors(s, d).where(f"id % {QUERY_STEP} = 0"), _vectors(s, d), top=20).select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id"), F.round("sim", 6).alias("score"))
    out = R.rerank(c, h.withColumnRenamed("id", "query_id"), h.withColumnRenamed("id", "doc_id"))
    return out.select("query_id", "rank", "doc_id", "fused")


def kmeans_scan(s, d):
    """Cost and silhouette for K of 3 to 30, ten starts each."""
    scan = T.scan_k(_vectors(s, d), range(3, 31))
    return s.createDataFrame([(k, float(c), float(x), k == T.best_k(scan)) for k, c, x in scan], "k int, cost double, silhouette double, best boolean")


def logreg_eval(s, d):
    """Held-out confusion of a quality classifier over the labelled documents."""
    docs = table(s, d, "documents").select("doc_id", "text")
    ids = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    rows = docs.join(written(L.stratified(ids), "split"), "doc_id")  # texts are not ranked along with their classes
    model = L.TextClassifier(features=50_000, max_iter=2000).fit(rows.where("not is_test").select("text", "label"))
    return L.confusion(model.predict(rows.where("is_test").select("doc_id", "text", "label")))


_E = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / nullif(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}), 0))"


_PAIRS = f"e AS ({_E}), p AS (SELECT a.id AS src, b.id AS dst, {_cos('a.vec', 'b.vec')} AS sim FROM e a, e b WHERE a.id <> b.id)"
_TOPM = f"{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst DESC) AS r FROM p), g AS (SELECT src, dst, sim AS weight FROM k WHERE r <= 20 AND sim > 0)"
_HALF = "h AS (SELECT id, vec[1:8] AS em, vec[9:28] AS tp FROM e)"
_TELE = f"{_HALF}, s AS (SELECT q.id AS query_id, h.id, 0.6 * coalesce({_cos('q.em', 'h.em')}, 0) + 0.4 * coalesce({_cos('q.tp', 'h.tp')}, 0) AS s FROM h q, h WHERE q.id % {QUERY_STEP} = 0), v AS (SELECT query_id, id, CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END AS v FROM s WINDOW w AS (PARTITION BY query_id))"
_WALK = "m AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM g), r0 AS (SELECT query_id, id, v, 1.0 / count(*) OVER (PARTITION BY query_id) AS r FROM v)"
for _i in range(3):
    _WALK += f", r{_i + 1} AS (SELECT a.query_id, a.id, any_value(a.v) AS v, 0.15::DOUBLE * coalesce(sum(m.w * b.r), 0) + 0.85::DOUBLE * any_value(a.v) AS r FROM r{_i} a LEFT JOIN m ON m.src = a.id LEFT JOIN r{_i} b ON b.query_id = a.query_id AND b.id = m.dst GROUP BY ALL)"
_PPR = f"WITH {_TOPM}, {_TELE}, {_WALK}"
_CEN = f"e AS ({_E}), f AS (SELECT id, label, unnest(vec) AS x, unnest(range(1, 65)) AS i FROM e), a AS (SELECT label, i, avg(x) AS x FROM f GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS vec FROM a GROUP BY label)"
_SIM = f"{_CEN}, s AS (SELECT a.label AS i, b.label AS j, round({_cos('a.vec', 'b.vec')}, 6) AS sim FROM c a, c b WHERE a.label < b.label)"
_MERGE = f"""{_SIM.replace('WITH ', '')}, l AS (SELECT i, j FROM s WHERE sim >= 0.1 UNION ALL SELECT j, i FROM s WHERE sim >= 0.1), n AS (SELECT range::INT AS i FROM range({K})),
reach(i, j) AS (SELECT i, i FROM n UNION SELECT reach.i, l.j FROM reach JOIN l ON reach.j = l.i), root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
sz AS (SELECT root, (row_number() OVER (ORDER BY count(*) DESC, root) - 1)::INT AS new_id FROM root GROUP BY root), mm AS (SELECT i AS old_id, new_id FROM root JOIN sz USING (root))"""
_P = "p AS (SELECT id, label % 8 AS label, list_transform(x, lambda y: y / greatest(list_sum(x), 1e-8)) AS p FROM (SELECT vec_id AS id, label, list_transform(embedding[1:8], lambda y: abs(y::DOUBLE)) AS x FROM embeddings))"
_SKTERMS = """
d AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) > 1) AS tokens FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM d),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(tokens) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT doc_id, lang, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n WHERE df >= 5 AND df <= 0.5 * n),
w AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r), z AS (SELECT lang, count(*) AS z FROM d GROUP BY lang),
m AS (SELECT lang, term, round(sum(weight) / any_value(z), 9) AS mean FROM w JOIN z USING (lang) GROUP BY ALL), k AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY mean DESC, term))::INT AS rank FROM m WHERE mean > 0)"""
_U = f"""e AS ({_E}), u AS (SELECT id, label, list_transform(vec, lambda x: x / sqrt({_dot('vec', 'vec')})) AS u FROM e), z AS (SELECT label, count(*) AS z FROM u GROUP BY label),
dd AS (SELECT a.id, a.label, b.label AS other, sum(1 - {_dot('a.u', 'b.u')}) FILTER (a.id <> b.id) AS s FROM u a, u b GROUP BY ALL),
ab AS (SELECT id, sum(s / (z - 1)) FILTER (dd.label = other) AS a, min(s / z) FILTER (dd.label <> other) AS b FROM dd JOIN z ON z.label = other WHERE z > 1 OR dd.label <> other GROUP BY id)"""

ORACLE_SQL = {
    "combine_vectors_norms": f"WITH e AS ({_E}), {_HALF}, n AS (SELECT id, em, sqrt({_dot('em', 'em')}) AS a, sqrt({_dot('tp', 'tp')}) AS b FROM h) SELECT id, round(sqrt((a / (a + 1e-8)) ** 2 + (b / (b + 1e-8)) ** 2), 6) AS norm, round(em[1] / (a + 1e-8), 6) AS first, 28::BIGINT AS n FROM n",
    "knn_graph_topm": f"WITH {_TOPM} SELECT src, dst, round(weight, 6) AS weight FROM g",
    "knn_graph_threshold": f"WITH {_PAIRS} SELECT src, dst, round(sim, 6) AS weight FROM p WHERE sim > 0.4",
    "graph_stats": f"WITH {_TOPM}, n AS (SELECT count(*)::DOUBLE AS n FROM e) SELECT count(*) AS num_edges, round(count(*) / any_value(n), 6) AS avg_degree, round(1 - count(*) / any_value(n * n), 6) AS sparsity, round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight FROM g, n",
    "teleport_vector": f"WITH e AS ({_E}), {_TELE} SELECT query_id, id, round(v, 9) AS v FROM v",
    "ppr_fixed_iter": f"{_PPR} SELECT query_id, id, round(r, 9) AS score FROM r3",
    "ppr_topk": f"{_PPR}, o AS (SELECT query_id, id AS doc_id, round(r, 9) AS score FROM r3), ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC))::INT AS rank, doc_id, score FROM o) SELECT * FROM ranked WHERE rank <= 10",
    "topic_onehot": "SELECT vec_id AS id, (label * 3 < 20)::INT::DOUBLE AS ones, CASE WHEN label * 3 < 20 THEN label * 3 + 1 ELSE 0 END::BIGINT AS at FROM embeddings",
    "cluster_sizes_stats": "SELECT n.range::INT AS cluster, count(e.label) AS size, count(e.label) < 45 AS is_small FROM range(12) n LEFT JOIN embeddings e ON e.label = n.range GROUP BY ALL",
    "cluster_centroid_sims": f"WITH {_SIM} SELECT i, j, sim FROM s",
    "cluster_pairs_topn": f"WITH {_SIM} SELECT i, j, sim FROM s ORDER BY sim DESC, i, j LIMIT 20",
    "cluster_merge_groups": f"WITH RECURSIVE {_MERGE} SELECT old_id, new_id FROM mm",
    "remapped_sizes": f"WITH RECURSIVE {_MERGE} SELECT new_id AS cluster, count(*) AS size FROM embeddings JOIN mm ON label = old_id GROUP BY new_id",
    "topic_top_terms": f"WITH {_SKTERMS} SELECT lang AS cluster, rank, term, round(mean, 6) AS mean FROM k WHERE rank <= 12",
    "inertia": f"WITH {_CEN} SELECT round(sum((f.x - a.x) ** 2), 4) AS inertia FROM f JOIN a USING (label, i)",
    "silhouette_cosine": f"WITH {_U} SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM ab",
    "multihot_threshold": f"WITH {_P} SELECT id, array_to_string(CASE WHEN list_max(p) >= 0.2 THEN list_transform(p, lambda x: (x >= 0.2)::INT) ELSE list_transform(p, lambda x, i: (i = list_position(p, list_max(p)))::INT) END, '') AS hot FROM p",
    "topk_accuracy": f"WITH {_P} SELECT round(avg((len(list_filter(p, lambda x, i: x > p[label + 1] OR x = p[label + 1] AND i > label + 1)) < 2)::INT), 6) AS accuracy FROM p",
    "threshold_hit_accuracy": f"WITH {_P} SELECT round(avg((CASE WHEN list_max(p) >= 0.2 THEN p[label + 1] >= 0.2 ELSE list_position(p, list_max(p)) = label + 1 END)::INT), 6) AS accuracy FROM p",
    "confusion_matrix": "SELECT quality AS label, 1 - toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL",
    "class_report": "WITH l AS (SELECT quality AS y, 1 - toxic AS p FROM labels), c AS (SELECT y AS label, count(*) AS support, count(*) FILTER (y = p) AS hit FROM l GROUP BY y), s AS (SELECT c.*, (SELECT count(*) FROM l WHERE p = c.label) AS said FROM c) SELECT label, support, round(coalesce(hit / nullif(said, 0)::DOUBLE, 0), 6) AS precision, round(hit / support::DOUBLE, 6) AS recall, round(coalesce(2 * hit / nullif(said + support, 0)::DOUBLE, 0), 6) AS f1 FROM s",
    "rerank_fusion": f"WITH {_PAIRS}, {_HALF}, k AS (SELECT src, dst, round(sim, 6) AS sim, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst DESC) AS r FROM p WHERE src % {QUERY_STEP} = 0), f AS (SELECT src AS query_id, dst AS doc_id, round(0.5 * k.sim + 0.3 * coalesce({_cos('a.em', 'b.em')}, 0) + 0.2 * coalesce({_cos('a.tp', 'b.tp')}, 0), 6) AS fused FROM k JOIN h a ON a.id = src JOIN h b ON b.id = dst WHERE r <= 20) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id DESC))::INT AS rank, doc_id, fused FROM f",
}
QUERIES = {n: globals()[n] for n in [*ORACLE_SQL, "ppr_converged", "kmeans_scan", "logreg_eval"]}
