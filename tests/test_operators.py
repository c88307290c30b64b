"""Goldens, properties and small independent computations for operators that SQL cannot express."""

import json
import math
import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from resonant.functions import text as X
from resonant.functions.stemming import stem
from resonant.operators import dedup, emotion, expansion as Q, graph as G, kmeans, learning as L, posts as P, reports, retrieval as R, topics as T, vectors as V
from resonant.plans import registry
from resonant.sources import tables as S

SF = "/root/testdata/sf0.001"


def value(spark, column, data="x", x=None):
    return spark.createDataFrame([(x,)], f"{data} string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("df", "want"), [(18, 7.399381552902967), (14, 7.643003635560718), (6, 8.445350108085655)])
def test_idf_golden(spark, df, want):
    got = spark.range(1).select(R.idf(F.lit(30246), F.lit(df)).alias("v")).first()["v"]
    assert got == pytest.approx(want, abs=1e-12)


def test_unknown_schemes():
    with pytest.raises(ValueError):
        R.idf(F.lit(1), F.lit(1), "other")
    with pytest.raises(ValueError):
        G.similarity_graph(None, strategy="other")


def test_retrieval_small(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, []), (4, ["c", "c", "d"])], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["zzz"])], "query_id long, tokens array<string>")
    texts = {r.doc_id: r.tokens for r in docs.collect()}
    n, avg = 4, 2.0
    df = {t: sum(t in d for d in texts.values()) for t in "abcd"}

    def w(t, d):
        return math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))

    want = {i: round(sum(w(t, ["a", "b"]) * w(t, d) for t in "ab" if t in d), 6) for i, d in texts.items()}
    got = R.retrieve(docs, queries, k=3).collect()
    assert {(r.doc_id, r.score) for r in got} == {(i, s) for i, s in want.items() if s}
    whole = R.retrieve(docs, queries, k=3, include_zero=True).collect()
    assert sorted((r.query_id, r.rank) for r in whole) == [(q, k) for q in (1, 2, 3) for k in (1, 2, 3)]
    assert [r.doc_id for r in sorted(whole, key=lambda r: r.rank) if r.query_id == 2] == [4, 3, 2]


def test_vocabulary_kept(spark):
    docs = spark.createDataFrame([(1, ["b", "a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    known = spark.createDataFrame([("b",), ("z",)], "term string")
    assert [tuple(r) for r in R.vocabulary(docs, existing=known).orderBy("term").collect()] == [("b", 2, 0), ("z", 0, 1)]


PORTER = {"caresses": "caress", "ponies": "poni", "ties": "tie", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "dying": "die", "sky": "sky", "controll": "control"}


@pytest.mark.parametrize("word", PORTER)
def test_stems(word):
    assert stem(word) == PORTER[word]


@given(st.text("abcdeilnosty", min_size=1, max_size=12))
def test_stem_is_no_longer(word):
    assert len(stem(word)) <= len(word) + 1


def test_posts(spark):
    words = P.tag_dictionary(["mental", "health", "good", "okay", "to_do", "x"])
    assert P.tag_words("MentalHealth", words) == ["mental", "health"]
    assert P.tag_words("mentalhealth", words) == ["mental", "health"]
    assert P.tag_words("goodvibes", words) == ["good", "vibes"]
    assert P.tag_words("notgood", words) == ["not", "good"]
    assert P.tag_words("USA", words) == ["usa"]
    assert P.tag_words("qqqq", words) == ["qqqq"]
    rows = [(0, "I'm sooooo happy 😀 https://a.b #notokay @josé idk 1000 w/o"), (1, None), (2, "")]
    got = P.clean_tokens(spark.createDataFrame(rows, "id int, text string"), words).orderBy("id").collect()
    assert got[0].tokens == ["i", "am", "soo", "happy", "😀", "notokay", "not", "okay", "i", "don't", "know", "100", "witho"]
    assert got[1].tokens == got[2].tokens == []


def brute_break(s, words):
    best = None
    for n in range(len(s)):
        for cut in combinations(range(1, len(s)), n):
            at = [0, *cut, len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            if all(p in words and 2 <= len(p) <= 20 for p in parts):
                key = (len(parts), -sum(len(p) ** 2 for p in parts), parts)
                best = key if best is None or key < best else best
    return best and (best[2] if len(best[2]) < 6 and not any(len(p) == 3 and p not in ("not", "fun", "day") for p in best[2]) else None)


@settings(max_examples=60, deadline=None)
@given(st.text("abd", min_size=1, max_size=9), st.frozensets(st.text("abd", min_size=2, max_size=4), max_size=8))
def test_break_word(s, words):
    assert P.break_word(s, frozenset(words)) == brute_break(s, words)


def test_clean_lyrics(spark):
    got = value(spark, X.clean_lyrics(F.col("x")), x="[Verse 1]\nI can't go\nChorus: all\nx7\nyou’re http://a.b/c\nDrop")
    assert got == "i cannot go you are"
    assert value(spark, X.clean_lyrics(F.col("x"))) == ""
    assert value(spark, F.array_join(X.treebank_words(F.lit("cannot gonna gimme")), " ")) == "can not gon na gim me"


def test_corpus_lines(spark):
    long = "x" * 130
    got = value(spark, F.array_join(X.corpus_lines(F.col("x")), "|"), x=f"3 Contributors\n(Intro)\nпривет\n{long}\nhello there\n\nbye")
    assert got == "hello there|bye"
    assert value(spark, F.array_join(X.corpus_lines(F.col("x")), "|"), x="привет\nмир") == "привет|мир"


def test_lexicon_vectors(spark):
    lexicon = spark.createDataFrame([("glad", "joy"), ("glad", "positive"), ("bad", "negative")], "word string, label string")
    docs = spark.createDataFrame([(1, ["glad", "bad", "x"]), (2, ["x"]), (3, [])], "doc_id long, tokens array<string>")
    got = {r.doc_id: list(r.vec) for r in emotion.from_words(docs, emotion.weights(spark, lexicon)).collect()}
    assert got[1] == pytest.approx([0.75, 0, 0, 0.25, 0, 0, 0, 0])
    assert got[2] == got[3] == [0.0] * 7 + [1.0]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=8, max_size=8))
def test_share_sums_to_one(spark, v):
    got = spark.createDataFrame([(v,)], "v array<double>").select(V.share("v", 7).alias("s")).first().s
    assert sum(got) == pytest.approx(1.0) and min(got) >= 0


def test_neighbours_match_brute_force(spark):
    vectors = {i: [math.sin(i * k + k) for k in range(1, 6)] for i in range(40)} | {40: [0.0] * 5, 41: [math.sin(3 * k + k) for k in range(1, 6)]}
    df = spark.createDataFrame(list(vectors.items()), "id long, vec array<double>")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    old, V.BLOCK = V.BLOCK, 10
    try:
        got = {}
        for r in V.neighbours(df, df, top=4).collect():
            got.setdefault(r.src, []).append((round(r.sim, 9), r.dst))
    finally:
        V.BLOCK = old
    for i, v in vectors.items():
        want = sorted(((round(cos(v, w), 9), j) for j, w in vectors.items() if j != i), reverse=True)[:4]
        assert sorted(got[i], reverse=True) == want


def test_pagerank(spark):
    edges = [(0, 1, 0.5), (0, 2, 0.25), (1, 0, 1.0), (2, 1, 0.3)]
    v = {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}
    start = spark.createDataFrame([(7, i, x) for i, x in v.items()], "query_id long, id long, v double")
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    r = dict.fromkeys(v, 0.25)
    for _ in range(100):
        new = {i: 0.15 * sum(w / out[s] * r[d] for s, d, w in edges if s == i) + 0.85 * v[i] for i in v}
        if math.sqrt(sum((new[i] - r[i]) ** 2 for i in v)) < 1e-6:
            break
        r = new
    got = {x.id: x.score for x in G.pagerank(spark.createDataFrame(edges, "src long, dst long, weight double"), start).collect()}
    assert got == pytest.approx(r, abs=1e-12)


@pytest.mark.parametrize("block", [7, 16384])
def test_neighbours_of_many_copies(spark, block):
    """Copies tie by the larger id, in parts of any size, and no rows are ranked by a window."""
    df = spark.createDataFrame([(i, [1.0, 0.5] if i % 3 else [math.cos(i), math.sin(i)]) for i in range(90)], "id long, vec array<double>")
    old, V.BLOCK = V.BLOCK, block
    try:
        top = V.neighbours(df, df, top=5)
        got, pairs = top.collect(), V.neighbours(df, df, above=0.9999).collect()
    finally:
        V.BLOCK = old
    assert "Window" not in top._jdf.queryExecution().toString()
    copies = [i for i in range(90) if i % 3]
    for i in (1, 88, 89):
        assert sorted(r.dst for r in got if r.src == i) == [j for j in copies if j != i][-5:]
    assert {(i, j) for i in copies for j in copies if i != j} <= {(r.src, r.dst) for r in pairs}
    assert len(pairs) == len({(r.src, r.dst) for r in pairs})


def test_walks_are_the_pagerank_of_the_teleport_vectors(spark):
    """All queries' walks by nodes and edges match the general walk; no table of a row for each query and node is joined."""
    part = lambda i, k: [math.sin(i * k + j) for j in range(4)]
    nodes = spark.createDataFrame([(i, part(i, 1), [0.0] * 4 if i == 3 else part(i, 2)) for i in range(30)], "id long, emotion array<double>, topic array<double>")
    queries = nodes.where("id % 4 = 0").selectExpr("id as query_id", "emotion as qe", "topic as qt")
    edges = spark.createDataFrame([(i, (i * j + 1) % 30, 1.0 / j) for i in range(25) for j in range(1, 5)], "src long, dst long, weight double")
    start = G.teleport(queries, nodes)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / n if (n := math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))) else 0.0
    rows = nodes.collect()
    s = [0.6 * cos(rows[4].emotion, r.emotion) + 0.4 * cos(rows[4].topic, r.topic) for r in rows]
    assert {r.id: r.v for r in start.where("query_id = 4").collect()} == pytest.approx({i: x / sum(s) if sum(s) > 0 else 1 / 30 for i, x in enumerate(s)}, abs=1e-12)
    old, G.CELLS, G.PIECE = (G.CELLS, G.PIECE), 60, 10
    try:
        for how in ({"fixed": 3}, {"tol": 1e-4}):
            want = {(r.query_id, r.id): r.score for r in G.pagerank(edges, start, **how).collect()}
            walked = G.walks(edges, nodes, queries, **how)
            assert "Join" not in walked._jdf.queryExecution().toString()
            assert {(r.query_id, r.id): r.score for r in walked.collect()} == pytest.approx(want, abs=1e-12)
            best = {(r.query_id, r.id) for r in G.walks(edges, nodes, queries, k=3, **how).collect()}
            for q in range(0, 30, 4):
                assert {i for p, i in best if p == q} == set(sorted(range(30), key=lambda i: (round(want[q, i], 9), i))[-3:])
    finally:
        G.CELLS, G.PIECE = old


def test_merge_groups(spark):
    pairs = spark.createDataFrame([(0, 3, 0.6), (3, 5, 0.7), (1, 2, 0.58), (2, 4, 0.5)], "i int, j int, sim double")
    got = {r.old_id: r.new_id for r in T.merge_map(pairs, 6).collect()}
    assert got == {0: 0, 3: 0, 5: 0, 1: 1, 2: 1, 4: 2}
    assert {r.new_id for r in T.merge_map(pairs.where("sim > 2"), 3).collect()} == {0, 1, 2}


def test_fuzzy(spark):
    songs = [(1, 1, "A", "Love me now"), (2, 2, "a ", "Love me know"), (3, 3, "A", "Other"), (4, 4, "B", "Love me now"), (5, 5, "A", "ЛЮБОВЬ"), (6, 6, "A", "МИР"), (7, 7, None, None)]
    df = spark.createDataFrame(songs, "song_id long, pos long, artist string, title string")
    assert {r.song_id for r in dedup.fuzzy_dedupe(df).collect()} == {1, 3, 4, 5, 7}
    pairs = dedup.fuzzy_pairs(df).collect()
    assert [(r.id_1, r.id_2) for r in pairs] == [(1, 2)]
    assert pairs[0].ratio == SequenceMatcher(None, "love me now", "love me know").ratio()


def test_fuzzy_classes_stand_for_all_pairs(spark):
    """Rows grow with the songs, not with the square of a title's copies, and give every pair back."""
    titles = ["old plate", "cold plate", "red ring", "old plate", "Old plate!", "cold plates"]
    songs = [(100 + i, i, "AB"[i % 5 == 0], titles[i * 7 % 6]) for i in range(40)]
    df = spark.createDataFrame(songs, "song_id long, pos long, artist string, title string")
    want = {(i, j, SequenceMatcher(None, s, t).ratio()) for i, p, a, x in songs for j, q, b, y in songs if p < q and a == b and (s := x.lower().strip("!")) != (t := y.lower().strip("!")) and SequenceMatcher(None, s, t).ratio() > 0.85}
    assert {(r.id_1, r.id_2, r.ratio) for r in dedup.fuzzy_pairs(df).collect()} == want
    rows = dedup.fuzzy_classes(df).collect()
    members = {}
    for r in rows:
        if r.ratio == 1:
            members.setdefault(r.id_1, []).append(r.id_2)
    assert sorted(sum(members.values(), [])) == [s[0] for s in songs]
    assert len(rows) <= len(songs) + len(members) ** 2
    assert {(i, j, r.ratio) for r in rows if r.ratio < 1 for i in members[r.id_1] for j in members[r.id_2] if i < j} == want


THESAURUS = Q.Thesaurus(
    senses={"rainy": [("wet.s", "s", frozenset({"storm"}))], "storm": [("storm.n", "n", frozenset({"rainy"}))], "cry": [("cry.v", "v", frozenset({"storm"}))], "walk": [("walk.v", "v", frozenset({"storm"}))], "many": [("m", "n", frozenset())] * 16, "plain": [("p1", "n", frozenset())]},
    lemmas={"storm.n": [("tempest", 5), ("gale", 5), ("rent", 9), ("make", 9), ("blow", 1)], "cry.v": [("weep", 3)], "walk.v": [("stroll", 9)], "p1": [("prairie", 10), ("field", 9)]},
)


def test_expansion():
    tokens, trace, events = Q.expand(["the", "storm", "rainy", "cry", "walk", "many", "plain", "unknown"], THESAURUS)
    assert trace == [("tempest", "storm"), ("gale", "storm"), ("weep", "cry"), ("prairie", "plain")]
    assert tokens[-4:] == ["tempest", "gale", "weep", "prairie"]
    reasons = {(k, t or s, r) for k, t, s, r in events}
    assert {("blocked", "rent", "anti_drift_missing_context"), ("blocked", "make", "newterm_blocklist"), ("skipped", "rainy", "pos_blocked:s"), ("skipped", "walk", "pos_blocked:v"), ("skipped", "many", "too_many_synsets"), ("skipped", "unknown", "no_synsets")} <= reasons
    assert Q.expand(["storm", "rainy", "apartment"], THESAURUS)[1][0] == ("rent", "storm")
    assert Q.expand(["storm", "rainy"], THESAURUS, Q.Gates(frozenset({"storm"})))[1] == []
    assert Q.expand([], THESAURUS) == ([], [], [])


def test_expansion_passes(spark):
    posts = spark.createDataFrame([(i, ["storm", "rainy", f"w{i}"]) for i in range(20)] + [(99, None)], "post_idx long, tokens array<string>")
    done = Q.process(posts, THESAURUS, min_df=5, share=0.9)
    assert done.where("post_idx = 99").first().tokens == []
    assert done.where("size(tokens) > size(clean)").count() == 0  # the sources themselves are in too many posts
    done = Q.process(posts, THESAURUS, min_df=100, share=0.9)
    assert Q.added_report(done).first().term == "gale"
    assert Q.event_report(done, "blocked", 50).count() == 2


def test_learning(spark):
    rows = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} word{i % 3}", i % 2) for i in range(60)], "doc_id long, text string, label int")
    split = L.stratified(rows)
    assert {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()} == {(0, True): 6, (0, False): 24, (1, True): 6, (1, False): 24}
    model = L.TextClassifier(features=1 << 10, max_iter=20).fit(split.where("not is_test"))
    assert model.predict(split.where("is_test")).where("label != predicted").count() == 0


def test_kmeans_settles(spark):
    v = spark.createDataFrame([(i, [math.cos(i % 3 * 2.0), math.sin(i % 3 * 2.0), i / 1000]) for i in range(60)], "id long, vec array<double>")
    scan = T.scan_k(v, (2, 3, 4), seeds=2, max_iter=20)
    assert T.best_k(scan) == 3
    a = T.assign(T.fit_kmeans(v, 3, seeds=2, max_iter=20), v)
    assert sorted(r["count"] for r in a.groupBy("cluster").count().collect()) == [20, 20, 20]
    assert T.silhouette(v, a, 3).first().silhouette > 0.9


def test_kmeans_scan_against_library(spark):
    """Costs against library fits of the same job, silhouettes against its evaluator, odd rows and none."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(5)
    rows = [(i, [rng.gauss(3 * math.cos(i % 5), 0.3), rng.gauss(3 * math.sin(i % 5), 0.3), rng.gauss(0, 0.3)]) for i in range(300)]
    v = spark.createDataFrame([*rows, *rows[:20], (999, None)], "id long, vec array<double>").repartition(4)
    known = v.where("vec IS NOT NULL")
    fits = kmeans.fit_all(known, (2, 5), starts=3)
    best = {k: min((f for f in fits if f.k == k), key=lambda f: f.cost) for k in (2, 5)}
    for k, cost, silhouette in T.scan_k(v, (2, 5), seeds=3):
        library = T.fit_kmeans(known, k, seeds=3).summary.trainingCost
        assert cost <= library * 1.001
        assert cost == pytest.approx(best[k].cost)
        place = [(r.id, r.vec, min(range(k), key=lambda c: (math.dist(r.vec, best[k].centers[c]), c))) for r in known.collect()]
        assigned = spark.createDataFrame(place, "id long, vec array<double>, prediction int").withColumn("features", array_to_vector("vec"))
        assert silhouette == pytest.approx(ClusteringEvaluator(distanceMeasure="cosine").evaluate(assigned), abs=1e-6)
    assert T.scan_k(v.limit(0), (2, 3)) == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, vec array<double>")
    assert [(k, c, x) for k, c, x in T.scan_k(same, (2, 3), seeds=2)] == [(2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_kmeans_settles_in_parts(spark, monkeypatch):
    """Few passes however many steps there are, and the centres that passes for every step give, whatever the numbers are."""
    rng, passes, summed = random.Random(7), [], kmeans._summed
    monkeypatch.setattr(kmeans, "_summed", lambda *a: passes.append(1) or summed(*a))
    monkeypatch.setattr(kmeans, "SUB", 64)
    for shift, scale, places in ((0, 1, 0), (0, 1, 3), (1000, 1 / 3, 9), (0, 1e-30, 9), (0, 1e60, 9)):
        rows = [(i, [shift + scale * round(rng.gauss(i % 3, 1), places) for _ in range(4)]) for i in range(400)]
        v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3).cache()
        tol = 1e-4 * scale
        passes.clear()
        held = kmeans.fit_all(v, (1, 2, 7), starts=2, tol=tol)
        assert len(passes) <= kmeans.ROUNDS + 1
        with monkeypatch.context() as m:
            m.setattr(kmeans, "HELD", 0)
            read = kmeans.fit_all(v, (1, 2, 7), starts=2, tol=tol)
        assert len(passes) > 2 * kmeans.ROUNDS + 8
        for a, b in zip(held, read, strict=True):
            assert (a.k, a.start) == (b.k, b.start) and a.cost == pytest.approx(b.cost, rel=1e-9)
            assert a.centers == pytest.approx(b.centers, rel=1e-9, abs=1e-9 * scale)


def test_kmeans_query_scans_all(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(T, "scan_k", lambda v, ks, **more: asked.append((list(ks), more)) or [(k, 1.0, float(k == 10)) for k in ks])
    got = registry.QUERIES["kmeans_scan"](spark, SF).collect()
    assert asked == [(list(range(3, 31)), {})]
    assert [r.k for r in got if r.best] == [10] and len(got) == 28


def test_logreg_query_is_whole(spark, monkeypatch):
    made, fit = [], L.TextClassifier.fit
    monkeypatch.setattr(L.TextClassifier, "fit", lambda self, rows: made.append(self) or fit(self, rows))
    got = registry.QUERIES["logreg_eval"](spark, SF).collect()
    assert (made[0].features, made[0].max_iter) == (50_000, 2000)
    assert sum(r.n for r in got) > 0


def test_porter_query_counts_every_language(spark, tmp_path):
    rows = [(1, "running storms", "en"), (2, "running zorvek", "de"), (3, "storms", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.stem: r.n for r in registry.QUERIES["porter_tokens"](spark, str(tmp_path)).collect()}
    assert got == {"run": 2, "storm": 2, "zorvek": 1}


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("song_id,tokens\n a,x  y\nb,\na,z\n")
    assert {r.song_id.strip(): r.tokens for r in S.read_tokens_csv(spark, str(tmp_path / "t.csv"), last_wins=True).collect()} == {"a": ["z"], "b": []}
    (tmp_path / "bad.csv").write_text("id,tokens\n1,x\n")
    with pytest.raises(ValueError):
        S.read_tokens_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "l.json").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert S.read_json_any(spark, str(tmp_path / "a.json")).count() == S.read_json_any(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"k": {"artist": "A", "song": "S", "lyrics": "L"}}))
    assert S.read_json_map(spark, str(tmp_path / "m.json")).first() == Row(key="k", artist="A", song="S", lyrics="L")
    (tmp_path / "lex.tsv").write_text("good\tjoy\t1\nbad\tanger\t0\nodd\n")
    assert [tuple(r) for r in S.read_lexicon(spark, str(tmp_path / "lex.tsv")).collect()] == [("good", "joy")]
    (tmp_path / "map.json").write_text(json.dumps({"groups": [[0, 2], [1]]}))
    assert {tuple(r) for r in S.read_merge_map(spark, str(tmp_path / "map.json")).collect()} == {(0, 0), (2, 0), (1, 1)}
    assert S.read_merge_map(spark, str(tmp_path / "none.json"), k=4).count() == 4
    (tmp_path / "p.jsonl").write_text('{"raw_text":"r","clean_tokens":["c"],"expanded_tokens":["e","f"]}\n{"raw_text":"r2","clean_tokens":[],"expanded_tokens":[]}\n')
    assert [r.text for r in S.read_posts(spark, str(tmp_path / "p.jsonl")).orderBy("post_idx").collect()] == ["e f", "r2"]
    (tmp_path / "d.csv").write_text("id,sentence,label\n1,hello there,joy\n2,,fear\n3,bye,9\n")
    assert [tuple(r) for r in S.read_labelled(spark, str(tmp_path / "d.csv"), ("fear", "joy")).collect()] == [("hello there", 1)]


def test_index_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "doc_id long, tokens array<string>")
    S.save_index(R.build_index(docs), str(tmp_path / "index"))
    index = S.read_index(spark, str(tmp_path / "index"))
    assert (index.postings.count(), index.vocabulary.count(), index.metadata.first().n_docs, index.documents.count()) == (4, 3, 2, 2)
    assert {(r.term, r.df) for r in R.build_index(docs, existing=spark.createDataFrame([("b",), ("z",)], "term string")).vocabulary.collect()} == {("b", 2), ("z", 0)}
    from resonant.streaming.scorer import score_stream

    spark.createDataFrame([(5, ["a"])], "query_id long, tokens array<string>").write.parquet(str(tmp_path / "q"))
    got = []
    stream = spark.readStream.schema("query_id long, tokens array<string>").parquet(str(tmp_path / "q"))
    query = score_stream(stream, str(tmp_path / "index"), lambda df, n: got.extend(df.collect()), checkpoint=str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert [(r.query_id, r.doc_id) for r in got] == [(5, 1)]


def test_reports(spark):
    songs = spark.createDataFrame([(f"s{i}", "[Chorus]\nla [x2]" if i % 2 else "[Chorus] [Chorus]") for i in range(14)] + [("z", None)], "song_id string, lyrics string")
    got = {r.phrase: (r["class"], r.n, r.examples) for r in reports.bracket_report(songs).collect()}
    assert got == {"Chorus": ("section_marker", 21, ["s0", "s1", "s10", "s11", "s12"]), "x2": ("repeat_marker", 7, ["s1", "s11", "s13", "s3", "s5"])}
    weeks = spark.createDataFrame([("2023-01-01", "Song", "A feat. B"), ("2023-01-08", "Song", "A"), ("2024-01-01", "Song", "A")], "day string, title string, artist string")
    assert sorted(map(tuple, reports.yearly_charts(weeks.withColumn("day", F.to_date("day"))).collect())) == [(2023, "Song", "A"), (2024, "Song", "A")]
    posts = spark.createDataFrame([(2, 4), (2, 2), (0, 3)], "n_clean int, n_expanded int")
    assert {r.bin: r.n for r in reports.ratio_histogram(posts, 2).collect()} == {1: 1, 2: 1}


def test_shared_folder_is_cleared(spark):
    table = S.written(spark.range(5), "some")
    place = S._PLACES[-1]
    assert table.count() == 5 and S.clear_shared(spark) >= 1
    import os

    assert not os.path.exists(place.removeprefix("file://"))


def test_missing_dependencies_are_not_hidden(tmp_path):
    """The entry works without the corpus subpackage, but not if something that this needs is missing."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path / "copy", capture_output=True, text=True)
    if os.path.exists(tmp_path / "copy/resonant/llm/words.py"):
        whole = run()
        os.remove(tmp_path / "copy/resonant/llm/words.py")
        assert whole.returncode == 0 and run().returncode != 0
    shutil.rmtree(tmp_path / "copy/resonant/llm", ignore_errors=True)
    if os.path.exists(tmp_path / "copy/corpus_pipeline.py"):
        os.remove(tmp_path / "copy/corpus_pipeline.py")
    assert run().returncode == 0


def test_terms_are_counted_where_documents_are_read(spark):
    """Neither tokens nor counts are shuffled; rows of one id add up if there are several, and pairs do not cross documents."""
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, []), (3, None), (4, ["b"]), (5, ["b", "c"])], "doc_id long, tokens array<string>")
    counted = R.term_counts(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    old, R.PIECE = R.PIECE, 2
    try:
        assert sorted(map(tuple, counted.collect())) == [(1, 4, "a", 2), (1, 4, "b", 2), (4, 1, "b", 1), (5, 2, "b", 1), (5, 2, "c", 1)]
        assert sorted(tuple(r) for r in R.term_counts(docs, pairs=True).select("doc_id", "term", "tf").collect()) == [(1, "a b", 2), (1, "b a", 1), (5, "b c", 1)]
        twice = docs.unionByName(docs.where("doc_id = 1"))
        assert sorted(tuple(r) for r in R.term_counts(twice).where("doc_id = 1").collect()) == [(1, 4, "a", 4), (1, 4, "b", 4)]
        assert {r.term: r.tf for r in R.term_counts(twice, pairs=True).where("doc_id = 1").collect()} == {"a b": 4, "b a": 2}
    finally:
        R.PIECE = old


def test_stop_words_are_looked_up_in_a_set(spark):
    rows = spark.createDataFrame([(["the", "x", "song", "zorvek", "and"],), (None,)], "tokens array<string>")
    kept = rows.select(T.without_stop_words(F.col("tokens"), ("the", "and", *(f"w{i}" for i in range(20)))).alias("t"))
    assert "INSET" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in kept.collect()] == [["song", "zorvek"], None]
    assert rows.select(T.without_stop_words(F.col("tokens"), ()).alias("t")).first().t == ["the", "song", "zorvek", "and"]


def test_last_row_of_an_id_over_files(spark, tmp_path):
    """Files count by name, whatever their sizes and the order they are read in, and no window gathers an id's texts."""
    for i, body in enumerate((" a,x\nb,one\n" + "c,long\n" * 50, "a ,y\n,none\n", " b, two words \na,last\n")):
        (tmp_path / f"part-{i}.csv").write_text("song_id,tokens\n" + body)
    read = S.read_tokens_csv(spark, str(tmp_path), last_wins=True)
    assert "Window" not in read._jdf.queryExecution().toString()
    assert {r.song_id: r.tokens for r in read.collect()} == {"a": ["last"], "b": ["two", "words"], "c": ["long"]}


def test_each_word_is_stemmed_once(spark):
    plan = registry.QUERIES["porter_tokens"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.index("ArrowEvalPython" if "ArrowEvalPython" in plan else "EvalPython") < plan.rindex("Aggregate")


def test_texts_are_not_ranked_with_their_classes(spark, monkeypatch):
    made, split = [], L.stratified
    monkeypatch.setattr(L, "stratified", lambda rows, *a, **k: made.append(rows.columns) or split(rows, *a, **k))
    monkeypatch.setattr(L.TextClassifier, "fit", lambda self, rows: (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        registry.QUERIES["logreg_eval"](spark, SF)
    assert made == [["doc_id", "label"]]
