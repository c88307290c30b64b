"""The corpus operators against brute force, on the generated tables and on odd texts."""

import hashlib
import html
import html.parser
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from resonant.llm import bpe, components, decontaminate, html_text, jaccard, lm, packed, quality, queries, secrets, token_counts, toxicity, url_filter, vocabulary, words as W

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [
    None, "", " \n\t ", "one", "one two three", "A b c d", "a B C d", "é ß 😀 # <|> $x", "x\x0by\x0cz\r\nq", "\x1c\x1d a\u00a0b\u2003c", "<|endoftext|> x<|endoftext|>",
    "w " * 30, "a b c d e f g h\n" * 4, "password: hunter22 token=abc,secret = \"s3cr3t-value\" AKIA" + "B2" * 10 + " " + "0a" * 14, "ſecret=abcdefg api-key=zzzzzz APIKEY='qwerty1'", "f" * 23 + " " + "f" * 24,
    "e" * 12, "e" * 12, "k" * 5000, " ".join(f"long{i}" for i in range(4000)), " ".join(f"long{i}" for i in range(3990)), "...\n…\nx...",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, findings string, blob int, row string, items string, cls string, ids string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(10**6 + i, t, "en", "odd", 0) + ("x", 1, "r", "i", "c", "d") for i, t in enumerate(ODD)]
    rows += [(10**6, "one two three", None, None, None) + (None,) * 6, (None, "a text without id", "en", "odd", 0) + (None,) * 6]
    known = spark.read.parquet(f"{SF}/documents.parquet")
    return spark.createDataFrame(rows, SCHEMA).unionByName(known, allowMissingColumns=True).cache()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def by_row(df):
    """Results keyed by id; rows without id and repeated ids are compared as multisets elsewhere."""
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def compare(df, want, columns):
    """want: rows (doc_id, values...) in any order."""
    got = sorted((repr(tuple(r[c] for c in ["doc_id", *columns])) for r in df.collect()))
    assert got == sorted(map(repr, want))


def empty(spark, documents):
    return documents.limit(0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB9é \t\n!😀\x00\x7f\u0085", max_size=12) | st.none(), max_size=6), st.integers(1, 20))
def test_word_cuts(texts, limit):
    import pyarrow as pa

    for table, pattern in ((W.NOT_SPACE, SPACED), (W.ALNUM, ALNUM)):
        got = []
        for a, b, data, off in W.chunks(pa.array(texts, pa.string()), limit):
            x = W.cut(data, off, table)
            found = [x.data[s:e].tobytes().decode() for s, e in zip(x.start, x.end)]
            got += [found[s:e] for s, e in zip(x.first, x.first[1:])]
            assert len(set(zip(found, x.hash.tolist()))) == len(set(found)) == len(set(x.hash.tolist()))
        assert got == [pattern.findall((t or "").translate(LOWER)) for t in texts]


def test_long_texts_by_stretches(monkeypatch):
    data = np.frombuffer(("word élan x" * 50 + " " + "y" * 300 + " ").encode() * 20, np.uint8)
    off = np.array([0, len(data)])
    whole = W.cut(data, off, W.NOT_SPACE)
    monkeypatch.setattr(W, "CHUNK_BYTES", 64)
    for a, b in zip(whole, W.cut(data, off, W.NOT_SPACE)):
        assert np.array_equal(a, b)


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packing(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert packed.unpack(packed.pack(keys)).tolist() == keys.tolist()
    counts = np.array([k % 70000 for k in keys.tolist()], np.int64)
    assert not len(counts) or packed.large(packed.small(counts)).tolist() == counts.tolist()


@given(st.integers(2, 64), st.lists(st.integers(0, 2**64 - 1)))
def test_mixer(bits, keys):
    m = lm.Mixer(bits)
    keys = np.array([k % (1 << bits) for k in keys], np.uint64)
    assert m.undo(m(keys)).tolist() == keys.tolist()


@pytest.mark.parametrize("block_bytes", [8 << 20, 1500])
def test_decontaminate(spark, documents, rows, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "LONG5 long6 long7"), (901, "one"), (902, None), (903, "!!"), (900, "long5 long6 long7"), (None, "w w w")]
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    compare(decontaminate.decontaminate(documents, benchmark, block_bytes=block_bytes), want, columns)
    assert decontaminate.decontaminate(documents.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminate(documents, benchmark.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.keep_clean(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == sum(not x[2] for x in want)


def _segmented(piece, score, longest):
    """The best segmentation of a pre-token by trying every cut."""
    p, best = piece.encode(), [(0.0, 0, [])]
    for j in range(1, len(p) + 1):
        best.append(max(((best[i][0] + score[p[i:j]], best[i][1] - 1, [*best[i][2], p[i:j]]) for i in range(max(0, j - longest), j) if p[i:j] in score), key=lambda x: x[:2]))
    return best[-1][2]


def test_token_counts(spark, documents, rows):
    v = vocabulary.Vocabulary(vocabulary.default_path())
    size, longest = len(v.bytes_of), max(v.length.values())
    score = {t: -math.log(i + 2) if len(t) > 1 else -math.log(size + 2) for i, t in v.bytes_of.items()}
    pieces = Counter(p for _, t in rows for p in vocabulary.SPLIT.findall(t or ""))
    used = Counter()
    for p, n in pieces.items():
        for t in Counter(_segmented(p, score, longest)).items():
            used[t[0]] += n * t[1]
    score = {t: math.log((used[t] + 1) / (used.total() + size)) for t in score}
    fitted = token_counts.fit(documents, chunk_chars=2000)
    assert max(abs(fitted[i] - score[t]) for i, t in v.bytes_of.items()) < 1e-9
    score = {t: float(fitted[i]) for i, t in v.bytes_of.items()}
    known = {p: len(_segmented(p, score, longest)) for p in pieces}
    cut = [(i, vocabulary.SPLIT.findall(t or "")) for i, t in rows]
    compare(token_counts.count(documents, chunk_chars=2000), [(i, sum(map(known.get, c)), len(c)) for i, c in cut], ["n_tokens", "n_pretokens"])
    assert token_counts.count(documents.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\t '1²٣éß漢\u0301\x1c\x1e\u0085\u00a0\u2003stdl", max_size=20))
def test_stretches(text):
    first, spaced = vocabulary.stretches(text)
    cut = [p for x in first for p in vocabulary.SPLIT.findall(x)] + [p for x in spaced for p in vocabulary.SPLIT.findall(" " + x)]
    assert cut == vocabulary.SPLIT.findall(text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b> &eacute;&#33; <a href=x>link</a> text<br>next line.</p><p>One.</p><p><b>Unclosed.<br><p>Second &nbsp; block</p>
<aside>related</aside><form><input value=">">Sign up</form><div class="comments"><p>I disagree with everything here and more</p></div></article>
<!-- a comment <p>no</p> --><div id="ad-1">Buy now</div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_text.extract(PAGE) == "A title & more\n\nFirst bold é! link text next line.\n\nOne.\n\nUnclosed.\n\nSecond block"
    assert html_text.extract(None) == html_text.extract("") == ""
    plain = "<div><a href=1>Home</a> <a href=2>News</a></div>" + "<p>" + "word " * 60 + "</p>" + "<p>" + "more " * 50 + "</p><div><a>x</a></div>"
    assert html_text.extract(plain) == ("word " * 60).strip() + "\n\n" + ("more " * 50).strip()
    html_text.extract("<p " + "'\"" * 5000 + "<a \"" * 2000)
    assert html_text.extract("<article><p>cut off &am") == "cut off &am"
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (1, "u", PAGE, 5)], "page_id long, url string, html string, text long")
    got = html_text.report(pages).collect()
    assert [len(r.text) == r.n_chars for r in got] == [True] * 3 and sorted(r.n_chars > 0 for r in got) == [False, True, True]
    assert html_text.report(pages.limit(0)).count() == 0
    assert all(html_text.classify(html_text.default_tree(), b[:-1]) == b[-1] for b in html_text.labelled_rows())


SENTENCES = "This is the first sentence of the text. Here is a second one, a little longer. And a third one ends it."


@pytest.mark.parametrize("around", ['<main class="with-sidebar">%s</main>', '<main id="content" class="no-sidebar">%s</main>', '<div class="article-body no-comments">%s</div>', '<article class="post has-comments">%s</article>', '<body class="page sidebar-right"><article>%s'])
def test_html_names_that_only_describe(around):
    cards = "".join(f'<a href="/{i}"><div>Card {i}<p>A teaser text of a few words</p></div></a>' for i in range(3))
    comments = '<section id="comments"><p>I do not agree with any of this at all</p></section>'
    assert html_text.extract(around % f"<p>{SENTENCES}</p>") == SENTENCES
    assert html_text.extract(cards + around % f"<p>{SENTENCES}</p>{cards}{comments}" + cards) == SENTENCES


def test_html_held_out_pages():
    pages = html_text.labelled_pages()
    wrong = n = 0
    for k in range(5):
        tree = html_text.grow(html_text.labelled_rows(p for i, p in enumerate(pages) if i % 5 != k))
        for row in html_text.labelled_rows(p for i, p in enumerate(pages) if i % 5 == k):
            n, wrong = n + 1, wrong + (html_text.classify(tree, row[:-1]) != row[-1])
    assert wrong <= 0.02 * n


def test_html_long_page():
    page = "<nav><a href=1>Home</a></nav><article>" + "<p>word &lt;here</p>" * 50_000 + "</article>"
    assert html_text.extract(page) == "\n\n".join(["word <here"] * 50_000)


class _Article(html.parser.HTMLParser):
    """The blocks inside <article>, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in html_text.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag not in html_text.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = []
    for r in pages.collect():
        p = _Article()
        p.feed(r.html)
        p.close()
        text = "\n\n".join(" ".join(x.split()) for x in p.blocks if x.split())
        want.append((r.page_id, r.url, text, len(text)))
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.report(pages).collect()]
    assert sorted(got) == sorted(want)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, documents, rows):
    want = []
    for i, t in rows:
        s = spans(t or "")
        want.append((i, *(sum(k == x for _, x, _ in s) for k in range(3)), sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s))))
    compare(secrets.report(documents), want, ["n_assign", "n_access", "n_hex", "base_sha256"])
    got = secrets.redact(documents)
    assert got.columns == documents.columns and got.count() == len(rows)
    assert got.where("text like '%hunter22%' or text like '%s3cr3t%'").count() == 0
    assert got.where("text is null").count() == 1
    assert secrets.report(documents.limit(0)).count() == 0


def test_secret_kinds():
    text = "x ghp_" + "Z1" * 18 + " eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT -----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----"
    assert [secrets.KINDS[k] for _, k, _ in secrets.find(text)] == ["github", "jwt", "pem"]


def test_secret_suspects_keep_to_texts():
    texts = ["0123456789abcdef" * 2, "fedcba9876543210" * 2, "00112233445566778899aabbccddeeff", "miyazaki", "AKIA" + "Q7" * 8, "", "plain"]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    assert {0, 1, 2, 4} <= set(secrets._suspects(data, off).tolist())
    assert 6 not in secrets._suspects(data, off)


def test_ledger_is_incremental(spark):
    first = spark.createDataFrame([("a", "token=abcdef"), ("b", "plain"), ("c", "token=abcdef")], "path string, text string")
    found, ledger = secrets.scan(first)
    assert {r.path: len(r.findings) for r in found.collect()} == {"a": 1, "b": 0, "c": 1}
    ledger = ledger.cache()
    assert ledger.count() == 2
    second = first.unionByName(spark.createDataFrame([("d", "secret=qwerty7")], "path string, text string"))
    assert secrets.update_ledger(second, ledger).count() == 1
    assert secrets.update_ledger(second, ledger, rule_version="3").count() == 3
    found, whole = secrets.scan(second, ledger)
    assert {r.path: len(r.findings) for r in found.collect()} == {"a": 1, "b": 0, "c": 1, "d": 1} and whole.count() == 3


def test_bpe(spark, documents, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary.default_path())
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    compare(bpe.report(documents), want, ["n_tokens", "ids_sha256", "decoded_sha256"])
    compare(bpe.pack_documents(documents), [(i, n, d) for i, n, _, d in want], ["n_tokens", "decoded_sha256"])
    compare(bpe.decode(bpe.encode(documents)), [(i, x or "") for i, x in rows], ["text"])
    assert bpe.report(documents.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab e\n\t '1²٣éß漢😀\u0301\x1e\u0085sdtlv<|>endoftx", max_size=60))
def test_bpe_texts(text):
    from tokenizers import Tokenizer

    global TOKENIZER
    if "TOKENIZER" not in globals():
        TOKENIZER = Tokenizer.from_file(vocabulary.default_path())
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert bpe.coder(vocabulary.default_path()).encode(text) == ids
    assert bpe.coder(vocabulary.default_path()).decode(ids) == TOKENIZER.decode(ids, skip_special_tokens=False)


URLS = [None, "", "abc", "http://A.COM?x/en/", "x://com/en/", "x://xcom/en/1", "HTTP://É.Example.NET/de/8#?", "http://example.com/en/7", "https://a.example.com/en/77?q", "http://a.net/de/", "http://q.org/es/#x", "http://org/es", "http://com:80/en/", "a://b://c/d", "http://" + "x" * 5000 + ".com/en/" + "1" * 3000]


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.lit("x").alias("host"))
    pages = pages.unionByName(spark.createDataFrame([(10**6 + i, u, "y") for i, u in enumerate([*URLS, "abc"])], "page_id long, url string, host string"))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in [(r.page_id, r.url or "") for r in pages.collect()]:
        host = path = ""
        if "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = m[1].translate(LOWER), m[2]
        fits = [(v, r) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1])
        assert got[i].verdict == (best[0] or ("block" if got[i].score > 0 else "allow"))
    assert dict((r, v) for v, r in url_filter.RULES) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    trees, rates = url_filter.default_model()
    for i, u in [(r.page_id, r.url or "") for r in pages.collect()]:
        assert got[i].score == pytest.approx(url_filter.score_of(u, trees, rates), abs=1e-9)
    free = [r.verdict for r in got.values() if r.rule is None]
    assert 0.01 < free.count("block") / len(free) < 0.5
    plan = url_filter.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_model_held_out():
    trees, rates = url_filter.default_model()
    wrong = lambda rows: sum((url_filter.score_of(u, trees, rates) > 0) != bool(y) for u, y in rows) / len(rows)
    assert wrong(url_filter.HELD_OUT) <= 0.12
    assert wrong(url_filter.labelled(seed=99)) <= 0.08
    for k, name in enumerate(url_filter.FEATURES):  # every feature moves some verdict

        def without(t):
            return url_filter.Node(t.feature, math.inf if t.feature == k else t.cut, without(t.low), without(t.high)) if isinstance(t, url_filter.Node) else t

        blind = [without(t) for t in trees]
        rows = url_filter.labelled(seed=99)
        assert any((url_filter.score_of(u, trees, rates) > 0) != (url_filter.score_of(u, blind, rates) > 0) for u, _ in rows), name


def test_url_rules_of_one_length(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/1"), (2, "http://com/x/")], "page_id long, url string")
    rules = (("block", "com/x/"), ("allow", "a.com/"), ("allow", "com/y/"))
    assert {r.page_id: r.rule for r in url_filter.judge(pages, rules=rules).collect()} == {1: "com/x/", 2: "com/x/"}


def sets_of(rows):
    out = []
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    return out


def linked(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for a, b in {(a, b) for own in where.values() for k, b in enumerate(own) for a in own[:k]}:
        same = len(sets[a][1] & sets[b][1])
        if 100 * same >= 85 * len(sets[a][1] | sets[b][1]):
            parent[find(b)] = find(a)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        ids[find(i)].append(d)
    return [(d, len(s), (min((x for x in ids[find(i)] if x is not None), default=None) if s else d)) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("tile", [4000, 6])
def test_jaccard(spark, documents, rows, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    near = [(2 * 10**6 + k, " ".join(f"w{j}" if (j * 7 + k) % 100 > k % 6 else f"z{k}x{j}" for j in range(100 + k % 3))) for k in range(60)]
    more = documents.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    compare(jaccard.join(more.repartition(3).transform(lambda d: _stable(spark, d))), linked(sets_of(rows + near)), ["n_shingles", "component_id"])


@pytest.mark.parametrize("tile", [4000, 6])
def test_jaccard_counts_all_links(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    near = [(k, " ".join(f"w{j}" if j != 3 + 7 * (k % 13) else f"z{k}" for j in range(100 + k % 5 * 6))) for k in range(40)]
    near += [(100 + k, near[k % 4][1]) for k in range(6)] + [(200, ""), (201, None), (202, "one two"), (203, "one two")]
    sets = sets_of(near)
    want = [(i, sum(100 * len(s & t) >= 85 * len(s | t) for j, t in sets if j != i and s)) for i, s in sets]
    df = _stable(spark, spark.createDataFrame(near, "doc_id long, text string").repartition(3))
    compare(jaccard.join(df), want, ["n_links"])
    assert len({n for _, n in want}) > 5 and max(n for _, n in want) > 10


def _stable(spark, df):
    from resonant.llm.spark_io import written

    return written(df, "test")


def test_jaccard_ranges_follow_the_shingles(spark, documents, rows, monkeypatch):
    """Key ranges of a bounded number of shingles even from one partition."""
    made, blocks = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda shingle, log_ranges: made.append(log_ranges) or blocks(shingle, log_ranges))
    monkeypatch.setattr(jaccard, "RANGE_KEYS", 500)
    want = linked(sets_of(rows))
    got = jaccard.join(documents.coalesce(1))
    compare(got, want, ["n_shingles", "component_id"])
    shingles = sum(r.n_shingles for r in got.collect())
    assert shingles > 500 << 3  # more than the least number of ranges may have
    assert shingles / (1 << made[0]) <= 500


def test_jaccard_empty_and_kept(spark, documents, rows):
    assert jaccard.join(documents.limit(0)).count() == 0
    fixed = _stable(spark, documents)
    kept = jaccard.keep_one(fixed)
    found = linked(sets_of(rows))
    groups = {("alone", i) if not n else c for i, (_, n, c) in enumerate(found)}
    assert kept.columns == documents.columns and kept.count() == len(groups)


def test_forest_tile():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(2**40, 60, replace=False).astype(np.uint64))
    sets = sorted((np.sort(np.concatenate([base[rng.random(60) > 0.08], rng.choice(2**40, 3).astype(np.uint64)])) for _ in range(40)), key=len)
    n = np.array([len(s) for s in sets])
    label = jaccard.forest(n, sets)
    as_sets = [set(s.tolist()) for s in sets]
    want = linked([(i, frozenset(s)) for i, s in enumerate(as_sets)])
    assert len({(a, b[2]) for a, b in zip(label.tolist(), want)}) == len(set(label.tolist())) == len({b[2] for b in want})


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (7, 7)] + [(200 + i, 500) for i in range(60)] + [(150, 500), (600, 601)] * 2
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100} | {i: 150 for i in (150, 500, *range(200, 260))} | {600: 600, 601: 600}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, documents, rows):
    want = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        n, windows, hit = len(w), Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(n - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                hit.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
        want.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n))
    got = quality.report(documents)
    compare(got, want, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert got.where("base_failed and kept").count() == 0
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns and kept.count() == got.where("kept").count() > 100
    assert quality.report(documents.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_labels(spark):
    known = quality.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert known.where("not base_failed and kept != (quality = 1)").count() <= 0.01 * known.count()


def test_toxicity(spark, documents):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.report(docs, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    order = {id(r): k for k, r in enumerate(sorted(held, key=lambda r: r.score))}
    bad = [r for r in held if r.toxic]
    auc = (sum(order[id(r)] for r in bad) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * (len(held) - len(bad)))
    assert auc > 0.95
    assert sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(held)
    few = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    out = toxicity.report(documents, few).collect()
    assert len(out) == documents.count() and len({r.score for r in out}) == 1
    assert toxicity.report(documents.limit(0), few.limit(0)).count() == 0


def test_toxicity_by_hand(spark):
    """Ratios, gradient and scores from the n-grams as strings, one text at a time."""
    words = ["vile", "rude", "nasty", "calm", "kind", "sunny", "plain", "garden", "éclair"]
    texts = [(i, " ".join(words[(i * 7 + k * k) % 3 + (0 if i % 2 else 3) + (k % 2) * 3] for k in range(5 + i % 4)) + " x" * (300 if i == 5 else 1)) for i in range(60)]
    docs = spark.createDataFrame([*texts, (3, texts[3][1]), (70, None), (71, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")

    def grams(t):
        out = Counter()
        for word in set(SPACED.findall((t or "").translate(LOWER))):
            w = f" {word} ".encode()
            out.update((n, w[k : k + n]) for n in toxicity.ORDERS for k in range(len(w) - n + 1))
        return out

    sample = {r.doc_id: (r.y, r.fold) for r in toxicity.sampled(docs, labels, 1500).collect()}
    text_of = dict(texts)
    f = {i: grams(text_of[i]) for i in sorted(sample, key=lambda i: (sample[i][0], i))}

    def fitted(ids, sure, steps):
        has = [Counter(g for i in ids if sample[i][0] == c for g in f[i]) for c in (0, 1)]
        # every hashed feature has one added to its count, those that no text holds included
        size = [sum(h.values()) + (1 << toxicity.BITS) for h in has]
        ratio = {}
        for g in has[0].keys() | has[1].keys():
            p, q = has[1][g] + 1, has[0][g] + 1
            r = math.log(p / size[1]) - math.log(q / size[0])
            if has[0][g] + has[1][g] >= toxicity.MIN_DOCS and abs(r) >= sure * math.sqrt(1 / p + 1 / q):
                ratio[g] = r
        x = {i: {g: ratio[g] * n for g, n in f[i].items() if g in ratio} for i in ids}
        n, ones = len(ids), sum(sample[i][0] for i in ids)
        balance = {i: 0.5 * n / ones if sample[i][0] else 0.5 * n / (n - ones) for i in ids}
        step = 1 / (0.25 * sum(v * v for i in ids for v in x[i].values()) / n + 0.25 + 1e-3)
        w, ahead, b, b_ahead, t = Counter(), Counter(), 0.0, 0.0, 1.0
        for _ in range(steps):
            grad, grad_b = {g: 1e-3 * ahead[g] for g in ratio}, 0.0
            for i in ids:
                z = sum(v * ahead[g] for g, v in x[i].items()) + b_ahead
                e = balance[i] * (1 / (1 + math.exp(-max(min(z, 40), -40))) - sample[i][0]) / n
                grad_b += e
                for g, v in x[i].items():
                    grad[g] += v * e
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            new, new_b = {g: ahead[g] - step * grad[g] for g in ratio}, b_ahead - step * grad_b
            ahead = Counter({g: new[g] + (t - 1) / t2 * (new[g] - w[g]) for g in ratio})
            b_ahead = new_b + (t - 1) / t2 * (new_b - b)
            w, b, t = Counter(new), new_b, t2
        return {g: w[g] * ratio[g] for g in ratio}, b

    def log_odds(model, counts):
        return sum(model[0].get(g, 0.0) * n for g, n in counts.items()) + model[1]

    losses = []
    for sure in toxicity.SURE:
        loss = 0.0
        for k in range(toxicity.FOLDS):
            model = fitted([i for i in f if sample[i][1] != k], sure, 10)
            for i in f:
                if sample[i][1] == k:
                    z = log_odds(model, f[i]) * (1 if sample[i][0] else -1)
                    loss += math.log1p(math.exp(-z))  # both classes are as frequent
        losses.append(loss)
    model = fitted(list(f), toxicity.SURE[losses.index(min(losses))], 20)
    table, b = toxicity.fit(docs, labels, steps=20)
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, table, b).collect()}
    assert len(got) == 62
    for i, score in got:
        assert score == pytest.approx(1 / (1 + math.exp(-log_odds(model, grams(text_of.get(i))))), abs=1e-4)
    few, _ = toxicity.fit(docs, labels, per_class=7, steps=20)
    assert np.count_nonzero(few) < np.count_nonzero(table)


def test_toxicity_odd_rows(spark, documents):
    """Null, empty, long and repeated texts with labels of both classes."""
    ids = [r.doc_id for r in documents.where("doc_id is not null").select("doc_id").distinct().orderBy("doc_id").collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    out = toxicity.report(documents, labels).collect()
    assert len(out) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert toxicity.report(documents.limit(0), labels).count() == 0


def test_toxicity_counts_beyond_a_byte():
    import pyarrow as pa

    text = " ".join(f"aaa{i}" for i in range(1000))
    (_, f, n), = toxicity._counted(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]))
    assert n.max() >= 1000 and len(f) == len(n)


def test_counts_beyond_32_bits():
    wide = packed.narrow(np.array([1, 1 << 33]))
    assert wide.tolist() == [1, 1 << 33] and packed.narrow(np.array([1, 255])).itemsize == 1 and packed.narrow(np.zeros(0, np.int64)).itemsize == 1


def test_lm(spark, documents, rows):
    texts = [(i, SPACED.findall((t or "").translate(LOWER)) + ["\x00end"], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in rows]
    one, two = Counter(), Counter()
    for _, w, held in texts:
        if not held:
            one.update(w)
            two.update(zip(["\x00start", *w], w))
    n, v = sum(one.values()), len(one)
    tally = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    follows = Counter(b for _, b in two)
    d, d1 = (0, *lm.discounts(*tally(two))), (0, *lm.discounts(*tally(follows)))
    s, g1, total, back = sum(follows.values()), sum(d1[min(c, 3)] for c in follows.values()) / sum(follows.values()), Counter(), Counter()
    for (a, _), c in two.items():
        total[a] += c
        back[a] += d[min(c, 3)]

    def p(a, b):
        low = max(follows[b] - d1[min(follows[b], 3)], 0) / s + g1 / (v + 1)
        return max(two[a, b] - d[min(two[a, b], 3)], 0) / total[a] + back[a] / total[a] * low if total[a] else low

    got = by_row(lm.report(documents))
    for i, w, held in texts:
        base, score = sum(math.log10((one[t] + 1) / (n + v + 1)) for t in w), sum(math.log10(p(a, b)) for a, b in zip(["\x00start", *w], w))
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(w), sum(one[t] > 0 for t in w), n) and r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9) for r in got[i])
    assert sum(map(len, got.values())) == len(texts)
    # the probabilities of all words after a context, and of an unknown one, add to 1
    for a in ["\x00start", "the", "one"]:
        assert sum(p(a, b) for b in one) + p(a, "\x00unknown") == pytest.approx(1.0)
    assert lm.report(documents.limit(0)).count() == 0


def test_queries_registered():
    import __spark_entry__ as entry

    assert [sum(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def _masked(text):
    """Every span of a finding replaced by a mark, from the rules alone."""
    held = spans(text) + [(m.start(), 9, m.end()) for rule in (secrets.PEM, secrets.JWT, secrets.GITHUB) for m in rule.finditer(text)]
    out, at = "", 0
    for s, _, e in sorted(held, key=lambda x: (x[0], x[1])):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def _windows_of(texts):
    out = set()
    for t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        out |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    return out


def test_pipeline(spark, tmp_path):
    """All stages against DuckDB, pairwise sets, item windows, the rules and the tokenizers library, with odd rows and clashing columns."""
    import duckdb
    from resonant.llm import sql
    from tokenizers import Tokenizer

    known = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = [f"the word{i * 7919 % 5003} of and to a in{i % 97} is that" for i in range(3000)]
    long = ". ".join(plain) * 3
    clean = " ".join(plain[:40])
    odd = [
        (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, clean), (10**6 + 3, clean), (10**6 + 4, clean + " more"), (10**6 + 5, ". ".join(plain)),
        (10**6 + 6, ". ".join(x + f" {i}" for i, x in enumerate(plain)) + " " + items[0] + " the end of it"), (10**6 + 7, " ".join(plain[100:150]) + " password: hunter2222 AKIA" + "B2" * 10 + " ghp_" + "Z1" * 18), (10**6 + 8, long),
    ]
    rows = known + odd
    extra = ("ids", "n_tokens", "findings", "row", "items", "cls", "blob", "_row", "_text", "spans")
    table = spark.createDataFrame([(i, t, "en", "odd", len(t or ""), *(["x"] * len(extra))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    judged = Counter((i, kept) for i, kept in con.execute(f"SELECT doc_id, kept FROM ({sql.OP8})").fetchall())
    alive = [(i, t) for i, t in rows if judged[i, True]]
    one = {}
    for (i, t), (_, n, c) in zip(alive, linked(sets_of(alive))):
        if i == c or not n:
            one[i] = t
    windows = _windows_of(items)
    clean = {}
    for i, t in one.items():
        w = ALNUM.findall(t.translate(LOWER))
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            clean[i] = _masked(t)
    assert {10**6 + 3, 10**6 + 7} <= clean.keys() and not {10**6, 10**6 + 1, 10**6 + 6} & clean.keys() and len(one) > len(clean) > 50
    tokenizer = Tokenizer.from_file(vocabulary.default_path())
    want = []
    for i, t in clean.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)), len(t)))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, sha(",".join(map(str, r.ids))), r.decoded_sha256, r.n_chars) for r in got.collect()) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "benchmark_decontamination", "secret_scans", "bpe_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), str(tmp_path)).columns == table.columns


def test_pipeline_without_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
