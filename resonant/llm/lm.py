"""Operator 10: language-model scoring by an interpolated modified Kneser-Ney model.

The model is a bigram model with end tokens and text starts as contexts. It is counted in Spark in
two rounds: words, then pairs of word ids. Tasks count their own chunks first and send each
distinct word or pair once, as packed sorted keys, to the range that owns it. Every range is
written to the shared folder as sorted hash arrays; scoring workers map these files into memory and
search them. Pair keys are ids scrambled by a reversible hash, so pairs are exact and no word, however
frequent, makes a range larger than others. Continuation counts and the statistics of contexts are
merged by id range the same way. Nothing that grows with the corpus passes through the driver.

  p(w|v)  = max(c(vw) - D(c), 0) / c(v.) + g(v) * p1(w)
  p1(w)   = max(n(.w) - D'(n), 0) / n(..) + g' / (V + 1)

The order is two because three orders of this corpus need more disk than is allowed (see README).

Base: the sum over a text's tokens of log10((c + 1) / (N + V + 1)) with word counts c.

Defined results. Null texts are empty: their only token is the end. Word keys are 64-bit hashes.
Repeated rows count and are scored each; extra columns are ignored. With no training rows the base
has N = V = 0 and every token has probability 1 in the model's place (score 0). A null id counts as
an empty text in the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .packed import find, large, narrow, pack, put, small, summed, unpack, view
from .spark_io import new_place
from .toxicity import fold

U = np.uint64
END = U(0xE11D_0F7E_A7C0_FFEE)
#: Words or pairs that a task gathers before it counts and sends them, and pairs that a range holds on average.
GATHER, PER_RANGE = 4_000_000, 4_000_000


class Mixer:
    """A reversible hash of integers of a given number of bits."""

    def __init__(self, bits: int):
        self.bits, self.shift = bits, U((bits + 1) // 2)
        self.mask = U((1 << bits) - 1)
        odd = (0x9E3779B97F4A7C15 & ((1 << bits) - 1)) | 1
        self.odd, self.back = U(odd), U(pow(odd, -1, 1 << bits))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = (x * self.odd) & self.mask
            x = x ^ (x >> self.shift)
        return x

    def undo(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x ^ (x >> self.shift)
            x = (x * self.back) & self.mask
        return x


def _sequence(x: W.Words, words: np.ndarray, start, end) -> tuple[np.ndarray, np.ndarray]:
    """(previous, token) for every token of the chunk's texts; each text ends with the end token."""
    docs = len(x.first) - 1
    token_first = x.first + np.arange(docs + 1)
    token = np.empty(token_first[-1], words.dtype)
    token[np.arange(len(words)) + x.doc] = words
    token[token_first[1:] - 1] = end
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[token_first[:-1]] = start
    return before, token


def _sent(keys: np.ndarray, counts: np.ndarray, bits: int, log_ranges: int) -> pa.RecordBatch:
    """Rows (r, k, c) of sorted distinct keys, one for each range."""
    r = (keys >> U(bits - log_ranges)).astype(np.int64) if log_ranges else np.zeros(len(keys), np.int64)
    own = np.unique(r)
    cut = np.searchsorted(r, own), np.searchsorted(r, own, "right")
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([pack(keys[a:b]) for a, b in zip(*cut)], pa.binary()), pa.array([small(counts[a:b]) for a, b in zip(*cut)], pa.binary())], ["r", "k", "c"])


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([unpack(x.as_py()) for x in t.column("k")]), np.concatenate([large(x.as_py()) for x in t.column("c")]))


def _gathered(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    return keys, counts


def _count_words(log_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for a, b, data, off in W.chunks(batch.column("text")):
                x = W.cut(data, off, W.NOT_SPACE)
                parts += [x.hash, np.full(b - a, END)]
                n += len(x.hash) + b - a
                if n >= GATHER:
                    yield _sent(*_gathered(parts), 64, log_ranges)
                    parts, n = [], 0
        if n:
            yield _sent(*_gathered(parts), 64, log_ranges)

    return run


def _tallies(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and how many there are."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a count is missing, a fixed half or the largest that is safe."""
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d1, d2, d3 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0
    return min(max(d1, 0.1), 1.0), min(max(d2, 0.1), 2.0), min(max(d3, 0.1), 3.0)


class Model:
    """Where the arrays of a model are, and its few global numbers; small enough for every task."""

    folder: str
    log_words: int  # word ranges
    first_id: list[int]  # of each word range
    tokens: int
    words: int
    bits: int
    log_pairs: int
    id_width: int  # ids in each id range
    d: tuple[float, float, float]
    d1: tuple[float, float, float]
    sum1: int
    back1: float

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, or -1; hashes sorted."""
        out = np.full(len(hashes), -1, np.int64)
        edge = np.searchsorted(hashes, np.arange(1 << self.log_words, dtype=np.uint64) << U(64 - self.log_words)) if self.log_words else np.zeros(1, np.int64)
        for r, (a, b) in enumerate(zip(edge, [*edge[1:], len(hashes)])):
            if b > a and self.first_id[r + 1] > self.first_id[r]:
                at = find(view(self.folder, f"words-{r}.npy"), hashes[a:b])
                out[a:b] = np.where(at >= 0, at + self.first_id[r], -1)
        return out

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids from arrays over id ranges; 0 for negative ids."""
        out = np.zeros(len(ids))
        ranges = -(-(self.words + 1) // self.id_width)
        edge = np.searchsorted(ids, np.arange(ranges) * self.id_width)
        for r, (a, b) in enumerate(zip(edge, [*edge[1:], len(ids)])):
            if b > a:
                out[a:b] = view(self.folder, f"{name}-{r}.npy")[ids[a:b] - r * self.id_width]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted mixed pair keys."""
        out = np.zeros(len(keys), np.int64)
        edge = np.searchsorted(keys, np.arange(1 << self.log_pairs, dtype=np.uint64) << U(self.bits - self.log_pairs)) if self.log_pairs else np.zeros(1, np.int64)
        for r, (a, b) in enumerate(zip(edge, [*edge[1:], len(keys)])):
            if b > a and r in self.pair_ranges:
                at = find(view(self.folder, f"pairs-{r}.npy"), keys[a:b])
                out[a:b] = np.where(at >= 0, view(self.folder, f"counts-{r}.npy")[at], 0)
        return out


def _word_counts(m: Model, ids: np.ndarray) -> np.ndarray:
    """Training counts of sorted ids (0 for -1)."""
    out = np.zeros(len(ids), np.int64)
    edge = np.searchsorted(ids, m.first_id)
    for r, (a, b) in enumerate(zip(edge, edge[1:])):
        if b > a:
            out[a:b] = view(m.folder, f"freq-{r}.npy")[ids[a:b] - m.first_id[r]]
    return out


def _pairs(m: Model, x: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the chunk's words (distinct ids, inverse), and (previous, token) ids of its tokens; -1 unknown."""
    distinct, inverse = np.unique(np.concatenate([x.hash, [END]]), return_inverse=True)
    ids = m.ids(distinct)[inverse]
    return _sequence(x, ids[:-1], m.words, ids[-1])


def _count_pairs(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, half = Mixer(m.bits), U(m.bits // 2)
        parts, n = [], 0
        for batch in batches:
            for _, _, data, off in W.chunks(batch.column("text")):
                before, token = _pairs(m, W.cut(data, off, W.NOT_SPACE))
                parts.append(mixer((before.astype(np.uint64) << half) | token.astype(np.uint64)))
                n += len(token)
                if n >= GATHER:
                    yield _sent(*_gathered(parts), m.bits, m.log_pairs)
                    parts, n = [], 0
        if n:
            yield _sent(*_gathered(parts), m.bits, m.log_pairs)

    return run


def _by_range(ids: np.ndarray, values: list[np.ndarray], width: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Sums of the values by id, cut into id ranges."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    own = ids[first]
    sums = [np.add.reduceat(v[order], first) for v in values]
    for r in np.unique(own // width):
        a, b = np.searchsorted(own, r * width), np.searchsorted(own, (r + 1) * width)
        yield int(r), pack(own[a:b].astype(np.uint64)), [small(s[a:b]) for s in sums]


_STATS = "kind int, r long, k binary, a binary, b binary, c binary, d binary"


def _store_pairs(m: Model):
    """Writes one range of pairs; returns its tallies and what it adds to the statistics of ids."""

    def run(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        keys, counts = _merged(t)
        put(m.folder, f"pairs-{r}.npy", keys)
        put(m.folder, f"counts-{r}.npy", narrow(counts))
        plain = Mixer(m.bits).undo(keys)
        half = U(m.bits // 2)
        before, token = (plain >> half).astype(np.int64), (plain & U((1 << (m.bits // 2)) - 1)).astype(np.int64)
        one = np.ones(len(keys), np.int64)
        rows = [(0, r, small(np.array(_tallies(counts), np.int64)), b"", b"", b"", b"")]
        rows += [(1, q, k, a, b"", b"", b"") for q, k, (a,) in _by_range(token, [one], m.id_width)]
        rows += [(2, q, k, *v) for q, k, v in _by_range(before, [counts, *((counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))], m.id_width)]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int32(), pa.int64(), *[pa.binary()] * 5])], ["kind", "r", "k", "a", "b", "c", "d"])

    return run


def _store_ids(m: Model):
    """Writes one id range: n(.w), c(v.) and the follow counts of contexts; returns the tallies of n(.w)."""

    def run(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        n = min(m.id_width, m.words + 1 - r * m.id_width)
        follows, total, kinds = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((3, n), np.int64)
        for row in t.to_pylist():
            at = unpack(row["k"]).astype(np.int64) - r * m.id_width
            if row["kind"] == 1:
                follows[at] += large(row["a"])
            else:
                total[at] += large(row["a"])
                for j, c in enumerate("bcd"):
                    kinds[j][at] += large(row[c])
        put(m.folder, f"cont-{r}.npy", follows)
        put(m.folder, f"total-{r}.npy", total.astype(np.float64))
        put(m.folder, f"back-{r}.npy", np.where(total > 0, m.d[0] * kinds[0] + m.d[1] * kinds[1] + m.d[2] * kinds[2], 0.0) / np.maximum(total, 1))
        seen = follows[follows > 0]
        return pa.table([pa.array([r], pa.int64()), pa.array([small(np.array([*_tallies(seen), int(seen.sum())], np.int64))], pa.binary())], ["r", "n"])

    return run


def train(texts: DataFrame) -> Model:
    """Count a model over the column `text`."""
    spark = texts.sparkSession
    m = Model()
    m.folder = new_place(spark, "lm")
    parts = max(1, texts.select("text").rdd.getNumPartitions())
    m.log_words = max(3, (parts - 1).bit_length() - 1)
    folder = m.folder

    def store_words(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        keys, counts = _merged(t)
        put(folder, f"words-{r}.npy", keys)
        put(folder, f"freq-{r}.npy", counts)
        return pa.table([pa.array([r], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["r", "v", "n"])

    sent = texts.select("text").mapInArrow(W.tidied(_count_words(m.log_words)), "r long, k binary, c binary")
    own = {r["r"]: r for r in sent.groupBy("r").applyInArrow(W.tidied(store_words), "r long, v long, n long").collect()}
    sizes = [own[r]["v"] if r in own else 0 for r in range(1 << m.log_words)]
    m.first_id = [int(x) for x in np.concatenate([[0], np.cumsum(sizes)])]
    m.words, m.tokens = m.first_id[-1], sum(r["n"] for r in own.values())
    if not m.tokens:
        return m
    m.bits = 2 * (m.words + 1).bit_length()
    m.log_pairs = min(max(0, (m.tokens // PER_RANGE).bit_length()), m.bits - 1)
    m.id_width = max(1 << 16, -(-(m.words + 1) // 1024)) if m.words < 1 << 30 else 1 << 21
    m.pair_ranges = frozenset()
    sent = texts.select("text").mapInArrow(W.tidied(_count_pairs(m)), "r long, k binary, c binary")
    stats = sent.groupBy("r").applyInArrow(W.tidied(_store_pairs(m)), _STATS)
    path = f"{m.folder}/stats"
    stats.write.parquet(path)
    stats = spark.read.schema(_STATS).parquet(path)
    tallies = [(r["r"], large(bytes(r["k"]))) for r in stats.where("kind = 0").select("r", "k").collect()]
    m.pair_ranges = frozenset(r for r, _ in tallies)
    m.d = discounts(*(int(sum(x[j] for _, x in tallies)) for j in range(4)))
    done = stats.where("kind > 0").groupBy("r").applyInArrow(W.tidied(_store_ids(m)), "r long, n binary").collect()
    n = np.sum([large(bytes(r["n"])) for r in done], axis=0)
    m.d1 = discounts(*map(int, n[:4]))
    m.sum1 = int(n[5])
    m.back1 = (m.d1[0] * int(n[0]) + m.d1[1] * int(n[1]) + m.d1[2] * int(n[4] - n[0] - n[1])) / m.sum1
    return m


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def _scores(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, half = (Mixer(m.bits), U(m.bits // 2)) if m.tokens else (None, None)
        for batch in batches:
            n = batch.num_rows
            n_tokens, n_known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for a, b, data, off in W.chunks(batch.column("text")):
                x = W.cut(data, off, W.NOT_SPACE)
                size = np.diff(x.first) + 1
                n_tokens[a:b] = size
                doc = np.repeat(np.arange(b - a), size)
                if not m.tokens:
                    continue
                before, token = _pairs(m, x)
                ids, inverse = np.unique(token, return_inverse=True)
                c = _word_counts(m, ids)
                n_known[a:b] = np.bincount(doc, (c > 0)[inverse], b - a)
                base[a:b] = np.bincount(doc, np.log10((c + 1) / (m.tokens + m.words + 1))[inverse], b - a)
                p1 = _discounted(m.by_id("cont", ids).astype(np.int64), m.d1) / m.sum1 + m.back1 / (m.words + 1)
                known = np.flatnonzero((before >= 0) & (token >= 0))
                keys, at = np.unique(mixer((before[known].astype(np.uint64) << half) | token[known].astype(np.uint64)), return_inverse=True)
                pair = np.zeros(len(token), np.int64)
                pair[known] = m.pair_counts(keys)[at]
                context, which = np.unique(before, return_inverse=True)
                total = m.by_id("total", context)
                back = np.where(total > 0, m.by_id("back", context), 1.0)
                p = _discounted(pair, m.d) / np.maximum(total, 1.0)[which] + back[which] * p1[inverse]
                score[a:b] = np.bincount(doc, np.log10(p), b - a)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score)], [*names, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(documents: DataFrame, m: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(W.tidied(_scores(m)), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    m = train(docs.where(fold(F.col("doc_id"), folds) != held_out))
    return score(docs, m).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
