"""Operator 9: toxicity by a character n-gram linear classifier with naive Bayes feature scaling.

A text's features are the hashed character n-grams of its distinct words (with the words' ends
marked). Every feature is scaled by its naive Bayes log-count ratio between the two classes; a
logistic regression is fitted on the scaled features. Scores are computed for whole texts from the
product of scale and weight, one table of 2**BITS numbers.

The classifier is fitted on a bounded sample: at most `per_class` labelled rows of each class, the
first in hash order of their id, with one text each (the least, if rows share an id). It is the only thing
that is sampled. It is written to the shared folder; what reaches the driver from it is the number of texts
with each feature, by class and fold, and then for each sampled row the counts of only those features whose
ratio stands out, so that neither repeated rows nor long texts weigh on the driver. Counts aren't capped.

Defined results. Null or wordless texts have no features and get the model's intercept as score.
Labels with a null id or null label are ignored, a repeated label counts as the highest; with no
labels at all of one class every score is the prior. Repeated rows each get their row; extra
columns are ignored. A null id counts as an empty text in the fold. Empty tables give empty results.
Texts of any length are scored whole. Ties in the hash order go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .spark_io import written

BITS = 18
ORDERS = (3, 4, 5)
MIN_DOCS = 3
#: Standard errors that a log-count ratio must be from zero: the best of these in FOLDS-fold validation within the sample.
SURE, FOLDS = (2.5, 3.0, 3.5, 4.0, 4.5), 3
THRESHOLD = 0.7


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every n-gram of a chunk's distinct words, one array pair for each order."""
    x = W.cut(data, off, W.NOT_SPACE)
    if not len(x.start):
        return
    key = W.mix(x.hash + x.doc.astype(np.uint64) * W.U(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    at.sort()
    doc, start, size = x.doc[at], x.start[at], x.end[at] - x.start[at]
    # the distinct words, each between single spaces
    to = np.concatenate([[1], np.cumsum(size + 1) + 1])
    text = np.full(to[-1], 32, np.uint8)
    inside = np.repeat(start - to[:-1], size) + np.arange(size.sum()) + np.repeat(np.arange(len(size)) + 1, size)
    target = np.repeat(to[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum())
    text[target] = x.data[inside]
    del inside, target
    owner = np.repeat(np.arange(len(size)), size + 1)
    wide = text.astype(np.uint64)
    for n in ORDERS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        whole = np.ones(m, bool)
        for j in range(n):
            h = h * W.U(0x100000001B3) + wide[j : j + m]
            if 0 < j < n - 1:
                whole &= text[j : j + m] != 32
        p = np.flatnonzero(whole)
        yield doc[owner[p]], (W.mix(h[p]) >> W.U(64 - BITS)).astype(np.int64)


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct features, counts) of every text of a batch."""
    for a, b, data, off in W.chunks(batch.column("text")):
        doc, feature = (np.concatenate(v) for v in zip(*grams(data, off))) if len(data) and W.NOT_SPACE[data].any() else (np.zeros(0, np.int64),) * 2
        order = np.argsort(doc, kind="stable")
        for i, f in enumerate(np.split(feature[order], np.searchsorted(doc[order], np.arange(1, b - a)))):
            yield a + i, *np.unique(f, return_counts=True)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts of each fold and class hold each feature."""
    seen: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        fold_of, y = batch.column("fold").to_pylist(), batch.column("y").to_pylist()
        for i, f, _ in _counted(batch):
            seen.setdefault((fold_of[i], y[i]), np.zeros(1 << BITS, np.int32))[f] += 1
    for (k, y), n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([y], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([n[at].astype("<i4").tobytes()], pa.binary())], ["fold", "y", "f", "n"])


def _features(kept: np.ndarray):
    """The counts of the kept features in every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes]] = [(b"", b"")] * batch.num_rows
            for i, f, n in _counted(batch):
                own = kept[f]
                out[i] = f[own].astype("<i4").tobytes(), n[own].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), batch.column("y"), *(pa.array(c, pa.binary()) for c in zip(*out))] if out else [batch.column("doc_id"), batch.column("fold"), batch.column("y"), *[pa.array([], pa.binary())] * 2], ["doc_id", "fold", "y", "f", "n"])

    return run


def ratios(has: np.ndarray, sure: float) -> np.ndarray:
    """Log-count ratios of the features, 0 for those that don't stand out; has: texts with each feature, by class."""
    p, q = has[1] + 1.0, has[0] + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # only ratios that stand out from chance: long texts hold thousands of rare n-grams
    ratio[(has.sum(0) < MIN_DOCS) | (np.abs(ratio) < sure * np.sqrt(1 / p + 1 / q))] = 0
    return ratio


def sampled(documents: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, y, fold, text): at most `per_class` labelled ids of each class, one text each."""
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("doc_id"))
    sample = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy("o", "doc_id").limit(per_class)
        sample = own if sample is None else sample.unionByName(own)
    rows = documents.join(F.broadcast(sample.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return written(rows.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text"), "sample")


def fit(documents: DataFrame, labels: DataFrame, *, per_class: int = 1500, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """The table of weights (scale times coefficient) and the intercept; documents: doc_id, text; labels: doc_id, y."""
    sample = sampled(documents, labels, per_class)
    has = np.zeros((FOLDS, 2, 1 << BITS), np.int64)
    held = sample.select("fold", "y", "text").mapInArrow(_holders, "fold int, y int, f binary, n binary").collect()
    for r in held:
        has[r["fold"], r["y"], np.frombuffer(r["f"], "<i4")] += np.frombuffer(r["n"], "<i4")
    # what any of the fits below can use
    trained = [has.sum(0), *(has.sum(0) - has[k] for k in range(FOLDS))]
    kept = np.any([ratios(h, min(SURE)) != 0 for h in trained], axis=0)
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "fold", "y", "text").mapInArrow(_features(kept), f"doc_id {kind}, fold int, y int, f binary, n binary").collect()
    rows.sort(key=lambda r: (r["y"], r["doc_id"]))  # their order must not matter
    f = [(np.frombuffer(r["f"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows]
    y, fold_of = np.array([r["y"] for r in rows], np.float64), np.array([r["fold"] for r in rows])
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(1 << BITS), float(np.log(p / (1 - p)))
    del rows
    losses = []
    for sure in SURE:
        loss = 0.0
        for k in range(FOLDS):
            own, other = np.flatnonzero(fold_of != k), np.flatnonzero(fold_of == k)
            if not len(own) or not len(other):
                continue
            table, b = _fitted([f[i] for i in own], y[own], ratios(trained[1 + k], sure), steps // 2, ridge)
            z = np.array([table[f[i][0]] @ f[i][1] for i in other]) + b
            loss += float((_balance(y)[other] * np.logaddexp(0, np.where(y[other] == 1, -z, z))).sum())
        losses.append(loss)
    return _fitted(f, y, ratios(trained[0], SURE[int(np.argmin(losses))]), steps, ridge)


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same say."""
    p = min(max(y.mean(), 1e-9), 1 - 1e-9)
    return np.where(y == 1, 0.5 / p, 0.5 / (1 - p))


def _fitted(f: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ratio: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, float]:
    """Logistic regression on counts scaled by log-count ratios."""
    f = [(x[ratio[x] != 0], n[ratio[x] != 0]) for x, n in f]
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in f])])
    flat = np.concatenate([x for x, _ in f])
    features, flat = np.unique(flat, return_inverse=True)
    value = ratio[features][flat] * np.concatenate([n for _, n in f])
    row = np.repeat(np.arange(len(f)), np.diff(first))
    size = np.bincount(row, value**2, len(f))
    step = 1.0 / (0.25 * float(np.mean(size)) + 0.25 + ridge)
    m = len(features)
    weight, ahead, b, b_ahead, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    balance = _balance(y)
    for _ in range(steps):  # accelerated gradient descent
        z = np.bincount(row, value * ahead[flat], len(f)) + b_ahead
        g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        new = ahead - step * (np.bincount(flat, value * g[row], m) + ridge * ahead)
        new_b = b_ahead - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t2 * (new - weight), new_b + (t - 1) / t2 * (new_b - b)
        weight, b, t = new, new_b, t2
    table = np.zeros(1 << BITS)
    table[features] = weight * ratio[features]
    return table, float(b)


def score(documents: DataFrame, table: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            z = np.full(batch.num_rows, intercept)
            for a, b, data, off in W.chunks(batch.column("text")):
                for doc, feature in grams(data, off):
                    z[a:b] += np.bincount(doc, w[feature], b - a)
            out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def report(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1, per_class: int = 1500) -> DataFrame:
    """Per row doc_id, held_out, score and predicted; labels are learnt from the other folds only."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(fold(F.col("doc_id"), folds) != held_out)
    table, intercept = fit(docs, known, per_class=per_class)
    return score(docs, table, intercept).select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
