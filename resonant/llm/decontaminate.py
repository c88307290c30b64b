"""Operator 1: benchmark decontamination by a prefix-filtered set join.

A window of an item (`window` consecutive words, or all words of a shorter item) must be contained
in a document whole, so its overlap threshold is its own size and the necessary prefix is one
shingle. The shingles of every window are ordered by their rarity in the documents, and the rarest
is the one that joins. A candidate must leave room for the rest of the window before and after the
shared shingle (positional and length bounds); the window's words are then compared one by one,
first as hashes and then byte by byte.

Defined results. Null or wordless texts have no words (n_words 0, not contaminated); items without
words or with a null id are no items; items that share an id are one; repeated document rows each
get their row; extra columns are ignored; with no items every document is clean.

A benchmark of at most `block_bytes` of text is held by every task, and documents are read twice: once to
count shingles, once to match. A larger one is joined by shuffle (see `_scan_by_shuffle`), with one scan of the
documents whatever its size. Both give the same rows. Texts of any length are read whole, one at a time if long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .spark_io import written

WINDOW, SHINGLE = 13, 4
#: Parts into which the rows of one window are dealt.
SALT = 16
_TABLE_BITS = 20


class Block:
    """Distinct windows of one block of items, with the shingle that stands for each."""

    def __init__(self, items: list[tuple[object, str]], window: int, shingle: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            x = W.cut(*_bytes(text), W.ALNUM, hashed=False)
            words = [x.data[s:e].tobytes() for s, e in zip(x.start, x.end)]
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                found.setdefault(tuple(words[i : i + n]), set()).add(str(item))
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.words = sorted({w for window_ in self.windows for w in window_})
        self.word_hash = _hashes(self.words)
        of = dict(zip(self.words, self.word_hash))
        self.hashes = [np.array([of[w] for w in window_], np.uint64) for window_ in self.windows]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.k = np.minimum(self.size, shingle)
        self.grams = [W.shingle_hashes(h, int(k)) for h, k in zip(self.hashes, self.k)]
        #: for each shingle length the sorted distinct shingles
        self.distinct = {int(k): np.unique(np.concatenate([g for g, kk in zip(self.grams, self.k) if kk == k])) for k in np.unique(self.k)}

    def anchor(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle; counts: by shingle length, in the order of `distinct`."""
        self.anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, g in enumerate(self.grams):
            k = int(self.k[i])
            c = counts[k][np.searchsorted(self.distinct[k], g)]
            o = int(np.lexsort((g, c))[0])
            rows.setdefault(k, []).append((int(g[o]), i, o))
        for k, r in rows.items():
            r.sort()
            self.anchors[k] = tuple(np.array([x[j] for x in r], np.uint64 if j == 0 else np.int64) for j in range(3))


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return raw, np.array([0, len(raw)])


def _hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    return W.cut(data, np.array([0, len(data)]), W.ALNUM).hash


def _members(hashes: np.ndarray, among: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are in a sorted array; a small bit table sorts out nearly all others."""
    at = np.flatnonzero(table[hashes & W.U((1 << _TABLE_BITS) - 1)])
    i = np.minimum(np.searchsorted(among, hashes[at]), len(among) - 1)
    return at[among[i] == hashes[at]]


def _table(among: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _TABLE_BITS, bool)
    out[among & W.U((1 << _TABLE_BITS) - 1)] = True
    return out


def _count(block: Block, column: str):
    tables = {k: _table(d) for k, d in block.distinct.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(len(d), np.int64) for k, d in block.distinct.items()}
        for batch in batches:
            for _, _, data, off in W.chunks(batch.column(column)):
                x = W.cut(data, off, W.ALNUM)
                for k, d in block.distinct.items():
                    h = W.shingle_hashes(x.hash, k)
                    at = _members(h, d, tables[k])
                    seen[k] += np.bincount(np.searchsorted(d, h[at]), minlength=len(d))
        for k, c in seen.items():
            at = np.flatnonzero(c)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64)), pa.array(c[at])], ["k", "i", "c"])

    return run


def _matches(block: Block, x: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every window that occurs in the chunk."""
    at_all, win_all = [], []
    doc_of = None
    for k, (gram, win, off) in block.anchors.items():
        h = W.shingle_hashes(x.hash, k)
        at = _members(h, gram, block.tables[k])
        if not len(at):
            continue
        lo, hi = np.searchsorted(gram, h[at], "left"), np.searchsorted(gram, h[at], "right")
        which = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        at, w, o = np.repeat(at, hi - lo), win[which], off[which]
        first, size = at - o, block.size[w]
        if doc_of is None:
            doc_of = x.doc
        d = doc_of[at]
        fits = (first >= x.first[d]) & (first + size <= x.first[d + 1])  # positional and length bounds
        first, w, size = first[fits], w[fits], size[fits]
        for n in np.unique(size):
            at_n = size == n
            f, v = first[at_n], w[at_n]
            same = np.ones(len(f), bool)
            for j in range(n):
                same[same] = x.hash[f[same] + j] == block.by_size[int(n)][block.row[v[same]], j]
            at_all.append(f[same])
            win_all.append(v[same])
    if not at_all:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, w = np.concatenate(at_all), np.concatenate(win_all)
    # byte by byte: each distinct position of the candidates against the word its hash stands for
    covered = np.zeros(len(x.start) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + block.size[w], -1)
    spots = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    wrong = [p for p in spots if block.word_of[int(x.hash[p])] != x.data[x.start[p] : x.end[p]].tobytes()]
    if wrong:
        bad = np.zeros(len(x.start) + 1, np.int64)
        bad[1:] = np.cumsum(np.isin(np.arange(len(x.start)), wrong))
        keep = bad[first + block.size[w]] == bad[first]
        first, w = first[keep], w[keep]
    return first, w


def _scan(block: Block, column: str):
    block.tables = {k: _table(g) for k, (g, _, _) in block.anchors.items()}
    block.word_of = {int(h): w for h, w in zip(block.word_hash, block.words)}
    block.by_size, block.row = {}, np.zeros(len(block.windows), np.int64)
    for n in np.unique(block.size):
        at = np.flatnonzero(block.size == n)
        block.by_size[int(n)] = np.stack([block.hashes[i] for i in at])
        block.row[at] = np.arange(len(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for a, b, data, off in W.chunks(batch.column(column)):
                x = W.cut(data, off, W.ALNUM)
                n_words[a:b] = np.diff(x.first)
                first, w = _matches(block, x)
                if len(first):
                    order = np.argsort(first, kind="stable")
                    first, w = first[order], w[order]
                    d = np.searchsorted(x.first, first, "right") - 1
                    for i in np.unique(d):
                        lo, hi = np.searchsorted(d, i), np.searchsorted(d, i, "right")
                        items[a + i] = sorted({it for v in np.unique(w[lo:hi]) for it in block.items[v]})
                        s, e = first[lo:hi] - x.first[i], first[lo:hi] + block.size[w[lo:hi]] - x.first[i]
                        reach = np.maximum.accumulate(e)
                        begins = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
                        ends = reach[np.concatenate([begins[1:] - 1, [len(s) - 1]])]
                        spans[a + i] = [{"s": int(p), "e": int(q)} for p, q in zip(s[begins], ends)]
            rest = [batch.column(c) for c in batch.schema.names if c != column]
            names = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

    return run


def scan(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, spans of hit words, ids of the items hit) for every row of documents."""
    schema_id = documents.schema[doc_id].dataType.simpleString()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        return _scan_by_shuffle(docs, schema_id, items, size, window, shingle)
    block = Block([tuple(r) for r in items.collect()], window, shingle)
    counts = {k: np.zeros(len(d), np.int64) for k, d in block.distinct.items()}
    if block.windows:
        for k, i, c in docs.select("text").mapInArrow(_count(block, "text"), "k int, i long, c long").groupBy("k", "i").agg(F.sum("c")).collect():
            counts[k][i] = c
    block.anchor(counts)
    return docs.mapInArrow(_scan(block, "text"), f"doc_id {schema_id}, n_words long, spans {_SPANS}, items array<string>")


# A benchmark that is too large for every task to hold.

_MOST_BITS = 27


def _slots(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Places in the bit table of shingles of windows of n words."""
    return (W.mix(hashes + W.U(n * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) & W.U((1 << bits) - 1)).astype(np.int64)


def _windows(window: int):
    """(w, n, item) of every window of every item: the digest of its words, how many they are, and the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("id").to_pylist()
            for a, _, data, off in W.chunks(batch.column("text")):
                x = W.cut(data, off, W.ALNUM)
                rows = []
                for d in range(len(x.first) - 1):
                    s, e = int(x.first[d]), int(x.first[d + 1])
                    n = min(window, e - s)
                    rows += [(_digest(x, i, n), n, _grams(x, i, n), str(items[a + d])) for i in range(s, e - n + 1 if n else s)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 4, [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.string()])], ["w", "n", "grams", "item"])

    return run


def _digest(x: W.Words, at: int, n: int) -> bytes:
    """Of the words of a window, 128 bits."""
    return hashlib.blake2b(b" ".join(x.data[s:e].tobytes() for s, e in zip(x.start[at : at + n].tolist(), x.end[at : at + n].tolist())), digest_size=16).digest()


def _grams(x: W.Words, at: int, n: int) -> np.ndarray:
    return W.shingle_hashes(x.hash[at : at + n], min(n, SHINGLE)).view(np.int64)


def _bit_rows(bits: int):
    """The packed bit table of a task's shingles, in slices of 64 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            grams = batch.column("grams")
            of = np.repeat(np.array(batch.column("n"), np.int64), np.diff(np.array(grams.offsets)))
            flat = np.array(grams.flatten(), np.int64).view(np.uint64)
            for n in np.unique(of):
                table[_slots(flat[of == n], int(n), bits)] = True
        packed = np.packbits(table).reshape(-1, min(1 << 16, 1 << (bits - 3)))
        own = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([packed[i].tobytes() for i in own], pa.binary())], ["slice", "bits"])

    return run


def _or(t: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x.as_py(), np.uint8) for x in t.column("bits")]
    return pa.table({"slice": t.column("slice").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})


_SPANS = "array<struct<s:long,e:long>>"


def _candidates(shared, sizes: list[int], bits: int):
    """Per row its words, and the windows all of whose shingles are in the bit table: (first word, size, digest, shingles)."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64()), ("w", pa.binary()), ("grams", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(shared.value, np.uint8)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, data, off in W.chunks(batch.column("text")):
                x = W.cut(data, off, W.ALNUM)
                n_words[a:b] = np.diff(x.first)
                for n in sizes:
                    k = min(n, SHINGLE)
                    at = _slots(W.shingle_hashes(x.hash, k), n, bits)
                    there = np.concatenate([[0], np.cumsum(packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1, dtype=np.int64)])
                    m = n - k + 1
                    first = np.flatnonzero(there[m:] - there[:-m] == m) if len(there) > m else np.zeros(0, np.int64)
                    d = np.searchsorted(x.first, first, "right") - 1
                    ok = first + n <= x.first[d + 1]
                    for i, doc in zip(first[ok].tolist(), d[ok].tolist()):
                        found[a + doc].append({"s": i - int(x.first[doc]), "n": n, "w": _digest(x, i, n), "grams": _grams(x, i, n)})
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(n_words), pa.array(found, kind)], ["row", "doc_id", "n_words", "found"])
            row += batch.num_rows

    return run


def _scan_by_shuffle(docs: DataFrame, schema_id: str, items: DataFrame, size: int, window: int, shingle: int) -> DataFrame:
    """The same for a benchmark of any size, in one scan of the documents.

    What every task gets is a bit table of fixed size that has the shingles of all windows. Windows of documents all of whose
    shingles are in it are written, with the row's key, and nothing else of the texts. Their distinct ones, however often they
    occur, are counted by shingle; each benchmark window is joined by its rarest one, at the same place (the positional bound)
    in a window of the same size (the length bound), and compared by a 128-bit digest of its words. The rows of a
    window that many documents share are dealt by salt.
    """
    if shingle != SHINGLE:
        raise ValueError(f"a large benchmark needs shingles of {SHINGLE} words")
    spark = docs.sparkSession
    windows = items.mapInArrow(_windows(window), "w binary, n long, grams array<long>, item string")
    own = written(windows.groupBy("w", "n").agg(F.first("grams").alias("grams"), F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sizes = sorted(r["n"] for r in own.select("n").distinct().collect())  # at most `window` of them
    bits = min(_MOST_BITS, max(19, (4 * size).bit_length()))
    slices = own.select("n", "grams").mapInArrow(_bit_rows(bits), "slice long, bits binary").groupBy("slice").applyInArrow(_or, "slice long, bits binary").collect()
    table, width = np.zeros(1 << (bits - 3), np.uint8), min(1 << 16, 1 << (bits - 3))
    for r in slices:
        table[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())
    rows = written(docs.select("doc_id", "text").mapInArrow(_candidates(shared, sizes, bits), f"row long, doc_id {schema_id}, n_words long, found array<struct<s:long,n:long,w:binary,grams:array<long>>>"), "rows")

    hits = rows.select("row", F.explode("found").alias("f")).select("row", "f.s", "f.n", "f.w", "f.grams")
    distinct = written(hits.groupBy("w", "n").agg(F.first("grams").alias("grams"), F.count("*").alias("c")), "distinct")
    rarity = distinct.select("n", "c", F.explode("grams").alias("gram")).groupBy("n", "gram").agg(F.sum("c").alias("often"))
    listed = own.select("w", "n", F.posexplode("grams").alias("o", "gram")).join(rarity, ["n", "gram"])  # windows with a shingle that no document has are gone
    whole = listed.groupBy("w", "n").agg(F.min(F.struct("often", "gram", "o")).alias("a"), F.count("*").alias("k")).where(F.col("k") == F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1)
    anchors = whole.select(F.col("w").alias("v"), "n", "a.gram", "a.o")
    matched = distinct.select("w", "n", F.posexplode("grams").alias("o", "gram")).join(anchors, ["n", "gram", "o"]).where("w = v").select("w", "n")
    known = matched.join(own.select("w", "n", "items"), ["w", "n"]).select("w", "n", "items", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = hits.select("row", "s", "n", "w", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int").alias("salt")).join(known, ["w", "n", "salt"])
    merged = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = rows.select("row", "doc_id", "n_words").join(merged, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _span_words() -> F.Column:
    """Words in the union of the sorted spans."""
    return F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256 and whether `share` times its hit words reach its words."""
    hit = scan(documents, benchmark, **options).withColumn("n_hit", _span_words())
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )



def keep_clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents in which no window of an item was found, with their columns.

    `contaminated` asks for a share of the document's words; here any found window is enough, as a
    long document would else carry a short item into the training data.
    """
    keyed = documents.select(F.struct(*documents.columns).alias("doc_id"), F.col(text).alias("text"))
    return decontaminate(keyed, benchmark, **options).where("n_hit = 0").select("doc_id.*")
