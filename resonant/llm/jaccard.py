"""Operator 7: exact n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Two texts link when 100 * |A & B| >= 85 * |A | B| for their sets of 4-word shingles. The steps:

1. Tasks gather blocks of texts, drop repeated sets inside a block, and send every block's sorted
   shingle keys to key ranges as packed arrays. A range counts in how many sets each key occurs. There are
   as many ranges as all shingles need, so that one has about RANGE_KEYS of them however large the input is.
2. Keys of one set only go no further. A block gets back, for each set, its shared keys with their
   counts. Linked sets share at least 85 % of either, so a set with fewer shared keys is done. For
   the rest, shared keys are ordered by rarity (a global order), and two linked sets must have a
   key in common among the first n - ceil(0.85 n) + 1 of all their keys (rarest first).
3. Sets with such a key in common form candidate groups (components over one star for each key).
4. A group is a tile; a group too large for one is cut into size bands, in which linked sets are at
   most one band apart, and salted into tiles of pairs of pieces, so every pair of sets that can
   link meets in a tile, and is tested in one tile only. In a tile, sizes bound the partners, bit
   counts of hashed bitmaps bound the overlap from above, and what remains is intersected exactly.
   Every pair is tested; a spanning forest of the links and each set's number of links leave the tile.
5. Components of the forests and sums of the links, joined back to all rows by the digest of their set.

Keys are 48-bit hashes of shingles, compared as such; sets are told apart by 128-bit digests.

Defined results. Texts without words, and nulls, have an empty set, link with nothing and are their
own component. Texts of fewer words than a shingle have one shingle, the whole sequence. Copies and
repeated rows share a component and are links: n_links counts the other rows that a row links with. The
component id is the smallest id that is not null. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import components
from .packed import large, pack, small, unpack
from .spark_io import written

SHINGLE, PERCENT = 4, 85
KEY_BITS = 48
#: Shingles that a block gathers before it is sent.
GATHER = 1_000_000
#: Shingles of all sets that a key range may have on average.
RANGE_KEYS = 1_000_000
#: Shared keys and sets that a tile may hold.
TILE_KEYS, TILE_SETS = 2_000_000, 4_000
#: Most components whose id is broadcast.
HOT = 1_000


def least_overlap(n, percent: int = PERCENT):
    """The smallest overlap that a linked set of size n can have."""
    return (percent * n + 99) // 100


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of every text."""
    for a, b, data, off in W.chunks(batch.column("text")):
        x = W.cut(data, off, W.NOT_SPACE)
        h = W.shingle_hashes(x.hash, shingle)
        for s, e in zip(x.first[:-1].tolist(), x.first[1:].tolist()):
            n = e - s
            if n >= shingle:
                v = np.sort(h[s : e - shingle + 1])
                if len(v) > 1:
                    v = v[np.concatenate([[True], v[1:] != v[:-1]])]
                yield v
            else:
                yield W.shingle_hashes(x.hash[s:e], n) if n else h[:0]


def _digest(v: np.ndarray) -> bytes | None:
    return hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None


def _classes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = [], []
            for v in _sets(batch, shingle):
                n.append(len(v))
                cls.append(_digest(v))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary())], ["doc_id", "n_shingles", "cls"])

    return run


_BLOCKS = "block long, r long, k binary, i binary, n binary, cls binary"


def _blocks(shingle: int, log_ranges: int):
    """Rows of packed keys by range; the first row of a block also has the sizes and digests of its sets."""

    def emit(block: int, sets: list[np.ndarray], classes: list[bytes]) -> pa.RecordBatch:
        keys = np.concatenate(sets) >> W.U(64 - KEY_BITS)
        doc = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        r = (keys >> W.U(KEY_BITS - log_ranges)).astype(np.int64)
        own = np.unique(r)
        cut = list(zip(np.searchsorted(r, own), np.searchsorted(r, own, "right")))
        sizes = [small(np.array([len(v) for v in sets], np.int64)), *[None] * (len(own) - 1)]
        digests = [b"".join(classes), *[None] * (len(own) - 1)]
        columns = [pa.array(np.full(len(own), block)), pa.array(own), *(pa.array(c, pa.binary()) for c in ([pack(keys[a:b]) for a, b in cut], [small(doc[a:b]) for a, b in cut], sizes, digests))]
        return pa.RecordBatch.from_arrays(columns, ["block", "r", "k", "i", "n", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        kept: dict[bytes, np.ndarray] = {}
        n = 0
        for batch in batches:
            for v in _sets(batch, shingle):
                if len(v) and (c := _digest(v)) not in kept:
                    kept[c] = v
                    n += len(v)
                    if n >= GATHER:
                        yield emit(block, list(kept.values()), list(kept))
                        block, kept, n = block + 1, {}, 0
        if kept:
            yield emit(block, list(kept.values()), list(kept))

    return run


_SHARED = "block long, k binary, i binary, f binary, n binary, cls binary"


def _shared(t: pa.Table) -> pa.Table:
    """For one key range: what each block's sets share with other sets, with the class of each key's count."""
    rows = t.select(["block", "k", "i", "n", "cls"]).to_pylist()
    keys = [unpack(x["k"]) for x in rows]
    size = [len(k) for k in keys]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.concatenate([first, [len(ordered)]]))
    df = np.empty(len(flat), np.int64)
    df[order] = np.repeat(count, count)
    out, at = [], 0
    for x, k, n in zip(rows, keys, size):
        f = df[at : at + n]
        at += n
        own = f > 1
        if own.any() or x["n"] is not None:
            rare = np.minimum(255, 8 * np.log2(np.maximum(f[own], 1))).astype(np.int64)
            out.append((x["block"], pack(k[own]), small(large(x["i"])[own]), small(rare), x["n"], x["cls"]))
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 6, [pa.int64(), *[pa.binary()] * 5])], ["block", "k", "i", "f", "n", "cls"])


_LEFT = "cls binary, n long, s long, keys binary, prefix array<long>"


def _left(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """For one block: the sets that may have a partner, their shared keys and the keys that they must meet at."""
        rows = t.to_pylist()
        head = next(x for x in rows if x["n"] is not None)
        n = large(head["n"])
        keys = np.concatenate([unpack(x["k"]) for x in rows])
        doc = np.concatenate([large(x["i"]) for x in rows])
        rare = np.concatenate([large(x["f"]) for x in rows])
        s = np.bincount(doc, minlength=len(n))
        ok = (s >= least_overlap(n, percent))[doc]
        keys, doc, rare = keys[ok], doc[ok], rare[ok]
        order = np.lexsort((keys, rare, doc))
        keys, doc = keys[order], doc[order]
        out = []
        for d in np.unique(doc):
            a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
            own = keys[a:b]
            most = int(n[d]) - int(least_overlap(n[d], percent)) + 1 - (int(n[d]) - len(own))
            out.append((head["cls"][16 * d : 16 * d + 16], int(n[d]), len(own), pack(np.sort(own)), own[:most].astype(np.int64)))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 5, kinds)], ["cls", "n", "s", "keys", "prefix"])

    return run


def pairs(n: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked k > i) for the sets of a tile, ordered by n; sets hold all keys that two of them can share.

    With sides, only sets of different sides are tested.
    """
    m = len(sets)
    s = np.array([len(v) for v in sets])
    flat = np.concatenate(sets)
    width = 1 << min(12, max(6, int(2 * np.median(s)).bit_length()))
    bits = np.zeros((m, width), bool)
    bits[np.repeat(np.arange(m), s), (W.mix(flat) & W.U(width - 1)).astype(np.int64)] = True
    signature = np.packbits(bits, axis=1).view(np.uint64)
    del bits
    # keys as small numbers, so that one set is a mask that many others are looked up in at once
    known, number = np.unique(flat, return_inverse=True)
    number = np.split(number.astype(np.int32), np.cumsum(s)[:-1])
    mask = np.zeros(len(known), bool)
    del flat, known
    until = np.searchsorted(n, n * 100 // percent, "right")
    for i in range(m - 1):
        j = np.arange(i + 1, until[i])
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        differ = np.bitwise_count(signature[j] ^ signature[i]).sum(1, dtype=np.int64)
        bound = (s[j] + s[i] - differ) // 2
        j = j[100 * bound >= percent * (n[j] + n[i] - bound)]
        if not len(j):
            continue
        mask[number[i]] = True
        same = np.add.reduceat(mask[np.concatenate([number[k] for k in j])], np.cumsum(s[j]) - s[j], dtype=np.int64)
        mask[number[i]] = False
        j = j[100 * same >= percent * (n[i] + n[j] - same)]
        if len(j):
            yield i, j


def linked(n: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, percent: int = PERCENT, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each set of a tile, and the rows of all sets that it links with."""
    label, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for i, j in pairs(n, sets, percent, side):
        links[i] += rows[j].sum()
        links[j] += rows[i]
        other = np.unique(label[j])
        if len(other) > 1 or other[0] != label[i]:
            label[np.isin(label, other)] = label[i]
    return label, links


def forest(n: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Component label of each set of a tile."""
    return linked(n, sets, np.ones(len(sets), np.int64), percent)[0]


def _tile(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """(a, b, links): of every linked set the least set of its component in the tile, and the rows that it links with."""
        n = np.array(t.column("n"), np.int64)
        order = np.argsort(n, kind="stable")
        keys = t.column("keys").to_pylist()
        cls = t.column("cls").to_pylist()
        # pieces meet others in one tile and themselves in another
        within = t.column("kind")[0].as_py() < 2 and t.column("x")[0].as_py() == t.column("y")[0].as_py()
        side = None if within else np.array(t.column("side"), np.int64)[order]
        label, links = linked(n[order], [unpack(keys[i]) for i in order], np.array(t.column("copies"), np.int64)[order], percent, side)
        least: dict[int, bytes] = {}
        for c, i in zip(label.tolist(), order):
            least[c] = min(least.get(c, cls[i]), cls[i])
        out = [(cls[i], least[c], k) for c, i, k in zip(label.tolist(), order, links.tolist()) if k]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])

    return run


def _tiled(groups: DataFrame) -> DataFrame:
    """Rows of (group, cls, n, copies, keys, side), each once for every tile (group, band, kind, x, y) that it is in.

    The sizes of a group and the pieces of its bands are one row, since bands grow with the logarithm of a set's size;
    they are written, so that a group's rows can be split at the join. What it gives is dealt by tile, not by group.
    """
    # bands a little wider than the size ratio of linked sets, so that rounding can't part them by two
    step = -math.log((PERCENT - 0.1) / 100)
    banded = groups.withColumn("own", F.floor(F.log(F.col("n").cast("double")) / step))
    bands = banded.groupBy("group", "own").agg(F.count("*").alias("sets"), F.sum("s").alias("total"))
    piece = F.struct("own", F.greatest(F.ceil(F.col("total") * 2 / TILE_KEYS), F.ceil(F.col("sets") * 2 / TILE_SETS)).cast("long").alias("p"))
    counts = bands.groupBy("group").agg(F.sum("sets").alias("sets"), F.sum("total").alias("total"), F.map_from_entries(F.collect_list(piece)).alias("pieces"))
    sized = banded.join(written(counts, "groups"), "group")
    fits = (F.col("sets") <= TILE_SETS) & (F.col("total") <= TILE_KEYS)
    zero = F.lit(0).cast("long")
    pieces = lambda by: F.try_element_at("pieces", F.col("own") + by)
    mine = F.pmod(F.xxhash64("cls"), pieces(0))
    spot = lambda band, kind, x, y, side: F.struct(band.cast("long").alias("band"), F.lit(kind).cast("long").alias("kind"), x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("long").alias("side"))
    upto = lambda n: F.sequence(zero, n - 1)
    none = F.array().cast("array<struct<band:bigint,kind:bigint,x:bigint,y:bigint,side:bigint>>")
    spots = F.concat(
        F.transform(upto(F.col("p")), lambda y: spot(F.col("own"), 1, F.least("mine", y), F.greatest("mine", y), F.col("mine") > y)),
        F.when(F.col("above").isNotNull(), F.transform(upto(F.col("above")), lambda y: spot(F.col("own"), 2, F.col("mine"), y, F.lit(0)))).otherwise(none),
        F.when(F.col("below").isNotNull(), F.transform(upto(F.col("below")), lambda y: spot(F.col("own") - 1, 2, y, F.col("mine"), F.lit(1)))).otherwise(none),
    )
    placed = sized.withColumns({"p": pieces(0), "mine": mine, "above": pieces(1), "below": pieces(-1)})
    at = F.explode(F.when(fits, F.array(spot(zero, 0, zero, zero, zero))).otherwise(spots)).alias("at")
    tiled = placed.select("group", "cls", "n", "copies", "keys", at).select("group", "cls", "n", "copies", "keys", "at.*")
    return tiled.repartition("group", "band", "kind", "x", "y")


def join(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row doc_id, n_shingles, component_id and n_links."""
    kind = documents.schema[doc_id].dataType.simpleString()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(docs.mapInArrow(W.tidied(_classes(shingle)), f"doc_id {kind}, n_shingles long, cls binary"), "sets")
    shingles = rows.agg(F.sum("n_shingles")).first()[0] or 0
    log_ranges = max(3, docs.rdd.getNumPartitions().bit_length() + 1, (-(-shingles // RANGE_KEYS) - 1).bit_length())
    blocks = docs.select("text").mapInArrow(W.tidied(_blocks(shingle, log_ranges)), _BLOCKS)
    shared = blocks.groupBy("r").applyInArrow(W.tidied(_shared), _SHARED)
    left = shared.groupBy("block").applyInArrow(W.tidied(_left(percent)), _LEFT)
    left = written(left.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "s", "keys", "prefix"))), "candidates")

    met = left.select("cls", F.explode("prefix").alias("key"))
    # the small sides of joins by a key that many rows may have are written, so that adaptive execution can split these rows
    stars = written(met.groupBy("key").agg(F.min("cls").alias("b"), F.count("*").alias("c")).where("c > 1").select("key", "b"), "stars")
    groups = components(met.join(stars, "key").select(F.col("cls").alias("a"), "b"))
    copies = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"))
    grouped = left.select("cls", "n", "s", "keys").join(groups.select(F.col("node").alias("cls"), F.col("root").alias("group")), "cls").join(copies, "cls")
    links = written(_tiled(grouped).groupBy("group", "band", "kind", "x", "y").applyInArrow(W.tidied(_tile(percent)), "a binary, b binary, links long"), "links")
    roots = components(links).select(F.col("node").alias("cls"), "root")
    others = links.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    known = written(roots.join(others, "cls").join(copies.where("copies > 1"), "cls", "full"), "known")

    alone = F.concat(F.lit("alone "), F.coalesce(F.to_json(F.struct("doc_id")), F.lit(""))).cast("binary")
    n_links = (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long")
    rooted = rows.join(known, "cls", "left").select("doc_id", "n_shingles", n_links.alias("n_links"), F.coalesce("root", "cls", alone).alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c"))
    # Roots of a thousandth of all rows or more are at most a thousand, so these may be broadcast;
    # their rows, however many, then need not meet in one task.
    hot = least.where(F.col("c") * HOT >= rows.count()).select("root", F.struct("component_id").alias("hot"))
    marked = rooted.join(F.broadcast(hot), "root", "left")
    own = ["doc_id", "n_shingles", "n_links"]
    most = marked.where("hot is not null").select(*own, F.col("hot.component_id").alias("component_id"))
    other = marked.where("hot is null").drop("hot").join(least.drop("c"), "root").select(*own, "component_id")
    return most.unionByName(other).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "n_links")


def keep_one(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each group of linked ones; the smallest id stays.

    Rows are told apart by their place in the input, which must read the same each time (a table).
    """
    placed = documents.select(F.struct(*documents.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    keyed = placed.select(F.struct(F.col("doc").getField(doc_id).isNull().alias("z"), F.col("doc").getField(doc_id).alias("id"), "row").alias("doc_id"), F.col("doc").getField(text).alias("text"))
    found = join(keyed, shingle=shingle, percent=percent)
    kept = found.where("doc_id = component_id or n_shingles = 0").select(F.col("doc_id.row").alias("row"))
    return placed.join(kept, "row", "left_semi").select("doc.*")
