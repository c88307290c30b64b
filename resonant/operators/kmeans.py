"""k-means for many K and many starts at once.

Vectors that a task can hold (HELD) are sent to as many tasks as there are cores, packed, and each task settles its share of the fits
without further passes. In a step most rows can have no other centre than their last one, which products in single precision show;
only the others are compared exactly, and only rows that move change the sums.

Larger tables are read again in every step, and every pass serves all fits that haven't settled: tasks add up sums by (fit, cluster),
which are added again by fit. The starts, costs of candidates and silhouettes are such passes at any size. The driver holds centres
only, whose size depends on the Ks, starts and dimensions and not on the rows.

Defined results. Equal distances go to the smaller cluster number. A cluster that loses all its rows keeps its centre. A K above the
number of different vectors leaves clusters empty. Vectors without length count as at distance 1 from all in silhouettes. Without
rows there are no results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vectors as V

OVERSAMPLE, ROUNDS = 2, 2
#: Bytes of vectors that a task may hold, and rows of a matrix product.
HELD, SUB = 512 << 20, 8192
_PARTIAL = "fit int, n binary, sums binary, cost double"


class Fit(NamedTuple):
    """One K and start, with its centres."""

    k: int
    start: int
    centers: np.ndarray
    cost: float = float("nan")


def _matrix(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)[None, :], 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _summed(rows: DataFrame, fits: dict[int, np.ndarray], each: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, float]]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """{fit: (counts, sums, cost)} of each(vectors, centres, fit), added up within tasks and then by fit."""

    def add(total: dict, key: int, n: np.ndarray, sums: np.ndarray, cost: float) -> None:
        if key in total:
            old = total[key]
            total[key] = (old[0] + n, old[1] + sums, old[2] + cost)
        else:
            total[key] = (n, sums, cost)

    def out(total: dict) -> Iterator[pa.RecordBatch]:
        for key, (n, sums, cost) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([n.tobytes()]), pa.array([sums.tobytes()]), pa.array([cost])], names=["fit", "n", "sums", "cost"])

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                for key, centers in fits.items():
                    add(total, key, *each(x, centers, key))
        yield from out(total)

    def by_fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                add(total, row["fit"], np.frombuffer(row["n"]), np.frombuffer(row["sums"]), row["cost"])
        yield from out(total)

    found = rows.select("vec").mapInArrow(within, _PARTIAL).repartition("fit").mapInArrow(by_fit, _PARTIAL).collect()
    return {r["fit"]: (np.frombuffer(r["n"]), np.frombuffer(r["sums"]).reshape(len(fits[r["fit"]]), -1), r["cost"]) for r in found}


def _nearest(x: np.ndarray, centers: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray, float]:
    d = _distances(x, centers)
    own = d.argmin(1)
    one = np.zeros(d.shape)
    one[np.arange(len(x)), own] = 1
    return one.sum(0), one.T @ x, float(d[np.arange(len(x)), own].sum())


def _pools(rows: DataFrame, most: int, starts: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Candidates of each start and how many rows are nearest to each: rows drawn by their squared distance in ROUNDS passes, as in k-means||.

    A round draws OVERSAMPLE x most rows for a start on average; all starts share its pass.
    """
    first = rows.select("vec", F.xxhash64(F.lit(seed), "id").alias("_h")).orderBy("_h").limit(starts).collect()
    pools = [np.array([first[i % len(first)]["vec"]], dtype=float) for i in range(starts)]
    for turn in range(ROUNDS):
        cost = {i: c for i, (_, _, c) in _summed(rows, dict(enumerate(pools)), _nearest).items()}

        def draw(batches: Iterable[pa.RecordBatch], turn: int = turn, pools: list = pools, cost: dict = cost) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, h = _matrix(batch), batch.column(batch.schema.get_field_index("_h")).to_numpy().view(np.uint64)
                for i, pool in enumerate(pools):
                    share = OVERSAMPLE * most * _distances(x, pool).min(1) / max(cost[i], 1e-300)
                    mixed = (h ^ np.uint64(((turn * starts + i + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    for j in np.flatnonzero((mixed >> np.uint64(11)) / 2.0**53 < share):
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([int(h[j].view(np.int64))]), pa.array([x[j].tolist()])], names=["start", "h", "vec"])

        drawn = rows.select("vec", F.xxhash64(F.lit(seed), "id").alias("_h")).mapInArrow(draw, "start int, h long, vec array<double>").collect()
        drawn.sort(key=lambda r: (r["start"], r["h"]))
        pools = [np.vstack([p, *(np.array([r["vec"]]) for r in drawn if r["start"] == i)]) for i, p in enumerate(pools)]
    weight = _summed(rows, dict(enumerate(pools)), _nearest)
    return pools, [weight[i][0] for i in range(starts)]


def _plus_plus(pool: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres out of a pool by weighted k-means++, settled on the pool."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(pool), p=weight / weight.sum()))]
    while len(chosen) < k:
        d = _distances(pool, pool[chosen]).min(1) * weight
        chosen.append(int(rng.choice(len(pool), p=d / d.sum())) if d.sum() > 0 else chosen[0])
    centers = pool[chosen].copy()
    for _ in range(30):
        own = _distances(pool, centers).argmin(1)
        one = np.zeros((len(pool), k))
        one[np.arange(len(pool)), own] = weight
        n = one.sum(0)
        new = np.where(n[:, None] > 0, (one.T @ pool) / np.maximum(n, 1e-300)[:, None], centers)
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


class _Block(NamedTuple):
    """Vectors in single precision, and exactly: the same matrix where that loses nothing."""

    short: np.ndarray
    exact: np.ndarray
    length: float  # of the longest


def _block(x: np.ndarray) -> _Block:
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = short if (short == x).all() else x
    return _Block(short, exact, float(np.sqrt((x * x).sum(1).max())))


def _bytes_held(rows: DataFrame) -> int:
    """What `_Block`s of all rows take."""
    plain = F.forall("vec", lambda x: x.cast("float").cast("double") == x)
    n, width, short = rows.agg(F.count("*"), F.max(F.size("vec")), F.min(F.coalesce(plain, F.lit(False)))).first()
    return n * width * (4 if short else 12)


def _settle(blocks: list[_Block], centers: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """Centres after Lloyd's steps over vectors in memory, and their cost.

    A centre whose product in single precision is the best by more than twice the rounding error is the nearest one. Rows with
    more candidates are compared as the passes do it.
    """
    k, width = centers.shape
    own = [np.full(len(b.short), -1, np.int32) for b in blocks]
    n, sums = np.zeros(k), np.zeros((k, width))
    for _ in range(max_iter):
        half = (centers * centers).sum(1) / 2
        reach = np.sqrt(2 * half.max())
        with np.errstate(over="ignore", invalid="ignore"):
            short, short_half = centers.astype(np.float32), half.astype(np.float32)[:, None]
        for b, o in zip(blocks, own):
            with np.errstate(over="ignore", invalid="ignore"):
                near = short @ b.short.T
                near -= short_half
                near = near >= near.max(0) - np.float32(4 * (width + 8) * 2.0**-24 * (b.length * reach + reach * reach))
            several = near.view(np.uint8).sum(0, dtype=np.uint8 if k < 256 else np.int32) != 1
            # at -1, before the first step, this looks at the last centre and is not used
            look = np.flatnonzero(several | ~near[o, np.arange(len(o))] | (o < 0))
            if not len(look):
                continue
            to, open_ = near[:, look].argmax(0), np.flatnonzero(several[look])
            if len(open_):
                to[open_] = _distances(b.exact[look[open_]].astype(np.float64), centers).argmin(1)
            moved = to != o[look]
            look, to = look[moved], to[moved]
            step, at, old = np.zeros((len(look), k)), np.arange(len(look)), o[look]
            step[at, to] = 1
            step[at[old >= 0], old[old >= 0]] = -1
            n += step.sum(0)
            sums += step.T @ b.exact[look].astype(np.float64)
            o[look] = to
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        moves = ((new - centers) ** 2).sum(1).max()
        centers = new
        if not moves > tol * tol:
            break
    return centers, sum(float(_distances(b.exact.astype(np.float64), centers).min(1).sum()) for b in blocks)


def _settled_in_parts(rows: DataFrame, fits: list[Fit], max_iter: int, tol: float) -> list[Fit]:
    """Every part gets all vectors and its share of the fits, large and small K alike."""
    parts = min(len(fits), rows.sparkSession.sparkContext.defaultParallelism)
    order = sorted(range(len(fits)), key=lambda i: -fits[i].k)
    turns = [order[s : s + parts][:: 1 if s // parts % 2 else -1] for s in range(0, len(order), parts)]
    share = {p: [t[p] for t in turns if p < len(t)] for p in range(parts)}
    starts = [f.centers for f in fits]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows))
        for part, own in groupby(cells, key=lambda c: c[0]):
            blocks, held = [], []
            for _, raw in own:
                held.append(V.unpacked(raw).reshape(-1, starts[0].shape[1]))
                if sum(map(len, held)) >= SUB:
                    blocks.append(_block(np.vstack(held)))
                    held = []
            if held:
                blocks.append(_block(np.vstack(held)))
            for i in share[part]:
                centers, cost = _settle(blocks, starts[i], max_iter, tol)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([centers.tobytes()]), pa.array([cost])], names=["fit", "centers", "cost"])

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    packed = rows.select("vec").mapInArrow(V.chunks(["vec"], False), "part int, a binary, b binary, c binary").select(every, "a")
    found = packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(each, "fit int, centers binary, cost double").collect()
    done = {r["fit"]: (np.frombuffer(r["centers"]), r["cost"]) for r in found}
    return [f._replace(centers=done[i][0].reshape(f.centers.shape), cost=done[i][1]) for i, f in enumerate(fits)]


def _settled_in_passes(rows: DataFrame, fits: list[Fit], max_iter: int, tol: float) -> list[Fit]:
    moving = dict(enumerate(f.centers for f in fits))
    for _ in range(max_iter):
        if not moving:
            break
        still = {}
        for i, (n, sums, _cost) in _summed(rows, moving, _nearest).items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], moving[i])
            if ((new - moving[i]) ** 2).sum(1).max() > tol * tol:
                still[i] = new
            fits[i] = fits[i]._replace(centers=new)
        moving = still
    costs = _summed(rows, dict(enumerate(f.centers for f in fits)), _nearest)
    return [f._replace(cost=costs[i][2]) for i, f in enumerate(fits)]


def fit_all(rows: DataFrame, ks: Iterable[int], *, starts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """Every K and start of (id, vec), settled (no centre moves by more than tol) or after max_iter steps, with its cost."""
    ks = list(ks)
    if rows.isEmpty():
        return []
    pools, weights = _pools(rows, max(ks), starts, seed)
    fits = [Fit(k, s, _plus_plus(pools[s], weights[s], k, seed + 1000 * k + s)) for k in ks for s in range(starts)]
    settled = _settled_in_parts if _bytes_held(rows) <= HELD else _settled_in_passes
    return settled(rows, fits, max_iter, tol)


def silhouettes(rows: DataFrame, fits: list[Fit]) -> list[float]:
    """The mean cosine silhouette of each fit, in two passes for all: sums of unit vectors by cluster, then every row against them."""
    centers = dict(enumerate(f.centers for f in fits))

    def sums(x: np.ndarray, c: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray, float]:
        one = np.zeros((len(x), len(c)))
        one[np.arange(len(x)), _distances(x, c).argmin(1)] = 1
        return one.sum(0), one.T @ _unit(x), 0.0

    unit = _summed(rows, centers, sums)

    def score(x: np.ndarray, c: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, float]:
        n, s, _ = unit[i]
        u, own, at = _unit(x), _distances(x, c).argmin(1), np.arange(len(x))
        far = n[None, :] - u @ s.T
        a = (far[at, own] - (1 - (u * u).sum(1))) / np.maximum(n[own] - 1, 1)
        other = far / np.where(n > 0, n, 1)[None, :]
        other[:, n == 0] = np.inf
        other[at, own] = np.inf
        b = other.min(1)
        good = (n[own] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
        value = np.where(good, (np.where(good, b, 0) - a) / np.where(good, np.maximum(a, b), 1), 0)
        return np.zeros(len(c)), np.zeros((len(c), 1)), float(value.sum())

    total = _summed(rows, centers, score)
    return [total[i][2] / unit[i][0].sum() for i in range(len(fits))]
