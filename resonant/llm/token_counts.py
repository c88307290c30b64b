"""Operator 2: token counts by trie-shared dynamic programming.

Texts are cut into pre-tokens; every distinct pre-token gets the number of tokens in its most
likely segmentation under a unigram model of the vocabulary. Distinct pre-tokens are visited in
sorted order, which makes rows of their trie: a node's best forward score is computed once, from those of
its ancestors, for all nodes of a depth together, and the count at each terminal node is stored. A text's
count is the sum over its pre-tokens. Tokens are recognised by 64-bit hashes of their bytes.

The unigram model is fitted on all documents by one step of expectation maximisation with best
segmentations: starting from the shape that frequency-ranked vocabularies follow (token i has log
probability -log(i + 2), single bytes come last), every task segments its distinct pre-tokens and
adds up how often each token is used; Spark sums these counts over the tasks, and a token's score is
log((count + 1) / (all + size of the vocabulary)). What reaches the driver is one number for each
token of the vocabulary. Of equally likely segmentations the one with fewer tokens counts.

Defined results. Null or empty texts have no tokens; repeated rows each get their row and count
in the model; extra columns are ignored; an empty table gives an empty result (without counts all
tokens are equally likely). Memory is bounded by the distinct pre-tokens of one chunk of texts, or of one
text if that is longer, and by a store of at most STORED counts; whole texts of any length are counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .vocabulary import SPLIT, Store, Vocabulary, default_path, stretches

STORED = 500_000
#: Bytes of the pre-tokens that are scored depth by depth, TRIE_ROWS of them at once; longer ones are scored one by one.
WIDE, TRIE_ROWS = 32, 50_000
_BASE, _STEP, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
#: A text's tokens and pre-tokens are summed as one number.
_UNIT = 1 << 50


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _tokens(v: Vocabulary) -> Tokens:
    return Tokens(v)


class Tokens:
    """The vocabulary's short tokens as a sorted array of hashes, behind a bit table that sorts out most others."""

    BITS = 21

    def __init__(self, v: Vocabulary):
        self.powers = np.multiply.accumulate(np.array([1] + [_BASE] * WIDE, np.uint64))
        short = [(t, i) for t, i in v.id_of.items() if len(t) <= WIDE]
        self.widest = max((len(t) for t, _ in short), default=0)
        keys = np.array([self._of(t) for t, _ in short], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in short], np.int64)[order]
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.keys & W.U((1 << self.BITS) - 1)] = True

    @staticmethod
    def _of(token: bytes) -> int:
        h = 0
        for byte in token:
            h = (h * _BASE + byte + 1) & _ALL
        return int(W.mix(np.array([(h + len(token) * _STEP) & _ALL], np.uint64))[0])

    def find(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes of strings of this size that are tokens, and the tokens."""
        keys = W.mix(hashes + W.U(size * _STEP & _ALL))
        at = np.flatnonzero(self.table[keys & W.U((1 << self.BITS) - 1)])
        i = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[i] == keys[at]
        return at[same], self.ids[i[same]]


class Unigram:
    def __init__(self, v: Vocabulary, scores: np.ndarray):
        self.v, self.scores, self.listed = v, scores, scores.tolist()
        self.tokens = _tokens(v)
        self.length = np.array([v.length.get(i, 1) for i in range(len(scores))], np.int64)
        self.ends: dict[int, list[tuple[int, float, int]]] = {}
        self.first, self.spaced = Store(STORED), Store(STORED)

    def _trie(self, flat: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct pieces of at most WIDE bytes: tokens in the best segmentation, and the last token of every prefix.

        A row stands for a new node of the trie at every depth beyond what it shares with the row above.
        The nodes of one depth are scored together, and the rows that share a node take over its score.
        """
        n, wide = len(size), int(size.max())
        byte = np.zeros((n, wide), np.uint8)
        byte[np.arange(wide) < size[:, None]] = np.frombuffer(flat, np.uint8)
        differ = byte[1:] != byte[:-1]
        shared = np.concatenate([[0], np.minimum(np.where(differ.any(1), differ.argmax(1), wide), np.minimum(size[1:], size[:-1]))])
        hashes, score = np.zeros((wide + 1, n), np.uint64), np.zeros((wide + 1, n))
        count, last = np.zeros((wide + 1, n), np.int32), np.zeros((wide + 1, n), np.int32)
        for j in range(1, wide + 1):
            hashes[j] = hashes[j - 1] * W.U(_BASE) + byte[:, j - 1] + W.U(1)
            inside = size >= j
            new = inside & (shared < j)
            own = np.flatnonzero(new)
            top, least, token = np.full(len(own), -np.inf), np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
            for k in range(min(j, self.tokens.widest), 0, -1):
                at, ids = self.tokens.find(hashes[j, own] - hashes[j - k, own] * self.tokens.powers[k], k)
                s, c = self.scores[ids] + score[j - k, own[at]], count[j - k, own[at]] + 1
                better = (s > top[at]) | ((s == top[at]) & (c < least[at]))
                at = at[better]
                top[at], least[at], token[at] = s[better], c[better], ids[better]
            score[j, own], count[j, own], last[j, own] = top, least, token
            rows = np.flatnonzero(inside & ~new)
            node = np.maximum.accumulate(np.where(new, np.arange(n), 0))[rows]
            score[j, rows], count[j, rows], last[j, rows] = score[j, node], count[j, node], last[j, node]
        return count[size, np.arange(n)], last

    def _ends(self, state: int) -> list[tuple[int, float, int]]:
        """(length, score, token) of every token that ends where the automaton is in this state."""
        out, t = [], self.v.longest[state]
        while t is not None:
            out.append((self.v.length[t], self.listed[t], t))
            t = self.v.shorter(t)
        self.ends[state] = out
        return out

    def _walk(self, piece: bytes) -> tuple[int, list[int]]:
        """The same for one longer piece: tokens in the best segmentation, and the last token of every prefix."""
        state, score, count, last = 0, [0.0], [0], [0]
        for j, byte in enumerate(piece, 1):
            to = self.v.step.get(state << 8 | byte)
            state = self.v.advance(state, byte) if to is None else to
            top, n, token = -math.inf, 0, 0
            for size, s, t in self.ends.get(state) or self._ends(state):
                if size <= j:
                    s += score[j - size]
                    if s > top or (s == top and count[j - size] + 1 < n):
                        top, n, token = s, count[j - size] + 1, t
            score.append(top)
            count.append(n)
            last.append(token)
        return count[-1], last

    def best(self, pieces: Iterable[str], often: dict[str, int] | None = None) -> tuple[dict[str, int], np.ndarray]:
        """The tokens in the best segmentation of each distinct pre-token, and how often each token of the vocabulary is used."""
        used = np.zeros(len(self.scores), np.int64)
        names = sorted(pieces)
        raw = list(map(str.encode, names))  # in the order of their bytes, too
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        weight = None if often is None else np.fromiter(map(often.__getitem__, names), np.int64, len(names))
        count = np.zeros(len(raw), np.int64)
        narrow = np.flatnonzero(size <= WIDE)
        for a in range(0, len(narrow), TRIE_ROWS):
            own = narrow[a : a + TRIE_ROWS]
            count[own], last = self._trie(b"".join(raw[i] for i in own.tolist()), size[own])
            at, row = size[own], np.arange(len(own)) if often is not None else own[:0]
            while len(row):
                token = last[at, row]
                np.add.at(used, token, weight[own[row]])
                at = at - self.length[token]
                at, row = at[at > 0], row[at > 0]
        for i in np.flatnonzero(size > WIDE).tolist():
            count[i], last = self._walk(raw[i])
            j = len(raw[i]) if often is not None else 0
            while j:
                used[last[j]] += weight[i]
                j -= self.v.length[last[j]]
        return dict(zip(names, count.tolist())), used

    def _learn(self, store: Store, wanted: list[list[str]], lead: str) -> None:
        cut = {x: SPLIT.findall(lead + x) for x in store.lacking(wanted)}
        known, _ = self.best(set().union(*cut.values()))
        store.update((x, sum(known[p] for p in own) * _UNIT + len(own)) for x, own in cut.items())

    def totals(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        cut = [stretches(t) for t in texts]
        self._learn(self.first, [c[0] for c in cut], "")
        self._learn(self.spaced, [c[1] for c in cut], " ")
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        return [divmod(sum(map(first, a)) + sum(map(spaced, b)), _UNIT) for a, b in cut]


def _some(column: pa.Array, limit: int) -> Iterator[list[str]]:
    """The texts of a column, some at a time."""
    some, size = [], 0
    for x in column:
        some.append(x.as_py() or "")
        size += len(some[-1])
        if size >= limit:
            yield some
            some, size = [], 0
    yield some


def first_scores(v: Vocabulary) -> np.ndarray:
    """Log probabilities by id before anything is counted."""
    out = np.full(max([*v.bytes_of, 0]) + 1, -math.inf)
    for i, t in v.bytes_of.items():
        out[i] = -math.log(i + 2) if len(t) > 1 else -math.log(len(v.bytes_of) + 2)
    return out


def fit(documents: DataFrame, *, text: str = "text", path: str | None = None, chunk_chars: int = 1 << 21) -> np.ndarray:
    """Log probabilities by id, counted over all texts."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(at)
        start = first_scores(v)
        model, used = Unigram(v, start), np.zeros(len(start), np.int64)
        first, spaced = Counter(), Counter()

        def use() -> None:
            pieces = Counter()
            for lead, seen in (("", first), (" ", spaced)):
                for x, n in seen.items():
                    for p in SPLIT.findall(lead + x):
                        pieces[p] += n
                seen.clear()
            used[:] += model.best(pieces, pieces)[1]

        for batch in batches:
            for texts in _some(batch.column("text"), chunk_chars):
                for a, b in map(stretches, texts):
                    first.update(a)
                    spaced.update(b)
                if len(first) + len(spaced) > STORED:
                    use()
        use()
        own = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(used[own])], ["token", "n"])

    start = first_scores(vocabulary(at))
    counts = np.zeros(len(start))
    rows = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    for token, n in rows:
        counts[token] = n
    known = np.isfinite(start)
    return np.where(known, np.log((counts + 1) / (counts.sum() + known.sum())), -math.inf)


@lru_cache(maxsize=2)
def _model(path: str, scores: bytes) -> Unigram:
    return Unigram(vocabulary(path), np.frombuffer(scores))


def count(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, chunk_chars: int = 1 << 21, scores: np.ndarray | None = None) -> DataFrame:
    """Per row doc_id, n_tokens and n_pretokens; the model is fitted on the same documents unless scores are given."""
    at = path or default_path()
    fitted = (fit(documents, text=text, path=at, chunk_chars=chunk_chars) if scores is None else scores).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(at, fitted)
        for batch in batches:
            got = [n for texts in _some(batch.column("text"), chunk_chars) for n in model.totals(texts)]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [*names, "n_tokens", "n_pretokens"])
        model.first.clear()
        model.spaced.clear()

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
