"""Operator 5: byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token exactly one vocabulary token can end its correct encoding. An
automaton reads the pre-token byte by byte and knows the longest suffix of what it has read that is
a token; suffix links lead to the shorter ones. The first of them, from the longest on, that the
last token of the remaining prefix tolerates as its neighbour is the prefix's unique last token.
Following the last tokens back from the end gives the ids that merging in rank order would give, in
time linear in the pre-token's length; distinct pre-tokens are taken in sorted order, and what they share
at their beginnings is done once. Two tokens tolerate each other if encoding their bytes
together gives just these two; that is found by undoing their merges from the latest on.

Defined results. Null text is an empty text: no ids, and the digests are those of empty strings.
The strings of special tokens become their ids, as the tokenizers library does by default. Repeated
rows each get their row; extra columns are ignored, except that `pack_documents` keeps them and replaces
those named ids, n_tokens or decoded_sha256. Empty tables give empty results. Texts of any length are
encoded whole: one text's distinct pre-tokens must fit in a worker's memory. `decode` raises on an id that
is not in the vocabulary and treats a null list as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .vocabulary import SPLIT, Store, Vocabulary, common, default_path, stretches
from .words import chunks, tidied

#: Entries of each of a worker's stores, which are emptied after every task.
CACHE = 200_000
#: Characters of text whose distinct pre-tokens are encoded together, and ids that are decoded at once.
BATCH, IDS = 1 << 19, 1 << 17
_LAST = 1 << 60


class Coder(Vocabulary):
    """A vocabulary with its merges; everything derived is filled in as texts need it."""

    def __init__(self, path: str):
        super().__init__(path)
        self.rank: dict[int, int] = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(self.spec.pop("model")["merges"]):
            a, b = (self.id_of[self.raw(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merge[a, b] = r
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), r
        self.all_bytes = self.bytes_of | {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.pieces, self.first, self.spaced = Store(CACHE), Store(CACHE), Store(CACHE)
        most = max(self.all_bytes) + 1
        self.token_length = np.array([len(self.all_bytes.get(i, b"")) for i in range(most)], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(self.all_bytes.get(i, b"") for i in range(most)), np.uint8)
        self.is_token = np.array([i in self.all_bytes for i in range(most)])

    def _tolerates(self, left: int, right: int) -> bool:
        """Whether both stay as they are when one follows the other."""
        p, q, p_until, q_until = left, right, _LAST, _LAST
        while True:
            r = self.merge.get((p, q))
            if r is not None and r < p_until and r <= q_until:
                return False
            if self.rank[p] > self.rank[q]:
                p_until, p = self.rank[p], self.parts[p][1]
            elif self.rank[q] >= 0:
                q_until, q = self.rank[q], self.parts[q][0]
            else:
                return True

    def encode_pieces(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(piece, ids) of distinct pre-tokens, in sorted order, so that what two in a row begin with is done once."""
        states, last, before = [0], [], b""
        step, length, fits = self.step, self.length, self.fits
        for piece in sorted(pieces):
            shared = common(piece, before)
            del states[shared + 1 :], last[shared:]
            state = states[-1]
            for i in range(shared + 1, len(piece) + 1):
                key = state << 8 | piece[i - 1]
                to = step.get(key)
                state = self.advance(state, piece[i - 1]) if to is None else to
                states.append(state)
                t = self.longest[state]
                while (n := length[t]) < i:
                    left = last[i - n - 1]
                    ok = fits.get(left << 32 | t)
                    if ok is None:
                        if len(fits) > CACHE:
                            fits.clear()
                        ok = fits[left << 32 | t] = self._tolerates(left, t)
                    if ok:
                        break
                    t = self.shorter(t)
                last.append(t)
            before, out, i = piece, [], len(piece)
            while i:
                out.append(last[i - 1])
                i -= length[last[i - 1]]
            yield piece, out[::-1]

    def _learn(self, store: Store, wanted: list[list[str]], lead: str) -> None:
        """Fill a store with the decimal ids, joined by commas, of distinct stretches."""
        new = store.lacking(wanted)
        cut = {x: SPLIT.findall(lead + x) for x in new}
        for piece, ids in self.encode_pieces(p.encode() for p in self.pieces.lacking(cut.values())):
            self.pieces[piece.decode()] = ",".join(map(str, ids))
        found = self.pieces.__getitem__
        store.update((x, ",".join(map(found, own))) for x, own in cut.items())

    def written(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        cut = []
        for text in texts:
            parts, at = [], 0
            for m in self.split_special.finditer(text) if self.split_special else ():
                parts += [stretches(text[at : m.start()]), str(self.special[m[0]])]
                at = m.end()
            cut.append([*parts, stretches(text[at:])])
        plain = [p for parts in cut for p in parts if not isinstance(p, str)]
        self._learn(self.first, [p[0] for p in plain], "")
        self._learn(self.spaced, [p[1] for p in plain], " ")
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        out = []
        for parts in cut:
            ids = []
            for p in parts:
                if isinstance(p, str):
                    ids.append(p)
                else:
                    ids += map(first, p[0])
                    ids += map(spaced, p[1])
            out.append(",".join(ids))
        return out

    def batches(self, texts: Iterable[str | None]) -> Iterator[str]:
        """`written` for any number of texts, some at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= BATCH:
                yield from self.written(some)
                some, size = [], 0
        yield from self.written(some)

    def forget(self) -> None:
        """Empty the stores that grow with the texts."""
        for store in (self.pieces, self.first, self.spaced, self.fits):
            store.clear()

    def encode(self, text: str) -> list[int]:
        return parsed(self.written([text])[0]).tolist()

    def undone(self, ids: np.ndarray) -> bytes:
        """The bytes of a text, from its ids alone."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.is_token) or not self.is_token[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for a in range(0, len(ids), IDS):
            own = ids[a : a + IDS]
            size = self.token_length[own]
            at = np.repeat(self.token_start[own] - np.cumsum(size) + size, size)
            out.append(self.token_bytes[at + np.arange(len(at))].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        return self.undone(np.array(ids, np.int64)).decode("utf-8", "replace")


def parsed(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _rest(batch: pa.RecordBatch, column: str) -> tuple[list, list[str]]:
    names = [c for c in batch.schema.names if c != column]
    return [batch.column(c) for c in names], names


def _digest(c: Coder, ids: np.ndarray) -> str:
    """Of the decoded text in UTF-8."""
    return hashlib.sha256(c.undone(ids).decode("utf-8", "replace").encode()).hexdigest()


def encode(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(at)
        for batch in batches:
            rest, names = _rest(batch, "text")
            yield pa.RecordBatch.from_arrays([*rest, pa.array(map(parsed, c.batches(batch.column("text").to_pylist())), pa.list_(pa.int32()))], [*names, "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of id lists."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(at)
        for batch in batches:
            rest, names = _rest(batch, "ids")
            yield pa.RecordBatch.from_arrays([*rest, pa.array((c.decode(x.as_py() or ()) for x in batch.column("ids")), pa.string())], [*names, "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(tidied(run), f"doc_id {kind}, text string")


def report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(at)
        for batch in batches:
            rest, names = _rest(batch, "text")
            n, ids, back = [], [], []
            for joined in c.batches(x.as_py() for x in batch.column("text")):
                own = parsed(joined)
                n.append(len(own))
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(_digest(c, own))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def pack_documents(documents: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """The rows without their text, but with ids array<int>, n_tokens and decoded_sha256, which replace columns of these names."""
    at = path or default_path()
    kept = [c for c in documents.columns if c not in (text, "ids", "n_tokens", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(at)
        for whole in batches:
            for a, b, _, _ in chunks(whole.column("_text")):
                batch = whole.slice(a, b - a)
                first, ids, back = [0], [], []
                for joined in c.written([x.as_py() or "" for x in batch.column("_text")]):
                    ids.append(parsed(joined))
                    first.append(first[-1] + len(ids[-1]))
                    back.append(_digest(c, ids[-1]))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), lists, pa.array(np.diff(first), pa.int64()), pa.array(back, pa.string())], ["_row", "ids", "n_tokens", "decoded_sha256"])
        c.forget()

    source = documents.select(F.struct(*kept).alias("_row"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_row"].dataType.simpleString()
    return source.mapInArrow(tidied(run), f"_row {kind}, ids array<int>, n_tokens long, decoded_sha256 string").select("_row.*", "ids", "n_tokens", "decoded_sha256")
