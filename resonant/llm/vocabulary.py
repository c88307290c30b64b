"""A byte-level vocabulary: its file, its suffix automaton, and the cutting of texts into pre-tokens.

Whether a pre-token begins at a space that a non-space follows does not depend on what is before it:
no pre-token holds such a space further in. So texts are cut at single spaces first, by the text's own
`split`, and the pattern runs only once for every distinct stretch between two of them. Where a text
has other white space after a space, the pattern runs over the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import regex

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
_LOOSE = regex.compile(r" (?=\s|\Z)")


def default_path() -> str:
    """The public byte-level vocabulary that the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def stretches(text: str) -> tuple[list[str], list[str]]:
    """(begin as they are, begin at a space that is left out), in the text's order; together they have its pre-tokens."""
    if _LOOSE.search(text):
        return SPLIT.findall(text), []
    parts = text.split(" ")
    return parts[:1] if parts[0] else [], parts[1:]


class Vocabulary:
    """Tokens and the automaton that knows, for what it has read, the longest suffix that is a token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self._byte = byte_of_char()
        #: strings of special tokens and their ids
        self.special: dict[str, int] = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: self.raw(t) for t, i in self.spec["model"]["vocab"].items() if t not in self.special}
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        self._beginnings = {t[:k] for t in self.id_of for k in range(len(t) + 1)}
        self._states: list[bytes] = [b""]
        self._state_of: dict[bytes, int] = {b"": 0}
        self.step: dict[int, int] = {}
        #: by state, the longest suffix that is a token
        self.longest: list[int | None] = [None]
        self._shorter: dict[int, int | None] = {}

    def raw(self, token: str) -> bytes:
        return bytes(self._byte[c] for c in token)

    def _suffix_token(self, s: bytes) -> int | None:
        return next((t for k in range(len(s)) if (t := self.id_of.get(s[k:])) is not None), None)

    def advance(self, state: int, byte: int) -> int:
        """The state after one more byte; `step` holds those already known, under state << 8 | byte."""
        s = self._states[state] + bytes([byte])
        while s not in self._beginnings:
            s = s[1:]
        to = self._state_of.get(s)
        if to is None:
            if (token := self._suffix_token(s)) is None:
                raise ValueError(f"the vocabulary has no token for byte {s[-1:]!r}")
            to = self._state_of[s] = len(self._states)
            self._states.append(s)
            self.longest.append(token)
        self.step[state << 8 | byte] = to
        return to

    def shorter(self, token: int) -> int | None:
        """The longest proper suffix of a token that is a token."""
        if token not in self._shorter:
            self._shorter[token] = self._suffix_token(self.bytes_of[token][1:])
        return self._shorter[token]


def common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class Store(dict):
    """What was found for distinct strings, at most `most` of them; the caller makes up for what is lost."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def lacking(self, wanted: Iterable[Iterable[str]]) -> set[str]:
        """The wanted strings that are not there yet; if there is no room, only wanted ones stay."""
        every = set().union(*wanted)
        new = every - self.keys()
        if self and len(self) + len(new) > self.most:
            kept = {x: self[x] for x in every - new}
            self.clear()
            self.update(kept)
        return new
