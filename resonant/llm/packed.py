"""Sorted 64-bit keys in binary columns, and arrays in the shared folder that workers map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences in the smallest width that holds them."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    most = int(step[1:].max()) if len(step) > 1 else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + step[1:].astype(f"<u{width}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    out = np.concatenate([np.frombuffer(raw, "<u8", 1, 1), np.frombuffer(raw, f"<u{raw[0]}", -1, 9).astype(np.uint64)])
    return np.cumsum(out, dtype=np.uint64)


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned counts in the smallest width that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(f"<u{1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8}")


def small(values: np.ndarray) -> bytes:
    """The same as bytes, the width first."""
    out = narrow(values)
    return bytes([out.itemsize]) + out.tobytes()


def large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", -1, 1).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array as folder/name; a second writer of the same name does no harm."""
    at = _local(folder)
    if at:
        os.makedirs(at, exist_ok=True)
        draft = f"{at}/.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            np.save(f, array)
        os.replace(draft, f"{at}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        np.save(f, array)
    store.move(draft, f"{base}/{name}")


@lru_cache(maxsize=512)  # each holds a file open
def view(folder: str, name: str) -> np.ndarray:
    """An array of the shared folder, mapped into memory; from a remote store it is fetched once for each worker."""
    at = _local(folder)
    if at:
        return np.load(f"{at}/{name}", mmap_mode="r")
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    f = tempfile.NamedTemporaryFile(suffix=".npy")  # noqa: SIM115 - unlinked when the worker ends
    with store.open_input_stream(f"{base}/{name}") as source:
        while block := source.read(1 << 24):
            f.write(block)
    f.flush()
    out = np.load(f.name, mmap_mode="r")
    f.close()
    return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key (sorted for speed) or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)
