"""Numpy arrays in the folder that the cluster shares (``spark.checkpoint.dir``).

Tasks write sorted arrays there under a name that depends on their content's
key only, through a temporary name and a move, so a task that runs again
after a lost executor puts the same file in the same place. Readers map the
file into memory; in a store that cannot be mapped (any scheme but ``file``)
they read it through pyarrow's file systems. A map doesn't keep its file open
(from Python 3.13 on), so a worker's limit on open files doesn't bound them.
"""

from __future__ import annotations

import io
import json
import mmap
import sys
import uuid
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs


def _place(uri: str):
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def save(uri: str, array: np.ndarray) -> None:
    store, path = _place(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    store.move(part, path)


def _mapped(path: str) -> np.ndarray:
    with open(path, "rb") as src:
        np.lib.format.read_magic(src)
        shape, _, dtype = np.lib.format.read_array_header_1_0(src)
        at = src.tell()
        if not np.prod(shape):
            return np.zeros(shape, dtype)
        closed = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        content = mmap.mmap(src.fileno(), 0, access=mmap.ACCESS_READ, **closed)
    return np.frombuffer(content, dtype, int(np.prod(shape)), at).reshape(shape)


@lru_cache(maxsize=4096)
def load(uri: str) -> np.ndarray:
    """The array at ``uri``, mapped read-only where the store allows it."""
    store, path = _place(uri)
    if isinstance(store, fs.LocalFileSystem):
        return _mapped(path)
    with store.open_input_file(path) as src:
        return np.load(io.BytesIO(src.read()), allow_pickle=False)


def save_together(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file for several one-dimensional arrays."""
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).view(np.uint8)
        head[name] = (a.dtype.str, len(a), at)
        parts += [raw, np.zeros(-len(raw) % 8, np.uint8)]
        at += len(raw) + len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    save(uri, np.concatenate([np.array([len(text)], np.int64).view(np.uint8), np.frombuffer(text, np.uint8), *parts]))


@lru_cache(maxsize=4096)
def load_together(uri: str) -> dict[str, np.ndarray]:
    """The arrays of ``save_together``, as views of one map."""
    raw = load.__wrapped__(uri)
    size = int(raw[:8].view(np.int64)[0])
    body = raw[8 + size:]
    return {name: body[at:at + n * np.dtype(dtype).itemsize].view(dtype)
            for name, (dtype, n, at) in json.loads(raw[8:8 + size].tobytes()).items()}


def compact(key: np.ndarray) -> dict[str, np.ndarray]:
    """A sorted array of 64-bit hashes in 32 bits each and the starts of runs with equal leading bits.

    About 16 to 32 keys share their leading bits. What is left out of a key makes a strange one found with chance
    below 1 in 2^27, however many such arrays there are.
    """
    bits = max(1, len(key).bit_length() - 5)
    lead = (key >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.uint32)
    return {"starts": starts, "low": (key >> np.uint64(32 - bits)).astype(np.uint32)}


def compact_position(starts: np.ndarray, low: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of each wanted hash in a ``compact`` array, by binary search of all at once."""
    if not len(low):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    bits = len(starts).bit_length() - 1
    lead = (wanted >> np.uint64(64 - bits)).astype(np.int64)
    sought = (wanted >> np.uint64(32 - bits)).astype(np.uint32)
    a, b = starts[lead].astype(np.int64), starts[lead + 1].astype(np.int64)
    end = b
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        mid = (a + b) >> 1
        less = (low[np.minimum(mid, len(low) - 1)] < sought) & (a < b)
        a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
    at = np.minimum(a, len(low) - 1)
    return at, (a < end) & (low[at] == sought)


def position(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of each wanted key in a sorted array without repeats."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def by_shard(shard: np.ndarray):
    """(shard, rows) for every shard that occurs."""
    small = shard.astype(np.uint16) if len(shard) and int(shard.max()) < 1 << 16 else shard  # sorted by radix
    order = np.argsort(small, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(shard[order]) != 0, True)) + 1 if len(order) else np.zeros(0, int)
    start = 0
    for end in ends:
        rows = order[start:end]
        yield int(shard[rows[0]]), rows
        start = end


def mix(a: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = a.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
