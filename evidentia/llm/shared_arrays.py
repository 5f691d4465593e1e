"""Sorted arrays in the shared folder: packed for shuffles, merged by shard, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import zstandard


#: Shards that a worker has mapped at once.
MOST_OPEN = 1024


def pack(array: np.ndarray, rising: bool = False) -> bytes:
    """A numeric array as compressed byte planes; rising whole numbers as their differences."""
    if rising:
        array = np.diff(array, prepend=array.dtype.type(0))
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, dtype, rising: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    array = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(array, dtype=dtype) if rising else array


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, *values
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], *[np.add.reduceat(v[order], starts) for v in values]


#: Bits of a key below its shard, at most, that choose a bucket and that are stored in four bytes; others go into a column of their own.
FOUND = 40


def shard_bits(size: int, shard_size: int) -> int:
    """The power of two of shards that hold at most ``shard_size`` each, sixteen of them at least."""
    return max(4, (-(-max(size, 1) // shard_size) - 1).bit_length())


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save(uri: str, name: str, array: np.ndarray) -> None:
    """Write an array under the shared folder; whole or not at all, and the same again when a task is repeated."""
    path = _local(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        array.tofile(part)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    part = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data)
    store.move(part, f"{base}/{name}")


def mapped(uri: str, name: str, dtype) -> np.ndarray:
    """A saved array, memory-mapped; from a store without local paths through a file that is unlinked once it is mapped."""
    path = _local(uri)
    if path is not None:
        at = f"{path}/{name}"
        return np.memmap(at, dtype=dtype, mode="r") if os.path.getsize(at) else np.zeros(0, dtype)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{base}/{name}") as src, tempfile.NamedTemporaryFile() as out:
        while block := src.read(1 << 24):
            out.write(block)
        out.flush()
        return np.memmap(out.name, dtype=dtype, mode="r") if out.tell() else np.zeros(0, dtype)


def _bytes(n: int) -> int:
    """Arrays of a file begin at multiples of eight bytes."""
    return -(-n // 8) * 8


def _split(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a key by which it is found, and the rest."""
    inner = keys & np.uint64((1 << below) - 1)
    rest = max(0, below - FOUND)
    return inner >> np.uint64(rest), (inner & np.uint64((1 << rest) - 1)).astype(np.uint32)


def shard_file(keys: np.ndarray, columns: list[np.ndarray], below: int) -> np.ndarray:
    """A shard as one array of bytes: sorted distinct keys by buckets, four bytes of each, and columns of one byte.

    Buckets are as many as make some 32 keys each, 256 at least. Larger values are kept apart by their place, so that
    no value is cut off.
    """
    found, rest = _split(keys, below)
    few = max(8, (len(keys) >> 5).bit_length())
    offsets = np.searchsorted(found >> np.uint64(min(below, FOUND) - few), np.arange((1 << few) + 1, dtype=np.uint64)).astype(np.uint32)
    parts, head = [offsets, found.astype(np.uint32), *([rest] if below > FOUND else [])], [few, len(keys)]
    for column in columns:
        large = np.flatnonzero(column >= 255)
        head.append(len(large))
        parts += [np.minimum(column, 255).astype(np.uint8), large.astype(np.uint32), column[large].astype(np.int64)]
    parts.insert(0, np.array(head, np.int64))
    out = np.zeros(sum(_bytes(p.nbytes) for p in parts), np.uint8)
    at = 0
    for p in parts:
        out[at : at + p.nbytes] = np.ascontiguousarray(p).view(np.uint8)
        at += _bytes(p.nbytes)
    return out


class HashedShard:
    """A shard file that is mapped into memory."""

    def __init__(self, data: np.ndarray, columns: int, below: int) -> None:
        self.at, self.data, self.below = 0, data.view(np.ndarray), below
        few, n, *large = self._take(np.int64, 2 + columns).tolist()
        self.bucket = np.uint64(min(below, FOUND) - few)
        self.offsets, self.low = self._take(np.uint32, (1 << few) + 1), self._take(np.uint32, n)
        self.rest = self._take(np.uint32, n) if below > FOUND else None
        self.columns = [(self._take(np.uint8, n), self._take(np.uint32, m), self._take(np.int64, m)) for m in large]

    def _take(self, dtype, n: int) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        out = self.data[self.at : self.at + size].view(dtype)
        self.at += _bytes(size)
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are there; all are searched for together."""
        found, rest = _split(keys, self.below)
        bucket, low, last = (found >> self.bucket).astype(np.int64), found.astype(np.uint32), len(self.low) - 1
        lo, end = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        if last < 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        hi = end
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (self.low.take(mid, mode="clip") < low) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        place = np.minimum(lo, last)
        hit = (lo < end) & (self.low[place] == low)
        if self.rest is not None:
            while len(other := np.flatnonzero(hit & (self.rest[place] < rest))):  # keys that are found in one place
                place[other] += 1
                hit[other] &= (place[other] < end[other]) & (self.low[np.minimum(place[other], last)] == low[other])
                place = np.minimum(place, last)
            hit &= self.rest[place] == rest
        return place, hit

    def values(self, column: int, place: np.ndarray) -> np.ndarray:
        small, at, large = self.columns[column]
        out = small[place].astype(np.int64)
        full = np.flatnonzero(out == 255)
        if len(full):
            out[full] = large[np.searchsorted(at, place[full])]
        return out


class HashTable:
    """Columns of whole numbers by hashed keys of ``bits`` + ``below`` bits; the highest ones name the shard.

    A key is set against those of its shard alone, so that the chance of taking one key for another is the same at
    every size of the table.
    """

    def __init__(self, uri: str, name: str, bits: int, below: int, shards: list[int], columns: int) -> None:
        self.uri, self.name, self.bits, self.below, self.shards, self.columns = uri, name, bits, below, set(shards), columns
        self._open: dict[int, HashedShard] = {}

    def _shard(self, k: int) -> HashedShard:
        if k not in self._open:
            if len(self._open) >= MOST_OPEN:
                self._open.pop(next(iter(self._open)))
            self._open[k] = HashedShard(mapped(self.uri, f"{self.name}-{k:07d}", np.uint8), self.columns, self.below)
        return self._open[k]

    def find(self, keys: np.ndarray, which: tuple[int, ...] | None = None) -> list[np.ndarray]:
        """The columns (or some of them) of sorted keys; 0 where a key is not there."""
        which = tuple(range(self.columns)) if which is None else which
        out = [np.zeros(len(keys), np.int64) for _ in which]
        shard = (keys >> np.uint64(self.below)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (k := int(shard[a])) not in self.shards:
                continue
            there = self._shard(k)
            place, hit = there.find(keys[a:b])
            for values, column in zip(out, which, strict=True):
                values[a:b] = np.where(hit, there.values(column, place), 0)
        return out
