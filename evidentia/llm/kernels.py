"""Vectorised byte-level text kernels shared by the Python operators of this subpackage.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of all texts are looked at as
one array, so the cost per byte is a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = (9, 10, 11, 12, 13, 32)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)


_HELD: dict[object, object] = {}


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and the allocator's pages where it can be asked (glibc)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Seconds after which a worker that nothing was asked of gives back what it keeps.
IDLE = 5.0
_LOCK = threading.RLock()
_USED = [0.0]


def _when_idle() -> None:
    while True:
        time.sleep(IDLE)
        with _LOCK:
            if _HELD and time.monotonic() - _USED[0] > IDLE:
                _HELD.clear()
                give_back()


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between batches, made when it is first asked for. A worker is reused by the stages of all
    operators and keeps one thing only: the next operator's model takes the place of the last one's. It keeps it no longer than it is asked for:
    an executor has idle workers beside the busy ones."""
    with _LOCK:
        _USED[0] = time.monotonic()
        if key not in _HELD:
            if not _HELD and _USED[0] and not any(t.name == "held" for t in threading.enumerate()):
                threading.Thread(target=_when_idle, name="held", daemon=True).start()
            _HELD.clear()
            give_back()
            _HELD[key] = make()
            _USED[0] = time.monotonic()
        return _HELD[key]


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=n, dtype=np.uint64)


_BYTE_CODE = _random_words(20240521, 256)
_WINDOW_CODE = _random_words(77003, 16) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that equal inputs alone give equal outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd root and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_ROOT), -1, 2**64))
            full = np.full(n, _ROOT, dtype=np.uint64)
            full[0] = 1
            self.up = np.multiply.accumulate(full)
            full[1:] = inverse
            self.down = np.multiply.accumulate(full)
        return self.up, self.down


_POWERS = _Powers()


def text_slices(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most_bytes``; a longer text is a run of its own.

    Gives (first row, row after the last, bytes, offsets of the rows in these bytes); null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(off, off[start] + most_bytes, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield start, stop, raw[off[start] : off[stop]], off[start : stop + 1] - off[start]
        start = stop
    del column, data, raw
    pa.default_memory_pool().release_unused()  # what is freed goes back before the next batch comes


#: Bytes that words are looked for in at once.
PIECE = 1 << 20


def word_pieces(raw: np.ndarray, offsets: np.ndarray, lower: bool, spaces: np.ndarray = _IS_SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of a run of texts in text order, those of some ``PIECE`` bytes at a time: 64-bit hash, row, first byte,
    byte after the last. A word of any length has the hash of all its bytes; memory does not grow with the run.

    spaces: for each byte whether it separates words."""
    held: tuple[int, int, int] | None = None  # value, first byte and length of a word that the last piece did not end
    for start in range(0, len(raw), PIECE):
        stop = min(start + PIECE, len(raw))
        data = _LOWER[raw[start:stop]] if lower else raw[start:stop]
        size = stop - start
        inside = ~spaces[data]
        edge = np.zeros(size + 1, dtype=bool)
        near = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, side="right")]
        edge[near - start] = True  # a text's end ends its last word
        begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        up, down = _POWERS.get(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[:size], out=total[1:])
        value = (total[ends] - total[begins]) * down[begins]
        begins, ends = begins + start, ends + start
        lengths = (ends - begins).astype(np.uint64)
        if held is not None:
            if len(begins) and begins[0] == start and not edge[0]:  # the rest of the word that is held
                value[0] = np.uint64((held[0] + int(value[0]) * pow(int(_ROOT), held[2], 1 << 64)) % (1 << 64))
                begins[0] = held[1]
                lengths[0] += np.uint64(held[2])
            else:
                begins, ends, value, lengths = np.append(held[1], begins), np.append(start, ends), np.append(np.uint64(held[0]), value), np.append(np.uint64(held[2]), lengths)
            held = None
        if stop < len(raw) and len(ends) and ends[-1] == stop and not edge[-1]:
            held = (int(value[-1]), int(begins[-1]), int(lengths[-1]))
            begins, ends, value, lengths = begins[:-1], ends[:-1], value[:-1], lengths[:-1]
        value = value ^ (lengths * np.uint64(0xD6E8FEB86659FD93))
        yield mix64(value), np.searchsorted(offsets, begins, side="right") - 1, begins, ends


def word_spans(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of a run of texts in text order: 64-bit hash, row, first byte, byte after the last."""
    parts = list(word_pieces(raw, offsets, lower))
    if len(parts) == 1:
        return parts[0]
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a run of texts, in text order."""
    parts = [p[:2] for p in word_pieces(raw, offsets, lower)]
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *parts, strict=True))


def windows(word: np.ndarray, row: np.ndarray, width: int, rows: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash each window of ``width`` words that lies in one text.

    short: a text with 1 to width - 1 words gives one window of all its words.
    """
    n = len(word)
    hashed, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        keep = row[: n - width + 1] == row[width - 1 :]
        acc = word[: n - width + 1] * _WINDOW_CODE[0]
        for k in range(1, width):
            acc = mix64(acc) + word[k : n - width + 1 + k] * _WINDOW_CODE[k]
        hashed, where = mix64(acc)[keep], row[: n - width + 1][keep]
    if short and n:
        count = np.bincount(row, minlength=rows)
        few = np.flatnonzero((count > 0) & (count < width))
        if len(few):
            first = np.searchsorted(row, few)
            acc = np.full(len(few), np.uint64(0x51ED270B), dtype=np.uint64)
            for k in range(width - 1):
                has = count[few] > k
                nxt = mix64(acc) + word[np.minimum(first + k, n - 1)] * _WINDOW_CODE[8 + k]
                acc = np.where(has, nxt, acc)
            hashed, where = np.concatenate((hashed, mix64(acc))), np.concatenate((where, few))
    return hashed, where


def distinct_by_row(hashed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, ordered by row, then hash."""
    if len(row) and row[0] == row[-1] and (row == row[0]).all():  # one long text: no second key to sort by
        hashed = np.unique(hashed)
        return hashed, row[: len(hashed)]
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    if len(row):
        first = np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])))
        hashed, row = hashed[first], row[first]
    return hashed, row
