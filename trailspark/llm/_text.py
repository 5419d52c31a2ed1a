"""Vectorised word scanning over Arrow string batches.

All word classes used here are unions of ASCII bytes and "anything above ASCII",
so a scan over UTF-8 bytes cuts exactly where a scan over code points would.
Words are represented by 64-bit hashes; a window of k words by a mixed linear
combination of its word hashes.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
BATCH_BYTES = 4 << 20
_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = _U(seed) + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = _splitmix(256, 7)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_Q = [_U(pow(0xA24BAED4963EE407, j, 1 << 64)) for j in range(64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are maximal runs of bytes outside white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are maximal runs of 0-9, a-z (after lower-casing) and non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _cache or len(_cache["p"]) < n:
        size = max(n, SEGMENT + 65536)
        if size > 4 * SEGMENT:  # a giant word: not kept
            return _powers(_P, size), _powers(_P_INV, size)
        _cache["p"], _cache["i"] = _powers(_P, size), _powers(_P_INV, size)
    return _cache["p"], _cache["i"]


@dataclass
class Words:
    """Words of a run of rows: byte spans in ``data``, the first word of each row, hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray | None

    def per_row(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, in segments so that memory does not follow the text's length."""
    out = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + SEGMENT, "right")))
        last = ends[to - 1]
        n = int(last - first)
        p, inv = _power_tables(n)
        total = np.empty(n + 1, dtype=_U)
        total[0] = 0
        np.cumsum(_BYTE[data[first:last]] * p[:n], out=total[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))
        at = to
    return out


def scan(column: pa.Array, word: np.ndarray, lower: bool = False, hashes: bool = True) -> Words:
    data, off = column_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = word[data]
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = off[(off > 0) & (off < n)]
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rows = np.searchsorted(starts, off).astype(np.int64)
    return Words(data, starts, ends, rows, word_hashes(data, starts, ends) if hashes else None)


def windows(words: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each window of k words of one row; short: a row of fewer words is one window."""
    n, h = words.per_row(), words.hashes
    counts = np.maximum(n - k + 1, 0)
    total = int(counts.sum())
    row = np.repeat(np.arange(len(n)), counts)
    first = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.rows[:-1], counts)
    got = np.zeros(total, dtype=_U)
    if total:
        for j in range(k):
            got += h[first + j] * _Q[j]
        got = mix(got + _U(k))
    if short and (few := np.flatnonzero((n > 0) & (n < k))).size:
        extra = np.zeros(len(few), dtype=_U)
        for j in range(k - 1):
            has = n[few] > j
            extra[has] += h[words.rows[few[has]] + j] * _Q[j]
        extra = mix(extra + n[few].astype(_U))
        got, row, first = np.concatenate([got, extra]), np.concatenate([row, few]), np.concatenate([first, words.rows[few]])
    return got, row, first


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = column_bytes(b.column(text))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            to = min(to, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, small batches gathered up to about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches, text, most):
        held.append(b)
        size += b.column(text).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def pack(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def unpack(x: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype=kind)


def squeeze(x: np.ndarray, step: bool = True) -> bytes:
    """Numbers as compressed planes of bytes; step: of the steps between ascending numbers."""
    import zstandard

    x = np.ascontiguousarray(x, dtype="<u8")
    planes = (np.diff(x, prepend=_U(0)) if step else x).view("u1").reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(planes.tobytes())


def unsqueeze(data: bytes, step: bool = True) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(x, dtype=_U) if step else x


def deflate(x: np.ndarray) -> bytes:
    """Numbers below 256, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(x.astype("u1").tobytes())


def inflate(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")


def spread(doc: np.ndarray, n: int) -> np.ndarray:
    """A bucket below n for each document id."""
    return (mix(doc.astype(np.int64).view(_U) + _U(0x51)) % _U(n)).astype(np.int64)


def groups(x: np.ndarray) -> list[tuple[int, int]]:
    """Spans of equal neighbours."""
    if not len(x):
        return []
    cut = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True))
