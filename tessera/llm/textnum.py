"""Vectorised text handling over Arrow buffers.

Texts arrive as Arrow string arrays; tokens are found and hashed with numpy
over the raw UTF-8 bytes of many documents at once, without a Python object a
word. All hashes are plain functions of the bytes, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: white space between words: [\x20\x09-\x0D]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes of alphanumeric words: digits, lower-case letters, all non-ASCII
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _P if kind == "p" else _P_INV
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        if len(out) > 4 * SLICE_BYTES:
            return out
        _powers[kind] = have = out
    return have


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that ``inside`` accepts, never across rows."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    on = inside[raw]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = on[edge]
    last[edge - 1] = on[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


_PLACES = 64
#: A random number for each byte at each of the first _PLACES places of a word.
_AT = mix(np.arange(256 * _PLACES, dtype=np.uint64) + np.uint64(1))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: the sum of a scrambled number for each (place, byte).

    The numbers of different places have nothing to do with each other, so no
    regular pattern of bytes makes sums equal, as it does with powers of a base.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    base = np.repeat(start, np.diff(np.append(start, len(raw))))
    at = (np.arange(start[0], len(raw)) - base) << 8 | raw[start[0] :]
    total = np.zeros(len(at) + 1, np.uint64)
    few = at < 256 * _PLACES
    if few.all():
        np.cumsum(_AT[at], out=total[1:])
    else:
        with np.errstate(over="ignore"):
            np.cumsum(np.where(few, _AT[np.where(few, at, 0)], mix(at.astype(np.uint64) + np.uint64(1))), out=total[1:])
    with np.errstate(over="ignore"):
        return mix(total[end - start[0]] - total[start - start[0]] + mix((end - start).astype(np.uint64)))


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words of a row; rows with fewer words, but not none, give one hash of all."""
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        if len(words) >= k:
            h = np.zeros(len(words) - k + 1, np.uint64)
            for i in range(k):
                h = (h + words[i : len(words) - k + 1 + i]) * _P
                h ^= h >> np.uint64(29)
            at = np.flatnonzero(row[: len(h)] == row[k - 1 :])
            h, r = mix(h[at]), row[at]
        else:
            h, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            more = []
            for i in short:
                x = np.uint64(0)
                for w in words[first[i] : first[i + 1]]:
                    x = (x + w) * _P
                    x ^= x >> np.uint64(29)
                more.append(x ^ np.uint64(int(count[i])))
            h = np.concatenate((h, mix(np.array(more, np.uint64))))
            r = np.concatenate((r, short))
    return h, r


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row): the sorted distinct hashes of k-word shingles of each row, one row after another."""
    raw = LOWER[raw]
    start, end, row = spans(raw, off, ~IS_SPACE)
    n = len(off) - 1
    h, r = shingle_hashes(word_hashes(raw, start, end), row, n, k)
    if len(r) and np.any(r[1:] < r[:-1]):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    at = np.searchsorted(r, np.arange(n + 1))
    for a, b in zip(at, at[1:]):
        h[a:b].sort()
    if not len(h):
        return h, at
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n + 1))


def rows_of(batch: pa.RecordBatch, drop: tuple[str, ...]) -> dict[str, pa.Array]:
    return {name: batch.column(name) for name in batch.schema.names if name not in drop}
