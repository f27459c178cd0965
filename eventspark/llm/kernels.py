"""Vectorised text kernels: word spans and polynomial hashes over Arrow buffers.

All work on UTF-8 bytes. Lower-casing covers A-Z only, as byte table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; bounds the 8-byte-per-byte temporaries.
CHUNK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def fold_case() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: A random code for each byte, and the same with A-Z folded to a-z.
BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
FOLDED_CODES = BYTE_CODES[fold_case()]

#: Bytes of words: everything but white space; and digits, letters, non-ASCII.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i in 0..n (grown on demand, kept)."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 1024)
        made = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """s with hash of data[i:j] = (s[j] - s[i]) * BASE**-i."""
    s = np.empty(len(data) + 1, dtype=U64)
    s[0] = 0
    np.cumsum(codes[data] * powers(len(data))[0][: len(data)], out=s[1:])
    return s


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are sorted and do not overlap."""
    out = np.empty(len(start), dtype=U64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + CHUNK, side="right")))
        b = int(end[j - 1])
        s = prefix_sums(data[a:b], codes)
        inverse = powers(b - a)[1]
        lo, hi = start[i:j] - a, end[i:j] - a
        out[i:j] = (s[hi] - s[lo]) * inverse[lo]
        i = j
    return mix64(out + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges i, j of texts with at most ``most`` bytes together (or one text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Start, end and text number of every word (a maximal run of bytes of
    ``inside`` within one text)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    is_in = inside[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(is_in[:-1], out=first[1:])
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = True
    start = np.flatnonzero(first & is_in)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(is_in[1:], out=last[:-1])
    last[cuts - 1] = True
    end = np.flatnonzero(last & is_in) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts together, and where each starts (n+1);
    bytes that are no UTF-8 become U+FFFD."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return points, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
