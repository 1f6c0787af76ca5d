"""Whole columns of texts as numpy arrays: words, word hashes, window hashes.

A batch of texts is one byte buffer and document offsets, as Arrow holds it. Everything here is
vectorised over all words of a batch; no function looks at one word or document at a time.
Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes, which is the same as on characters.
"""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: The six bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Keep the lowest k bytes of a little-endian word, k = 0..8.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Words above this many bytes are hashed one by one; they are rare, and the lockstep loop would be long.
_LONG_WORD = 4096
_ODD = U64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give freed memory back to the system at the end of a task, as Python workers live on."""
    _known_powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that any bits of the result are usable."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        chunks = [c for c in column.chunks if len(c)]
        if len(chunks) != 1:
            parts = [column_bytes(c) for c in chunks]
            if not parts:
                return np.zeros(0, np.uint8), np.zeros(1, np.int64)
            sizes = np.cumsum([0, *(len(d) for d, _ in parts)])
            return np.concatenate([d for d, _ in parts]), np.concatenate([np.zeros(1, np.int64), *(o[1:] + s for (_, o), s in zip(parts, sizes, strict=False))])
        column = chunks[0]
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; a longer document is a range of its own."""
    out, start = [], 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        out.append((start, stop))
        start = stop
    return out


@dataclass
class Words:
    """Words of a batch of documents, in order; document d has the words first[d]..first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def lanes(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that begins at each byte (zeros beyond the end)."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, the same for the same bytes in any batch."""
    sizes = (ends - starts).astype(np.int64)
    word = lanes(data)
    h = mix64(sizes.astype(U64) * _ODD + U64(seed))
    at, left, which = starts, sizes, None
    if len(sizes) and sizes.max() > _LONG_WORD:
        left = np.where(sizes > _LONG_WORD, 0, sizes)
    while len(at):
        got = mix64((h if which is None else h[which]) ^ (word[at] & _MASKS[np.minimum(left, 8)])) * _ODD
        if which is None:
            h = got
        else:
            h[which] = got
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed & 0xFFFFFFFF)
    return mix64(h)


def spans_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and those from b are the same, over ``sizes`` bytes, for arrays of places."""
    word = lanes(data)
    same = ((word[a] ^ word[b]) & _MASKS[np.minimum(sizes, 8)]) == 0
    more = np.flatnonzero(same & (sizes > 8) & (a != b))
    done = 8
    while len(more):
        left = sizes[more] - done
        if done >= _LONG_WORD:  # the rest of the few longest, one by one
            for i in more:
                same[i] = np.array_equal(data[a[i] : a[i] + sizes[i]], data[b[i] : b[i] + sizes[i]])
            break
        same[more] = ((word[a[more] + done] ^ word[b[more] + done]) & _MASKS[np.minimum(left, 8)]) == 0
        more, done = more[same[more] & (left > 8)], done + 8
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an example of each distinct byte span, the place of each span among them); equal hashes are compared byte by byte."""
    _, example, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends - starts
    own = example[which]
    if not ((sizes == sizes[own]).all() and spans_equal(data, starts, starts[own], sizes).all()):
        raw, places = data.tobytes(), {}
        which = np.array([places.setdefault(raw[s:e], len(places)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        example = np.unique(which, return_index=True)[1]
    return example, which


_BASE = 0xD1342543DE82EF95
#: The powers of the base and of its inverse that were needed last.
_known_powers: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, 1)
    if not _known_powers or not n <= len(_known_powers[0]) <= max(4 * n, 1 << 16):
        _known_powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(n, U64(base), U64)
            powers[0] = 1
            _known_powers.append(np.multiply.accumulate(powers))
    return _known_powers[0][:n], _known_powers[1][:n]


def prefix_sums(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Sums of the (mixed) item hashes times the powers of a fixed odd base, up to each item."""
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix64(h + U64(seed)) * _powers(len(h))[0], out=total[1:])
    return total


def window_values(total: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of the k items from each place on: a polynomial in the base, mixed."""
    return mix64((total[at + k] - total[at]) * _powers(len(total) - 1)[1][at] + U64(seed))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Places from which on there are k items in one document."""
    n = np.diff(first)
    return np.flatnonzero(np.arange(k, first[-1] + k) <= np.repeat(first[1:], n))


def window_hashes(h: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all windows of k consecutive items within one document."""
    at = window_starts(first, k)
    return at, window_values(prefix_sums(h, seed), at, k)


def joined_words(words: Words, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the documents' (kept) words joined by one space."""
    data, n = words.data, len(words.data)
    keep = np.zeros(n + 1, bool)
    keep[:-1] = ~_SPACE[data]
    starts, ends, first = words.starts, words.ends, words.first
    if kept is not None and not kept.all():
        edge = np.zeros(n + 1, np.int8)
        edge[starts[~kept]] += 1
        edge[ends[~kept]] -= 1
        keep[:-1] &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        left = np.concatenate([[0], np.cumsum(kept)])
        first, starts, ends = left[first], starts[kept], ends[kept]
    if len(ends):
        inner = np.ones(len(ends), bool)  # all but each document's last word are followed by a space
        inner[first[1:][np.diff(first) > 0] - 1] = False
        keep[ends[inner]] = True
    out = data[keep[:-1]]
    out[_SPACE[out]] = 0x20
    return out, np.concatenate([[0], np.cumsum(keep[:-1])])[words.offsets]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of the buffer's documents."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


#: The constants of the XXH64 algorithm (fixed values).
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte span, all spans in lockstep."""
    with np.errstate(over="ignore"):
        return _xxh64(lanes(data), starts.astype(np.int64), (ends - starts).astype(np.int64), U64(seed))


def _xxh64(word: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = np.full(len(at), seed + _P5, U64)
    at, left = at.copy(), size.copy()
    wide = np.flatnonzero(size >= 32)
    if len(wide):
        acc = [np.full(len(wide), v, U64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        live, pos, rest = np.arange(len(wide)), at[wide], left[wide]
        while len(live):
            for k in range(4):
                acc[k][live] = _round(acc[k][live], word[pos[live] + 8 * k])
            pos[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            total = (total ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[wide], at[wide], left[wide] = total, pos, rest
    h += size.astype(U64)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), U64), word[at[i]]), 27) * _P1 + _P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _rotl(h[i] ^ ((word[at[i]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left > 0)
        h[i] = _rotl(h[i] ^ ((word[at[i]] & U64(0xFF)) * _P5), 11) * _P1
        at[i] += 1
        left[i] -= 1
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h
