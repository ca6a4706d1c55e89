"""Words and word hashes of Arrow text batches, by whole-array NumPy operations on the UTF-8 bytes.

A word is a run of bytes other than space and TAB..CR, i.e. the pattern [^\\x20\\x09-\\x0D]+; multi-byte
characters never hold those bytes. A hash takes a word 8 bytes at a time, with a mixing of all 64 bits between (words above
64 bytes: blake2b), so two different words share one with probability 2^-64 whatever their structure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Words of up to so many 8-byte lanes are hashed lane by lane, all at once; longer ones one by one.
_LANES = 8
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def lane(raw: np.ndarray, starts: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k .. 8k + 7 of each span of raw as one integer, zeros beyond its end. raw has 8 bytes more than the last span."""
    view = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    spare = np.clip(8 * (k + 1) - size, 0, 7).astype(U64) * U64(8)
    return view[starts + 8 * k] << spare >> spare


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of one size are the same bytes in a and in b (each with 8 bytes more)."""
    same = np.ones(len(size), bool)
    for k in range(min(_LANES, (int(size.max(initial=0)) + 7) >> 3)):
        more = np.flatnonzero(size > 8 * k)
        same[more] &= lane(a, a_start[more], size[more], k) == lane(b, b_start[more], size[more], k)
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        same[i] &= bytes(a[a_start[i]:a_start[i] + size[i]]) == bytes(b[b_start[i]:b_start[i] + size[i]])
    return same


class Chunk:
    """Some consecutive documents of a batch: bytes, word bounds, and each document's first word."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, first: int):
        self.first, self.raw, self.bounds = first, raw, bounds
        self._raw: dict[bool, np.ndarray] = {}
        self._hashes: dict[bool, np.ndarray] = {}
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = SPACES[raw]
        edge = space[1:] != space[:-1]
        inner = np.unique(bounds[1:-1])
        cut_at = inner[(inner > 0) & (inner < len(raw))]
        if len(cut_at):  # a word ends where its document ends
            both = cut_at[~space[cut_at] & ~space[cut_at + 1]]
            at = np.flatnonzero(edge)
            at = np.sort(np.concatenate([at, both, both])) if len(both) else at
        else:
            at = np.flatnonzero(edge)
        self.starts, self.ends = at[0::2], at[1::2]
        self.word_bounds = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def bytes(self, lower: bool) -> np.ndarray:
        """The bytes, lower-cased if asked for, and 8 more."""
        if self._raw.get(lower) is None:
            raw = np.zeros(len(self.raw) + 8, np.uint8)
            raw[:-8] = LOWER[self.raw] if lower else self.raw
            self._raw[lower] = raw
        return self._raw[lower]

    def hashes(self, lower: bool = False, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, or of the byte spans starts to ends (none is empty)."""
        if starts is None or ends is None:
            if lower not in self._hashes:
                self._hashes[lower] = self.hashes(lower, self.starts, self.ends)
            return self._hashes[lower]
        raw, size = self.bytes(lower), ends - starts
        lanes = (size + 7) >> 3
        h = size.astype(U64) * U64(_STEP) + U64(_SEED)
        if len(h):
            h = mix(h ^ lane(raw, starts, size, 0))
        for k in range(1, min(_LANES, int(lanes.max(initial=0)))):
            more = np.flatnonzero(lanes > k)
            h[more] = mix(h[more] ^ lane(raw, starts[more], size[more], k))
        for i in np.flatnonzero(lanes > _LANES).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
        return h

    def distinct(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(place of one word of each kind, kind of every word). Words of one hash are compared byte by byte, so that a kind is one word."""
        raw, size = self.bytes(lower), self.ends - self.starts
        _, first, kind = np.unique(self.hashes(lower), return_index=True, return_inverse=True)
        one = first[kind]
        more = np.flatnonzero(one != np.arange(len(one)))
        alike = size[more] == size[one[more]]
        if alike.all() and equal_spans(raw, self.starts[more], raw, self.starts[one[more]], size[more]).all():
            return first, kind
        text = lambda i: raw[self.starts[i]:self.ends[i]].tobytes()
        known: dict[bytes, int] = {}
        kind = np.array([known.setdefault(text(i), len(known)) for i in range(len(size))], np.int64)
        return np.unique(kind, return_index=True)[1], kind


def chunks(text: pa.Array, size: int = 1 << 19) -> Iterator[Chunk]:
    """The batch in pieces of whole documents of about size bytes."""
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset:]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i)
        i = j


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; len(h) - n + 1 values. Spans of 1, 2, 4 .. words are joined pair by pair."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out, done, span, width = None, 0, h, 1
    while True:
        if n & width:
            part = span[done:done + m]
            out = part if out is None else _pair(out, part)
            done += width
        if width * 2 > n:
            return out if n == 1 else mix(out + U64(n))
        span = _pair(span[:-width], span[width:])
        width *= 2


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + U64(_SEED)) ^ b)
