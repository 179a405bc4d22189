"""Vectorised byte-level tokenisation of Arrow string columns.

All functions work on a whole Arrow batch at once: the texts of a batch are one
contiguous UTF-8 buffer plus offsets, so words are found and hashed by numpy
passes over bytes and no Python loop touches a character or a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value for each byte; the seed is fixed, so hashes are stable.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of runs without ASCII white space.
SPACE_WORDS = ~ASCII_SPACE
#: Words of digits, letters a-z (after folding) and everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
_FOLDED_VALUES = BYTE_VALUES[FOLD]


def powers(n: int) -> np.ndarray:
    """The first n powers of the odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        base = np.full(size, _STEP, np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    left, here = inside[:-2], inside[1:-1]
    start = here & ~left
    end = here & ~inside[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = here[cuts]
    end[cuts - 1] = here[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _FOLDED_VALUES) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint and non-empty byte spans, with A-Z folded."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    at = np.arange(total, dtype=np.int64)
    inner = at - np.repeat(first, lens)
    x = values[data[at + np.repeat(starts - first, lens)]]
    x *= powers(int(lens.max()))[inner]
    return mix(np.add.reduceat(x, first) + lens.astype(np.uint64))


def pieces(offs: np.ndarray, limit: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about limit bytes each, so that work arrays stay small; one text is never split."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hash of each word of each text, in order; first[i]:first[i+1] are those of text i."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for i, j in pieces(offs):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, f = spans(part, o, is_word)
        hashes.append(hash_spans(part, s, e))
        counts.append(np.diff(f))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))


def lookup_filter(sorted_hashes: np.ndarray) -> np.ndarray:
    """Which of the upper 20 bits occur."""
    seen = np.zeros(1 << 20, bool)
    seen[(sorted_hashes >> U64(44)).astype(np.int64)] = True
    return seen


def lookup(sorted_hashes: np.ndarray, h: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """The place of each hash in sorted_hashes, or -1. seen: their lookup_filter, if it is at hand."""
    out = np.full(len(h), -1, np.int32)
    if len(sorted_hashes) and len(h):
        seen = lookup_filter(sorted_hashes) if seen is None else seen
        some = np.flatnonzero(seen[(h >> U64(44)).astype(np.int64)])
        x = h[some]
        at = np.searchsorted(sorted_hashes, x)
        at[at == len(sorted_hashes)] = 0
        ok = sorted_hashes[at] == x
        out[some[ok]] = at[ok]
    return out
