"""Words and word shingles of Arrow string arrays as 64-bit hashes, without a Python loop over words.

A word is a longest run of a-z and 0-9 after lowering A-Z; every other byte separates, so
multi-byte characters never join a word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer texts are cut at a separator, so that memory does not follow text length.
PIECE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GOLD = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _code_table() -> np.ndarray:
    codes = np.zeros(256, np.uint64)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        codes[c] = _GOLD[c]
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        codes[c] = _GOLD[c + 32]
    return codes


_CODES = _code_table()
_IS_WORD = _CODES != 0


class Words(NamedTuple):
    """Parallel arrays, in order of text and place: hash, index of the text, first and past-the-last byte in the text buffer."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting integers is several times as fast as hashing them, which np.unique does."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE) + 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the len+1 byte offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    """All words of all texts."""
    data, offsets = buffers(texts)
    return words_of(data, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of the texts that lie one after the other in `data`."""
    parts: list[tuple[np.ndarray, ...]] = []
    at, size = 0, len(data)
    inner = offsets[1:-1]
    while at < size:
        to, step = min(size, at + PIECE), PIECE
        while to < size:  # back to a separator or the start of a text
            free = np.flatnonzero(~_IS_WORD[data[at:to]])
            k = np.searchsorted(inner, to, "right") - 1
            cut = max(at + free[-1] + 1 if len(free) else at, inner[k] if k >= 0 else 0)
            if cut > at:
                to = int(cut)
                break
            step *= 2
            to = min(size, at + step)
        piece = data[at:to]
        is_word = _IS_WORD[piece]
        fresh = np.ones(len(piece) + 1, bool)  # no word goes on across these places
        fresh[1:-1] = ~is_word[:-1] | ~is_word[1:]
        lo, hi = np.searchsorted(inner, [at, to])
        fresh[inner[lo:hi] - at] = True
        s = np.flatnonzero(is_word & fresh[:-1])
        e = np.flatnonzero(is_word & fresh[1:]) + 1
        power, inverse = _power_tables(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CODES[piece] * power[: len(piece)], out=sums[1:])
        parts.append((mix((sums[e] - sums[s]) * inverse[s]), s + at, e + at))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    h, s, e = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    return Words(h, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(s, offsets))), s, e)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, index of the text and index of the first word of every run of k words within one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = x * np.uint64(0xD6E8FEB86659FD93) + w.hash[i : i + n]
    first = np.flatnonzero(w.text[:n] == w.text[k - 1 :])
    return mix(x[first]), w.text[first], first
