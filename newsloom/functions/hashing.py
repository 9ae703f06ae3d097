"""Texts as vectors of hashed, weighted words: an encoder that needs no model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import mix, words


def hashed_features(texts: pa.Array, dims: int = 64, spread: int = 4) -> np.ndarray:
    """One unit vector for each text: every distinct word adds 1 + ln(count), with signs, to `spread` hashed places. Texts without words are all zero."""
    w = words(texts)
    n = len(texts)
    out = np.zeros((n, dims))
    order = np.lexsort((w.hash, w.text))
    text, word = w.text[order], w.hash[order]
    if len(text):
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])]))
        weight = 1 + np.log(np.diff(np.append(first, len(text))))
        text, word = text[first], word[first]
        for i in range(spread):
            h = mix(word + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
            sign = np.where(h >> np.uint64(63), 1.0, -1.0)
            np.add.at(out, (text, (h % np.uint64(dims)).astype(np.int64)), sign * weight)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
