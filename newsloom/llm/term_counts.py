"""Frequency of every term of a collection, by heavy-light aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import buffers, distinct
from .batches import slices

_URL = re.compile(r"https?://\S+")
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LEAST_LETTERS = 3


class Terms(NamedTuple):
    """Every occurrence of a term in the order of the texts, and the index of its text."""

    term: pa.Array
    text: np.ndarray


def terms(texts: pa.Array) -> Terms:
    """Longest runs of at least three letters a-z, URLs left out, A-Z lowered. Only ASCII is lowered, so no other letter turns into one of a-z."""
    texts = texts.cast(pa.large_string())
    linked = pc.fill_null(pc.match_substring(texts, "://"), False)
    if pc.any(linked).as_py():
        bare = [_URL.sub(" ", t) for t in texts.filter(linked).to_pylist()]
        texts = pc.replace_with_mask(texts, linked, pa.array(bare, pa.large_string()))
    data, offsets = buffers(texts)
    lower = _LETTER[data]
    letter = np.concatenate([[False], lower > 0, [False]])
    fresh = letter[1:] != letter[:-1]  # places at which a run begins or ends
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    joined = np.unique(inner[letter[inner] & letter[inner + 1]])  # texts that would run into each other
    begin = np.sort(np.concatenate([np.flatnonzero(fresh & letter[1:]), joined]))
    end = np.sort(np.concatenate([np.flatnonzero(fresh & letter[:-1]), joined]))
    keep = end - begin >= _LEAST_LETTERS
    begin, end = begin[keep], end[keep]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    flat = lower[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    term = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
    return Terms(term, np.searchsorted(offsets, begin, "right") - 1)


def _counts(term: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms and how often each occurs."""
    coded = term.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))


def heavy_terms(texts: DataFrame, most: int) -> tuple[list[bytes], int]:
    """At most `most` terms with the highest counts, and the number of texts, in one pass over all texts.

    Every task keeps a frequent-items summary of 4 x `most` terms. The choice decides
    only where a term is counted; its count is exact either way.
    """
    room = 4 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count, texts_ = pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0
        for part in slices(batches, 0):
            texts_ += part.num_rows
            names, n = _counts(terms(part.column(0)).term)
            coded = pa.concat_arrays([kept, names]).dictionary_encode()
            kept, count = coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate([count, n])).astype(np.int64)
            if len(kept) > room:
                count = count - np.partition(count, -room - 1)[-room - 1]
                kept, count = kept.filter(pa.array(count > 0)), count[count > 0]
        top = np.lexsort((np.arange(len(count)), -count))[:most]
        yield pa.RecordBatch.from_pydict({"term": pa.concat_arrays([kept.take(pa.array(top)).cast(pa.binary()), pa.nulls(1, pa.binary())]), "n": pa.array([*count[top].tolist(), texts_], pa.int64())})

    found = texts.mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    # The row without a term, the number of texts, comes first.
    rows = found.orderBy(F.col("term").isNotNull(), F.desc("n"), "term").limit(most + 1).collect()
    return sorted(bytes(r.term) for r in rows if r.term is not None), sum(r.n for r in rows if r.term is None)


def split_counts(texts: pa.Array, heavy: pa.Array, arrays: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Adds occurrences and texts of the heavy terms to the rows of `arrays`; gives the light terms with theirs."""
    term, of = terms(texts)
    slot = pc.index_in(term, heavy) if len(heavy) else pa.nulls(len(term), pa.int32())
    is_heavy = slot.is_valid()
    mask = is_heavy.to_numpy(zero_copy_only=False)
    if len(heavy):
        at = slot.filter(is_heavy).to_numpy(zero_copy_only=False).astype(np.int64)
        arrays[0] += np.bincount(at, minlength=len(heavy))
        arrays[1] += np.bincount(distinct(of[mask] * len(heavy) + at) % len(heavy), minlength=len(heavy))
    coded = term.filter(pc.invert(is_heavy)).dictionary_encode()
    at, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    return coded.dictionary, np.bincount(at, minlength=n), np.bincount(distinct(of[~mask] * n + at) % max(n, 1), minlength=n)


def term_counts(df: DataFrame, text: str = "Article", least_docs: int = 10, most_share: float = 0.4, heavy: int = 1024) -> DataFrame:
    """Every term with its number of occurrences `tf`, the number of texts that hold it `df`, and `mark`.

    `mark` is 'rare' for terms in fewer than `least_docs` texts, 'common' for those in
    more than the share `most_share` of all texts, else null ('rare' goes first). Null
    texts are no texts; empty and repeated ones count. An empty table gives no rows.
    Other columns of `df` play no part.

    Method: the heavy terms (at most `heavy`, a bounded broadcast) are looked up first and
    counted in a pair of exact arrays for each task, which leave it once, at its end. The
    other terms go on by slices and are combined within the task before they are shuffled.
    """
    texts = df.select(F.col(text).cast("string").alias("text")).where("text is not null")
    top, n_texts = heavy_terms(texts, heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(top, pa.large_binary())
        arrays = np.zeros((2, len(top)), np.int64)
        for part in slices(batches, 0):
            names, tf, docs = split_counts(part.column(0), known, arrays)
            yield pa.RecordBatch.from_pydict({"term": names.cast(pa.binary()), "tf": pa.array(tf), "df": pa.array(docs)})
        held = np.flatnonzero(arrays[0])
        yield pa.RecordBatch.from_pydict({"term": known.take(pa.array(held)).cast(pa.binary()), "tf": pa.array(arrays[0][held]), "df": pa.array(arrays[1][held])})

    counted = texts.mapInArrow(run, "term binary, tf bigint, df bigint").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    rare = F.col("df") < least_docs
    common = F.col("df") * 10_000 > n_texts * round(most_share * 10_000)
    return counted.select(F.col("term").cast("string").alias("term"), "tf", "df", F.when(rare, "rare").when(common, "common").alias("mark"))
