"""Held-out texts inside a corpus, found by spaced seeds and verified around each hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import Words, mix, words
from .batches import slices

#: Fixed masks over 12 words: 1 counts, 0 is ignored. Each differs in the places where a substituted word does no harm.
MASKS = ("111011010111", "110110111011")


def seeds(w: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of the mask's length within one text; ignored places play no part in the hash."""
    n = len(w.hash) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.zeros(n, np.uint64)
    for i, one in enumerate(mask):
        if one == "1":
            x = x * np.uint64(0xD6E8FEB86659FD93) + w.hash[i : i + n]
    first = np.flatnonzero(w.text[:n] == w.text[len(mask) - 1 :])
    return mix(x[first]), first


class SeedIndex:
    """The seeds of one mask of the held-out texts."""

    BITS = 22

    def __init__(self, items: Words, mask: str) -> None:
        h, first = seeds(items, mask)
        order = np.argsort(h, kind="stable")
        self.mask, self.hash, self.first = mask, h[order], first[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words, in the documents and in the items, of all windows with equal seeds."""
        h, at = seeds(docs, self.mask)
        keep = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        h, at = h[keep], at[keep]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(h)), n)
        return at[which], self.first[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def overlaps(docs: Words, items: Words, i: np.ndarray, j: np.ndarray, span: int) -> np.ndarray:
    """Rows (document, item, first word in each, words, equal words, longest run of equal words) of the stretches around the hits.

    Hits on one diagonal within `span` words of each other are one stretch; it is carried
    on at both ends while words are equal. Words within it may differ.
    """
    if not len(i):
        return np.zeros((0, 7), np.int64)
    doc, item = docs.text[i], items.text[j]
    order = np.lexsort((i, i - j, item, doc))
    doc, item, i, j = doc[order], item[order], i[order], j[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((i - j)[1:] != (i - j)[:-1]) | (i[1:] > i[:-1] + 2 * span)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(i)) - 1
    out = np.empty((len(begin), 7), np.int64)
    for r, (a, z) in enumerate(zip(begin.tolist(), last.tolist(), strict=True)):
        p, q, end, shift = int(i[a]), int(j[a]), int(i[z]) + span, int(i[a] - j[a])
        d, t = docs.text[p], items.text[q]
        while p > 0 and q > 0 and docs.text[p - 1] == d and items.text[q - 1] == t and docs.hash[p - 1] == items.hash[q - 1]:
            p, q = p - 1, q - 1
        while end < len(docs.hash) and end - shift < len(items.hash) and docs.text[end] == d and items.text[end - shift] == t and docs.hash[end] == items.hash[end - shift]:
            end += 1
        same = docs.hash[p:end] == items.hash[q : q + end - p]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        out[r] = d, t, p - np.searchsorted(docs.text, d), q - np.searchsorted(items.text, t), end - p, same.sum(), (edges[1::2] - edges[::2]).max()
    return out


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    least_same: float = 0.8,
    block_chars: int = 64_000_000,
) -> DataFrame:
    """Stretches that a document shares with a held-out item, up to substituted words.

    Columns: the two ids, `doc_word` and `item_word` (where the stretch begins, from 0),
    `n_words`, `n_same` (words equal at their places), `longest_run` (most consecutive
    equal words). A stretch is reported if at least `least_same` of its words are equal,
    or if it holds a run of a mask's length. Every run of as many equal words as a mask is long lies in a reported stretch.

    Null and empty texts, and texts with fewer words than the mask, have no rows. Copies
    and repeated ids come out as often as they come in. Other columns play no part.

    The items' seeds go to every task as sorted arrays of a bounded size: items beyond
    `block_chars` characters in all are taken in as many blocks, each block against all
    documents. Documents are read once for each block and never shuffled.
    """
    held = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    chars = held.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_word int, item_word int, n_words int, n_same int, longest_run int"
    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same", "longest_run"]
    corpus = docs.select(F.col(doc_id), F.col(text).cast("string")).where(F.length(F.col(text).cast("string")) > 0)

    def against(block: pa.Table) -> DataFrame:
        ids, texts = block.column(0).combine_chunks(), block.column(1).combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = words(texts)
            indexes = [SeedIndex(known, m) for m in masks]
            for part in slices(batches, 1):
                w = words(part.column(1))
                found = []
                for span, index in ((len(m), x) for m, x in zip(masks, indexes, strict=True)):
                    rows = overlaps(w, known, *index.hits(w), span)
                    found.append(rows[(rows[:, 5] >= least_same * rows[:, 4]) | (rows[:, 6] >= span)])
                rows = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[:, 0])), ids.take(pa.array(rows[:, 1])), *(pa.array(rows[:, c], pa.int32()) for c in range(2, 7))], names=names)

        return corpus.mapInArrow(run, schema)

    out = None
    for b in range(blocks):
        mine = held if blocks == 1 else held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        one = against(mine.toArrow())
        out = one if out is None else out.unionByName(one)
    return out.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def leaked(found: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", run: int = 12) -> DataFrame:
    """Document and item of every stretch that holds at least `run` consecutive equal words, each pair once."""
    return found.where(F.col("longest_run") >= run).select(doc_id, item_id).distinct()
