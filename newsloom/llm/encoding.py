"""Token ids of a whole corpus by a byte-level BPE vocabulary, by merge replay over distinct words."""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Fixed value: how the vocabulary cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = regex.compile(PATTERN)
#: Runs of white space that a cut at single spaces would take apart.
_WIDE = re.compile(r"\s\s\s|\s\s\Z")
#: Units a task keeps between slices.
_KEPT = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a `.tiktoken` file with their ids, which are also their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes a set of words at once: one inverted index from token pair to places in any of the words, replayed in rank order."""

    def __init__(self, byte: list[int], pairs: np.ndarray) -> None:
        """byte: the token of each byte. pairs: rows (rank, left token, right token), in rank order."""
        self.byte = byte
        self.pair: dict[int, tuple[int, int]] = {r: (a, b) for r, a, b in pairs.tolist()}
        self.merged: dict[tuple[int, int], int] = {p: r for r, p in self.pair.items()}

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> MergeReplay:
        """The merges behind a vocabulary: a token's pair is what the merges of lower rank leave of its bytes."""
        self = cls([ranks[bytes([b])] for b in range(256)], np.zeros((0, 3), np.int64))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.encode([token])[0]
                if len(parts) != 2:
                    raise ValueError(f"token {rank} is not made by one merge of earlier tokens")
                self.pair[rank] = parts[0], parts[1]
                self.merged[self.pair[rank]] = rank
        return self

    def tables(self) -> tuple[list[int], np.ndarray]:
        return self.byte, np.array([(r, *p) for r, p in self.pair.items()], np.int32).reshape(-1, 3)

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        byte, merged = self.byte, self.merged
        token: list[int] = []
        starts = [0]
        for word in words:
            token += [byte[b] for b in word]
            token.append(-1)  # no pair holds -1, so no merge crosses words
            starts.append(len(token))
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index: dict[int, list[int]] = defaultdict(list)
        for i, pair in enumerate(pairwise(token)):
            if (rank := merged.get(pair)) is not None:
                index[rank].append(i)
        order = list(index)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            places = index.pop(rank)
            left, right = self.pair[rank]
            if left == right:
                places.sort()  # of overlapping pairs the leftmost goes first
            for i in places:
                if token[i] != left or token[j := after[i]] != right:
                    continue  # a neighbour was merged away
                token[i], token[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                if (new := merged.get((rank, token[k]))) is not None:
                    if new not in index:
                        heapq.heappush(order, new)
                    index[new].append(i)
                h = before[i]
                if h >= 0 and (new := merged.get((token[h], rank))) is not None:
                    if new not in index:
                        heapq.heappush(order, new)
                    index[new].append(h)
        return [[t for t in token[a : b - 1] if t >= 0] for a, b in pairwise(starts)]


class Encoder:
    """Encodes texts; units met before are looked up.

    A unit is what stands between single spaces, with the space before it. No word of
    the pattern goes across a single space from the left, so units are encoded one by one.
    """

    def __init__(self, replay: MergeReplay) -> None:
        self.replay = replay
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}  # units without a space before them
        self.rest: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}
        self.sizes: list[int] = []
        self.ids: list[int] = []

    def _learn(self, first: set[str], rest: set[str]) -> None:
        cut = [(self.first, u, _WORD.findall(u)) for u in first] + [(self.rest, u, _WORD.findall(" " + u)) for u in rest]
        fresh = list({w for _, _, found in cut for w in found if w not in self.words})
        self.words.update(zip(fresh, self.replay.encode(w.encode() for w in fresh), strict=True))
        for table, unit, found in cut:
            ids = [t for w in found for t in self.words[w]]
            table[unit] = len(self.sizes)
            self.sizes.append(len(ids))
            self.ids += ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the len+1 offsets of the texts."""
        if len(self.sizes) > _KEPT:
            self.clear()
        units = [[t] if _WIDE.search(t) else t.split(" ") for t in texts]
        heads = [u.pop(0) for u in units]
        tails = list(chain.from_iterable(units))
        fresh = set(heads).difference(self.first), set(tails).difference(self.rest)
        if fresh[0] or fresh[1]:
            self._learn(*fresh)
        amount = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.arange(len(units)) + np.cumsum(amount) - amount
        unit = np.empty(len(heads) + len(tails), np.int64)
        unit[starts] = np.fromiter(map(self.first.__getitem__, heads), np.int64, len(heads))
        others = np.ones(len(unit), bool)
        others[starts] = False
        unit[others] = np.fromiter(map(self.rest.__getitem__, tails), np.int64, len(tails))
        size = np.array(self.sizes, np.int64)
        begin = np.cumsum(size) - size
        n = size[unit]
        upto = np.cumsum(n)
        ids = np.array(self.ids, np.int32)
        out = ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[unit] - (upto - n), n)]
        last = starts + amount
        return out, np.concatenate([[0], upto[last]]) if len(units) else np.zeros(1, np.int64)


_encoders: dict[int, Encoder] = {}


def _encoder(byte: list[int], pairs: np.ndarray) -> Encoder:
    """The encoder of these merges; a worker process keeps it, with the words it has met, for its later tasks."""
    key = hash((tuple(byte), pairs.tobytes()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(MergeReplay(byte, pairs))
    return _encoders[key]


def encode_texts(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and `ids` (array of int) of every row: its text by the vocabulary file at the path `vocabulary`, without special tokens.

    The text is taken as it is; strings that name special tokens are ordinary text. Null
    and empty texts give the empty list; every row comes out, repeated ones too. Other
    columns of `df` play no part. `vocabulary` is a `.tiktoken` file, read by the driver;
    its merges, bounded by the vocabulary, go to the tasks. One pass, no shuffle.

    Method: the distinct words of a slice of the corpus that its task has not met yet are
    laid one after the other; an inverted index from token pair to places applies every
    merge in rank order and re-indexes only the two neighbours of each merge.
    """
    schema = f"doc_id {dict(df.dtypes)[doc_id]}, ids array<int>"

    byte, pairs = MergeReplay.of(load_ranks(vocabulary)).tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(byte, pairs)
        for part in slices(batches, 1):
            ids, offsets = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
