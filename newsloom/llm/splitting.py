"""Cutting texts beyond a size limit into overlapping pieces at their natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Strengths of boundaries, weakest first. A piece that ends at 'inside' or 'space' had no line or sentence end to be cut at.
STRENGTHS = ("inside", "space", "sentence", "line", "blank line", "end")
_NATURAL = 2
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)])


def _is_space(points: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(points, 0x3000)] & (points <= 0x3000)


class Boundaries:
    """The places of a text where it may be cut, with a sparse table for the strongest one in any range."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.size = len(points)
        space = _is_space(points)
        feed, back = points == 10, points == 13
        line = feed | back
        sentence = np.zeros(n, bool)
        sentence[1:] = space[1:] & np.isin(points[:-1], (33, 46, 63))
        strength = space.astype(np.int64)  # of a cut right after the character
        strength[sentence] = 2
        strength[line] = 3
        pair = np.zeros(n, bool)
        pair[:-1] = back[:-1] & feed[1:]
        strength[pair] = 0  # never between the two characters of one line end
        at = np.flatnonzero(line & ~pair)
        if len(at) > 1:  # nothing but white space between this line end and the one before
            ink = np.concatenate([[0], np.cumsum(~space)])
            strength[at[1:][ink[at[1:]] == ink[at[:-1] + 1]]] = 4
        self.places = np.flatnonzero(strength) + 1
        self._pairs = np.flatnonzero(pair)
        key = (strength[self.places - 1] << 40) | self.places  # of equal strengths, the place further right is larger
        self.table = [key]
        while 2 << (len(self.table) - 1) <= len(key):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.maximum(last[:-half], last[half:]))

    def end_at(self, place: int) -> int:
        """Characters of the line end or white space that may begin at `place`: 2 for a pair, else 1."""
        k = int(np.searchsorted(self._pairs, place))
        return 2 if k < len(self._pairs) and self._pairs[k] == place else 1

    def strongest(self, first: int, last: int) -> tuple[int, int]:
        """Strength and place of the strongest boundary in [first, last], the rightmost of equals; (0, last) if there is none."""
        lo, hi = np.searchsorted(self.places, [first, last + 1])
        if lo >= hi:
            return 0, last
        k = int(hi - lo).bit_length() - 1
        best = int(max(self.table[k][lo], self.table[k][hi - (1 << k)]))
        return best >> 40, best & ((1 << 40) - 1)


def pieces(bounds: Boundaries, limit: int, overlap: int, trailing: bool = False) -> list[tuple[int, int, int]]:
    """Begin, end and strength of the end of each piece. With `trailing`, the line end or white space a piece is cut at may stand beyond the limit."""
    out, begin = [], 0
    while bounds.size - begin > limit:
        half, last = begin + max(limit // 2, overlap + 1), begin + limit
        strength, end = bounds.strongest(half, last + bounds.end_at(last) if trailing else last)
        if strength < _NATURAL and overlap + 1 < limit // 2:  # a natural cut that leaves a short piece goes before a forced one
            natural, place = bounds.strongest(begin + overlap + 1, half - 1)
            if natural >= _NATURAL:
                strength, end = natural, place
        if not strength:
            end = last
        out.append((begin, end, strength))
        begin = end - overlap
    if begin < bounds.size:
        out.append((begin, bounds.size, len(STRENGTHS) - 1))
    return out


def split_texts(df: DataFrame, row_id: str = "row_id", text: str = "Article", limit: int = 3000, overlap: int = 200) -> DataFrame:
    """Ordered pieces of at most `limit` characters (code points) of every text.

    Columns: the id, `n_chars` of the whole text, `piece_no` from 0, `begin` and `end`
    (character offsets), `cut` (what the piece ends at, see STRENGTHS) and `piece`. Every
    piece but the first repeats the last `overlap` characters of the one before; the
    pieces without those repeats are the whole text.

    Each end is the strongest boundary in the second half of the permissible lengths,
    the rightmost of equals; if only spaces stand there, a line or sentence end in the
    first half; else a space, else the limit itself. Null and empty texts have no
    pieces, texts within the limit have one; repeated rows and ids come out as often as
    they come in. Other columns of `df` play no part. One pass, no shuffle.
    """
    if not 0 <= overlap < limit - 1:
        raise ValueError("overlap must be at least 0 and below limit - 1")
    schema = f"row_id {dict(df.dtypes)[row_id]}, n_chars int, piece_no int, begin int, end int, cut string, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows: list[tuple] = []
            who: list[int] = []
            for i, s in enumerate(part.column(1).to_pylist()):
                if not s:
                    continue
                for k, (a, b, strength) in enumerate(pieces(Boundaries(s), limit, overlap) if len(s) > limit else [(0, len(s), len(STRENGTHS) - 1)]):
                    who.append(i)
                    rows.append((len(s), k, a, b, STRENGTHS[strength], s[a:b]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int32()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row_id", "n_chars", "piece_no", "begin", "end", "cut", "piece"])

    return df.select(F.col(row_id), F.col(text).cast("string")).mapInArrow(run, schema).withColumnRenamed("row_id", row_id)


def oversized(df: DataFrame, row_id: str = "row_id", text: str = "Article", limit: int = 3000) -> DataFrame:
    """Texts beyond the limit, and whether their pieces all end at line or sentence ends ('natural') or some can't ('forced').

    The pieces are those of `split_texts` without overlap, but that the line end or white
    space they are cut at doesn't count: then a piece is forced only where a stretch
    between neighbouring cuts is itself beyond the limit, whichever cuts went before. Null
    texts and those within the limit have no rows; repeated rows and ids come out as often
    as they come in; other columns play no part. One pass, no shuffle.
    """
    schema = f"row_id {dict(df.dtypes)[row_id]}, need string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            need = [None if not s or len(s) <= limit else "natural" if all(x >= _NATURAL for _, _, x in pieces(Boundaries(s), limit, 0, True)) else "forced" for s in part.column(1).to_pylist()]
            who = pa.array([i for i, x in enumerate(need) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(who), pa.array(need, pa.string()).take(who)], names=["row_id", "need"])

    return df.select(F.col(row_id), F.col(text).cast("string")).mapInArrow(run, schema).withColumnRenamed("row_id", row_id)
