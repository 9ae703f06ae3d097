"""Near-duplicate texts by rare-first prefix filtering over word shingles.

Two texts are alike if the shingles (runs of k words, hashed to 52 bits) found in both
are at least the share t of those found in either.

Shingles are dealt by hash into CLASSES classes. If |A and B| >= t |A or B|, the same
holds within at least one class, since both sides are sums over the classes. So each
class is joined on its own, on small sets, and a pair that is alike in none is never met.

Within a class a set's shingles are ordered rarest first. The order comes from a
frequency sketch over all texts; any order common to all keeps the filters exact, a good
one keeps them narrow. A pair that is alike in a class of sizes a <= b shares at least
(a+b) t/(1+t) shingles, so the first one it shares stands early in both (prefix and
positional filter), sizes are close (length filter), and the bitmaps of all its shingles
differ in few places (suffix filter). Only prefixes are shuffled, to the part a shingle
belongs to; whole sets only of pairs that pass, which are verified once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import distinct, mix, shingles, words
from ..session import cut
from .batches import slices
from .graph import components

CLASSES = 16
#: Sets whose prefix shingles of one class are joined in one task; a class has as many parts as that asks for.
PART_SETS = 500_000
#: Sets with one shingle that are compared in one task; more are dealt into squares of as many.
HOT = 20_000
#: Bits of the cells of the frequency sketch, at least and at most: one byte a cell is broadcast.
LEAST_BITS, MOST_BITS = 18, 26
#: 64-bit words of a set's bitmap in a class.
BITMAP = 2
_RANGES = 16
_LOW40 = np.uint64((1 << 40) - 1)
_SLICE_ROWS = 4096
#: Pairs looked at together within a task.
_EVENTS = 200_000


def shingle_sets(texts: pa.Array, k: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have at least `least_words` words; the len+1 offsets and the sorted distinct 52-bit shingles of those. At most 4,096 texts."""
    w = words(texts)
    n = len(texts)
    enough = np.bincount(w.text, minlength=n) >= max(least_words, k)
    h, of, _ = shingles(w, k)
    keep = enough[of]
    key = distinct((of[keep].astype(np.uint64) << np.uint64(52)) | (h[keep] >> np.uint64(12)))
    sizes = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=n)[enough]
    return np.flatnonzero(enough), np.concatenate([[0], np.cumsum(sizes)]), key & np.uint64((1 << 52) - 1)


def signature(offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that are equal for texts with equal shingle sets."""
    return tuple(mix(np.add.reduceat(mix(tokens + np.uint64(c)), offsets[:-1]) + np.diff(offsets).astype(np.uint64)) if len(tokens) else np.zeros(0, np.uint64) for c in (1, 1 << 53))


def _parts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, column):
        for at in range(0, part.num_rows, _SLICE_ROWS):
            yield part.slice(at, _SLICE_ROWS)


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens & np.uint64((1 << bits) - 1)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 0 to 255: exact up to 127, then by the logarithm. 1 stays 1 and is only given to counts of 1."""
    return np.where(counts < 128, counts, np.minimum(255, 128 + 8 * np.log2(np.maximum(counts, 128) / 128))).astype(np.uint8)


#: The count behind each level.
_COUNTS = np.array([*range(128), *(128 * 2 ** (i / 8) for i in range(128))]).round().astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers as compressed byte planes, each after its length and width."""
    out = []
    for c in columns:
        out += [np.array([len(c), c.dtype.itemsize], "<u4").tobytes(), np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u4", 2, at).tolist()
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n).T).view(f"<u{width}").ravel())
        at += 8 + n * width
    return out


class Postings:
    """What a slice of sets sends to the parts in which prefix shingles are joined.

    A set is named by its signature, so equal sets are one. In each class its shingles are
    ordered rarest first; those that no other set has are left out, and only the first ones
    (the prefix) are sent, with the class's size, the number of its shingles that others
    may have, a bitmap of those, and the size of the whole set.
    """

    def __init__(self, sign: np.ndarray, size: np.ndarray, tokens: np.ndarray, level_of: np.ndarray, bits: int, share: float) -> None:
        of = np.repeat(np.arange(len(size)), size).astype(np.uint64)
        cls = (tokens >> np.uint64(48)) & np.uint64(CLASSES - 1)
        level = level_of[_cells(tokens, bits)]
        key = np.sort((of << np.uint64(52)) | (cls << np.uint64(48)) | (level.astype(np.uint64) << np.uint64(40)) | (tokens & _LOW40))
        group = (key >> np.uint64(48)).astype(np.int64)  # set and class
        n_all = np.bincount(group, minlength=len(size) * CLASSES)
        shared = ((key >> np.uint64(40)) & np.uint64(255)) > 1  # a cell counted once: no other set has it
        n_kept = np.bincount(group[shared], minlength=len(n_all))
        able = (n_kept >= np.ceil(share * n_all - 1e-9)) & (n_kept > 0)  # too few shared ones can't make a pair in this class
        place = np.arange(len(key)) - np.repeat(np.cumsum(n_all) - n_all, n_all)
        key, group, place = key[shared & able[group]], group[shared & able[group]], place[shared & able[group]]
        token = mix(key & _LOW40)
        bitmap = np.zeros((BITMAP, len(n_all)), np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        if len(begin):
            word = (token >> np.uint64(6)) % np.uint64(BITMAP)
            for w in range(BITMAP):
                bitmap[w, group[begin]] = np.bitwise_or.reduceat(np.where(word == w, np.uint64(1) << (token & np.uint64(63)), np.uint64(0)), begin)
        early = place <= n_all[group] - np.ceil(share * n_all[group] - 1e-9)
        token, group, place = token[early] >> np.uint64(8), group[early], place[early]
        # A shingle that very many sets have is dealt into squares of blocks of them.
        count = _COUNTS[((key[early] >> np.uint64(40)) & np.uint64(255)).astype(np.int64)]
        blocks = np.maximum(1, -(-count // HOT))
        hot = blocks > 1
        if hot.any():
            k = np.where(hot, blocks, 1)
            many = np.repeat(np.arange(len(token)), k)
            mine = (sign[group[many] // CLASSES] % k[many].astype(np.uint64)).astype(np.int64)
            other = np.arange(len(many)) - np.repeat(np.cumsum(k) - k, k)
            square = (np.minimum(mine, other) * 65_537 + np.maximum(mine, other)).astype(np.uint64)
            token = np.where(hot[many], mix(token[many] + (square + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8), token[many])
            group, place = group[many], place[many]
        self.token, self.group, self.place = token, group, place
        self.sign, self.size, self.n_all, self.n_kept, self.bitmap = sign, size, n_all, n_kept, bitmap
        self.classes = np.count_nonzero(n_all.reshape(-1, CLASSES), axis=1)  # those with any shingle

    def records(self, subs: int) -> Iterator[tuple[int, bytes]]:
        """Part, and what is sent to it."""
        part = (self.group % CLASSES) * subs + ((self.token >> np.uint64(32)) % np.uint64(subs)).astype(np.int64)
        order = np.lexsort((self.group, part))
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
            g = self.group[rows]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            head = g[begin]
            doc = head // CLASSES
            columns = [self.sign[doc], self.size[doc].astype("<u4"), self.n_all[head].astype("<u4"), self.n_kept[head].astype("<u4"), self.classes[doc].astype("<u1"), np.diff(np.append(begin, len(g))).astype("<u4"), self.token[rows].astype("<u4"), self.place[rows].astype("<u4"), *(b[head] for b in self.bitmap)]
            # Signatures go with 40 bits: what they leave open costs a candidate.
            columns[0] = (columns[0] & _LOW40).astype("<u8")
            yield int(part[rows[0]]), _pack(*columns)


class Part:
    """The prefix shingles that meet in one task."""

    def __init__(self, packed: list[bytes]) -> None:
        sign, size, n_all, kept, classes, count, token, place, *bitmap = (np.concatenate(c) for c in zip(*map(_unpack, packed), strict=True))
        begin = np.cumsum(count.astype(np.int64)) - count
        whole = sign
        for b in bitmap:
            whole = mix(whole + b)
        once = np.unique(whole, return_index=True)[1]  # equal sets have sent equal shingles
        count = count[once].astype(np.int64)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[once], count)
        self.sign, self.bitmap = sign[once], [b[once] for b in bitmap]
        self.size, self.all, self.kept, self.classes = (c[once].astype(np.int64) for c in (size, n_all, kept, classes))
        self.doc, self.token, self.place = np.repeat(np.arange(len(once)), count), token[at], place[at].astype(np.int64)

    def pairs(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of sets that may be alike within the class, by prefix, length, position and bitmap: their signatures, by how much they may share more than a pair that is just alike does, and the number of classes with shingles of one of them."""
        ratio = share / (1 + share)
        order = np.lexsort((self.all[self.doc], self.token))
        token, doc, at = self.token[order], self.doc[order], self.place[order]
        if len(token) < 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        stop = np.repeat(edge[1:], np.diff(edge))
        # The smaller set of a pair shares at least ratio * 2 of itself.
        first = np.flatnonzero((at <= self.all[doc] - np.ceil(2 * ratio * self.all[doc] - 1e-9)) & (stop - np.arange(len(token)) > 1))
        count = stop[first] - first - 1
        upto = np.cumsum(count)
        found: list[np.ndarray] = []
        done = 0
        while done < len(first):
            to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + _EVENTS, "right")))
            c = count[done:to]
            left = np.repeat(first[done:to], c)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            done = to
            x, y = doc[left], doc[right]
            need = np.ceil((self.all[x] + self.all[y]) * ratio - 1e-9)
            ok = np.minimum(self.all[x] - at[left], self.all[y] - at[right]) >= need
            ok &= np.minimum(self.size[x], self.size[y]) >= share * np.maximum(self.size[x], self.size[y]) - 1e-9
            x, y, need = x[ok], y[ok], need[ok]
            ok = (self.kept[x] + self.kept[y] - self._differ(x, y) >= 2 * need) & (x != y)
            x, y = x[ok], y[ok]
            found.append(distinct(np.minimum(x, y) * len(self.sign) + np.maximum(x, y)))
        key = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
        x, y = key // len(self.sign), key % len(self.sign)
        most = np.minimum((self.kept[x] + self.kept[y] - self._differ(x, y)) / 2, np.minimum(self.kept[x], self.kept[y]))
        return self.sign[x], self.sign[y], most - ratio * (self.all[x] + self.all[y]), np.maximum(self.classes[x], self.classes[y])

    def _differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in self.bitmap)


def least_lack(share: float) -> float:
    """By how much a pair that is not alike in a class shares less there than one that is just alike, at least."""
    ratio = share / (1 + share)
    return max(0.0, min(ratio * n - (np.ceil(ratio * n - 1e-9) - 1) for n in range(1, 1000)) - 1e-9)


class NearDuplicates:
    """Texts that are alike, within one table.

    A text is `title` (null as empty), a space, `text`; rows with null text or fewer than
    `least_words` words are left out. Words are runs of a-z and 0-9 after lowering A-Z.
    Equal ids are one row. Row ids must be bigint. An empty table gives no rows. Other
    columns play no part. Rows with equal shingle sets are joined as one and expanded last.

    Texts are read three times with their words (signatures and sketch; prefixes; sets of
    what may be alike), once for their length. The plan is the same at every size.
    """

    def __init__(self, df: DataFrame, row_id: str = "row_id", text: str = "Article", title: str | None = "Article_title", k: int = 3, share: float = 0.5, least_words: int = 40) -> None:
        self.k, self.share, self.least_words, self.row_id = k, share, least_words, row_id
        body = F.col(text).cast("string")
        whole = F.concat(F.coalesce(F.col(title).cast("string"), F.lit("")), F.lit(" "), body) if title else body
        self.rows = df.select(F.col(row_id).cast("bigint").alias("id"), whole.alias("text")).where("id is not null and text is not null")
        self._pairs: DataFrame | None = None
        self._copies: DataFrame | None = None
        self._scan: DataFrame | None = None
        self._bits = 0

    def _scanned(self) -> DataFrame:
        """One pass: signatures (id, s, t) of all texts, and the tasks' frequency sketches (range, cells)."""
        if self._scan is not None:
            return self._scan
        k, least = self.k, self.least_words
        # About a shingle for six characters, and a cell for at most four.
        chars = self.rows.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = self._bits = min(MOST_BITS, max(LEAST_BITS, int(chars // 24).bit_length()))
        width = (1 << bits) // _RANGES
        names = ["id", "s", "t", "range", "cells"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(1 << bits, np.uint32)
            for part in _parts(batches):
                which, offsets, tokens = shingle_sets(part.column(1), k, least)
                np.add.at(cells, _cells(tokens, bits), np.uint32(1))
                s, t = signature(offsets, tokens)
                n = len(which)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(s.view(np.int64)), pa.array(t.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            held = [(i, p) for i in range(_RANGES) if (p := cells[i * width : (i + 1) * width]).any()]
            packed = [_pack(np.diff(np.flatnonzero(p), prepend=0).astype("<u4"), _levels(p[p > 0])) for _, p in held]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(held), pa.int64()) for _ in range(3)), pa.array([i for i, _ in held], pa.int32()), pa.array(packed, pa.binary())], names=names)

        self._scan = cut(self.rows.mapInArrow(run, "id bigint, s bigint, t bigint, range int, cells binary"))
        return self._scan

    def _sketch(self) -> bytes:
        """The level of every cell of the frequency sketch."""
        scan = self._scanned().where("range is not null").select("range", "cells")
        width = (1 << self._bits) // _RANGES

        def total(of: pa.Table) -> pa.Table:
            sums = np.zeros(width, np.int64)
            for packed in of.column("cells"):
                gaps, levels = _unpack(packed.as_py())
                sums[np.cumsum(gaps, dtype=np.int64)] += _COUNTS[levels]
            return pa.table({"range": of.column("range")[:1], "levels": pa.array([_levels(sums).tobytes()], pa.binary())})

        by = {r["range"]: bytes(r["levels"]) for r in scan.groupBy("range").applyInArrow(total, "range int, levels binary").collect()}
        return b"".join(by.get(i, bytes(width)) for i in range(_RANGES))

    def _reps(self) -> DataFrame:
        """s, t, rep of every distinct shingle set: rep is the smallest id with it, n the number of its rows."""
        signed = self._scanned().where("range is null")
        # Equal sets are combined before the shuffle.
        return signed.groupBy("s", "t").agg(F.min("id").alias("rep"), F.count("*").alias("n"))

    def candidates(self) -> DataFrame:
        """Pairs (a < b) that may be alike in at least one class, of rows that stand for all rows with their shingle set."""
        k, least, share = self.k, self.least_words, self.share
        sketch, bits = self._sketch(), self._bits
        reps = cut(self._reps())
        subs = max(1, -(-reps.count() // PART_SETS))
        levels_ = self.rows.sparkSession.sparkContext.broadcast(sketch)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level_of = np.frombuffer(levels_.value, np.uint8)
            for part in _parts(batches, 0):
                which, offsets, tokens = shingle_sets(part.column(0), k, least)
                if not len(which):
                    continue
                sign, _ = signature(offsets, tokens)
                size = np.diff(offsets)
                once = np.unique(sign, return_index=True)[1]
                taken = np.zeros(len(size), bool)
                taken[once] = True
                sent = list(Postings(sign[taken], size[taken], tokens[np.repeat(taken, size)], level_of, bits, share).records(subs))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in sent], pa.int32()), "packed": pa.array([x for _, x in sent], pa.binary())})

        def join(part: pa.Table) -> pa.Table:
            x, y, over, classes = Part([p.as_buffer().to_pybytes() for p in part.column("packed")]).pairs(share)
            cls = part.column("part")[0].as_py() // subs
            return pa.table({"x": pa.array(np.minimum(x, y).astype(np.int64)), "y": pa.array(np.maximum(x, y).astype(np.int64)), "cls": pa.array(np.full(len(x), cls, np.int32)), "over": pa.array(over.round(6)), "classes": pa.array(classes, pa.int32())})

        dealt = self.rows.select("text").mapInArrow(deal, "part int, packed binary")
        met = dealt.repartition(CLASSES * subs, "part").groupBy("part").applyInArrow(join, "x bigint, y bigint, cls int, over double, classes int").distinct()
        # Over all classes a pair shares as much as one that is just alike only if what it may share more where it was met makes up for what it lacks elsewhere.
        lack = (F.min("classes") - F.count_distinct("cls")) * least_lack(share)
        met = met.groupBy("x", "y").agg(F.sum("over").alias("over"), lack.alias("lack")).where(F.col("over") + 1e-4 >= F.col("lack")).select("x", "y")
        named = reps.select(F.col("s").bitwiseAND(F.lit((1 << 40) - 1)).alias("x"), F.col("rep"))
        both = met.join(named.withColumnRenamed("rep", "p"), "x").join(named.select(F.col("x").alias("y"), F.col("rep").alias("q")), "y")
        return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct()

    def pairs(self) -> DataFrame:
        """Verified pairs (a < b) with `shared` and `either`, of rows that stand for all rows with their shingle set."""
        if self._pairs is not None:
            return self._pairs
        k, least, share = self.k, self.least_words, self.share
        met = cut(self.candidates())
        ids = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # Texts that are in no candidate are left out by a bitmap of bounded size; a false hit costs one row.
        bits = min(1 << 28, max(1 << 16, 1 << int(met.count() * 32).bit_length()))
        slot = F.pmod(F.xxhash64("id"), F.lit(bits))
        maps = ids.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(32768))).alias("bits")).collect()
        wanted = np.zeros(bits // 8, np.uint8)
        for r in maps:
            wanted[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        wanted_ = self.rows.sparkSession.sparkContext.broadcast(wanted.tobytes())

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.frombuffer(wanted_.value, np.uint8)
            for part in _parts(batches):
                at = np.asarray(part.column(2))
                part = part.take(pa.array(np.flatnonzero(known[at >> 3] >> (at & 7) & 1)))
                if not part.num_rows:
                    continue
                which, offsets, tokens = shingle_sets(part.column(1), k, least)
                raw = [_pack(np.diff(tokens[a:b], prepend=np.uint64(0))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(raw, pa.binary())], names=["id", "set"])

        texts = self.rows.select("id", "text", slot.alias("slot")).mapInArrow(sets, "id bigint, set binary").dropDuplicates(["id"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared, either = [], []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    s, t = (np.cumsum(_unpack(v.as_buffer().to_pybytes())[0]) for v in (x, y))
                    both = np.sort(np.concatenate([s, t]))
                    shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
                    either.append(len(both) - shared[-1])
                ok = pa.array([a >= share * b - 1e-9 for a, b in zip(shared, either, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int32()), pa.array(either, pa.int32())], names=["a", "b", "shared", "either"]).filter(ok)

        paired = met.join(texts.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        self._pairs = cut(paired.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint, shared int, either int"))
        return self._pairs

    def copies(self) -> DataFrame:
        """(id, rep) of every row that takes part: rep is the smallest id with the same shingle set."""
        if self._copies is None:
            signed = self._scanned().where("range is null").select("id", "s", "t")
            # A group of a third of all rows meets one row for its signature.
            many = self._reps().where("n > 1").select("s", "t", "rep")
            self._copies = cut(signed.join(many, ["s", "t"], "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct())
        return self._copies

    def expanded(self) -> DataFrame:
        """Every pair of rows (a < b) that are alike, those with equal sets included."""
        copy = self.copies()
        pairs = self.pairs().select("a", "b")
        grown = copy.where("id <> rep")
        grown = grown.unionByName(grown.select(F.col("rep").alias("id"), "rep").distinct())
        left = grown.select(F.col("id").alias("x"), F.col("rep").alias("a"))
        right = grown.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        across = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        within = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(within).select(F.col("x").alias(f"{self.row_id}_a"), F.col("y").alias(f"{self.row_id}_b"))

    def groups(self) -> DataFrame:
        """Every row that takes part: its group (the smallest id joined to it by links), the row that stands for its shingle set, and the number of other sets linked to that one."""
        links = self.pairs()
        root = components(links)
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        named = self.copies().join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
        return named.select(F.col("id").alias(self.row_id), F.coalesce("root", "rep").alias("group_id"), F.col("rep").alias("same_as"), F.coalesce("links", F.lit(0)).alias("links"))
