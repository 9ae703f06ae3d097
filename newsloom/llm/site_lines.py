"""Lines that a site repeats across its documents, found by suffix arrays over line identifiers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import distinct
from ..session import cut
from .batches import slices

#: Rows of one site whose lines go into one suffix array.
CHUNK_ROWS = 20_000
#: Windows (site and 64-bit key) that are broadcast exactly; beyond, sites are taken in groups or rows are joined.
BROADCAST_KEYS = 2_000_000
#: Bits of the largest bitmap of candidates.
MOST_BITS = 1 << 27
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def site_of(url: str) -> Column:
    """Host in lower case, without user, port and one leading `www.`; null without `scheme://host`."""
    host = F.regexp_extract(F.lower(F.trim(F.col(url))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(bare != "", bare)


def line_ids(text: str) -> list[int]:
    """64-bit identifiers of the lines, without white space at both ends; 0 for a blank line."""
    return [xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63) or 1 if (s := line.strip()) else 0 for line in text.split("\n")]


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the length of the prefix each shares with the one before, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        levels.append(rank)
        k *= 2
    shared = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][i[inside]] == levels[level][j[inside]]
        # Equal ranks of a level mean equal runs of that length only where the run does not pass the end.
        same &= np.maximum(i, j) + (1 << level) <= n
        shared[1:] += same * (1 << level)
        i, j = i + same * (1 << level), j + same * (1 << level)
    return order, shared


def common_prefixes(rows: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Blocks of consecutive lines found in at least `least` of the rows, by a suffix array over all lines of all rows.

    Gives the lines of all rows one after the other, without blank ones (0) and with a
    separator (0) before each row; for each place the number of lines of the longest block
    that begins there; and for each number of lines from 1 a place of every block of as
    many lines, with its number of rows. The suffixes that begin with a block are
    neighbours in the suffix array, with a common prefix of its length.
    """
    line = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row, line = row[line != 0], line[line != 0]
    if not len(line):
        return line, line, []
    name, code = np.unique(line, return_inverse=True)
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    at = np.arange(len(line)) + np.cumsum(begins)
    ids = np.empty(len(line) + begins.sum(), np.int64)
    sep = np.ones(len(ids), bool)
    sep[at] = False
    ids[at] = code
    ids[sep] = len(name) + np.arange(sep.sum())  # unlike all others
    of = np.full(len(ids), -1)
    of[at] = row
    order, shared = suffix_array(ids)
    length = np.zeros(len(ids), np.int64)
    levels = []
    place = order[~sep[order]]
    group = np.cumsum(shared < 1)[~sep[order]]
    level = 1
    while len(place):
        first = np.concatenate([[True], group[1:] != group[:-1]])
        dense = np.cumsum(first) - 1
        once = distinct(dense * len(rows) + of[place]) // len(rows)
        count = np.bincount(once, minlength=int(dense[-1]) + 1)
        good = count[dense] >= least
        length[place[good]] = level
        levels.append((place[good & first], count[dense[good & first]]))
        after = place + level
        keep = good & (after < len(ids))
        keep[keep] = ~sep[after[keep]]
        level += 1
        # Neighbours that share this many lines stay together; others part.
        parts = np.cumsum(shared < level)
        rank = np.empty(len(ids), np.int64)
        rank[order] = parts
        place = place[keep]
        group = rank[place]
    out = np.zeros(len(ids), np.int64)
    out[at] = line
    return out, length, [x for x in levels if len(x[0])]


def block_starts(length: np.ndarray) -> np.ndarray:
    """Places at which a block begins that is no part of a longer one beginning a line before."""
    return np.flatnonzero((length > 0) & (np.concatenate([[0], length[:-1]]) <= length))


def repeated_blocks(rows: list[np.ndarray], least: int) -> list[tuple[tuple[int, ...], int]]:
    """Blocks of lines in at least `least` rows, each as long as it can be at one of its places, with their numbers of rows."""
    lines, length, levels = common_prefixes(rows, least)
    wide = {tuple(lines[p : p + k].tolist()): int(n) for k, (places, counts) in enumerate(levels, 1) for p, n in zip(places.tolist(), counts.tolist(), strict=True)}
    return [(b, wide[b]) for b in {tuple(lines[s : s + length[s]].tolist()) for s in block_starts(length).tolist()}]


def chain(key: int, line: int) -> int:
    """Key of a block with one more line, from the key of the block (0 for none)."""
    key = ((key ^ (line & _MASK)) * _PRIME + 1) & _MASK
    return key ^ (key >> 29)


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def windows(ids: list[int], size: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Key and line numbers (from 1) of every run of `size` lines, blank ones passed over."""
    ink = [(k, x) for k, x in enumerate(ids, 1) if x]
    for i in range(len(ink) - size + 1):
        run = ink[i : i + size]
        key = 0
        for _, x in run:
            key = chain(key, x)
        yield signed(key), tuple(k for k, _ in run)


def _least(n: int, share: float) -> int:
    """Rows of n that `share` asks for."""
    return max(1, math.ceil(round(n * share, 6)))


class SiteLines:
    """Repeated lines of every site of a table.

    A row counts for its site if its text is not null and its URL has a host. A block of
    `size` lines (one by default) is repeated if it stands in at least `least_rows` rows
    and `share` of the rows of its site; a row counts once. A longer block is repeated
    only if all its blocks of `size` lines are, so these cover it. Lines are split at line
    feeds, numbered from 1 and compared without white space at both ends; blank ones are
    passed over and never removed. Empty texts have one blank line. An empty table gives
    no rows. Other columns play no part.

    Method: the line identifiers of a site's rows go, in chunks of about CHUNK_ROWS rows
    dealt by a hash of the row, into suffix arrays. Blocks of any length that spread over
    `share` of a chunk's rows, found by common prefixes, are candidates: a block that is
    repeated in a site is one in at least one chunk. One scan then finds the candidates'
    places, through a bitmap of bounded size, and counts them exactly over all rows of the
    site; blocks that stay are deleted wherever they stand.
    """

    def __init__(self, df: DataFrame, row_id: str = "row_id", url: str = "Url", text: str = "Article", least_rows: int = 4, share: float = 0.1, size: int = 1) -> None:
        self.row_id, self.least_rows, self.share, self.size = row_id, least_rows, share, size
        self.kind = dict(df.dtypes)[row_id]
        self.rows = df.select(F.col(row_id).alias("row_id"), site_of(url).alias("site"), F.col(text).cast("string").alias("text"))
        self.counted = self.rows.where("site is not null and text is not null")
        self.sites = cut(self.counted.groupBy("site").agg(F.count("*").alias("n")))
        self._places: DataFrame | None = None
        self._repeated: DataFrame | None = None

    def _ids(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 2):
                lines = [np.array(line_ids(t), np.int64) for t in part.column(2).to_pylist()]
                sizes = np.cumsum([0] + [len(x) for x in lines])
                flat = pa.array(np.concatenate(lines))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=["row_id", "site", "lines"])

        return self.counted.select("row_id", "site", "text").mapInArrow(run, f"row_id {self.kind}, site string, lines array<bigint>")

    def _candidates(self, every: bool = False) -> DataFrame:
        """site, key of the blocks of `size` lines within the blocks of each chunk; of all its blocks if `every`."""
        least_rows, share, size = self.least_rows, self.share, self.size

        def run(chunk: pa.Table) -> pa.Table:
            flat = chunk.column("lines").combine_chunks()
            offsets = flat.offsets.to_numpy()
            rows = np.split(flat.values.to_numpy(), offsets[1:-1])
            least = _least(len(rows), share)
            lines, length, levels = common_prefixes(rows, max(least, least_rows) if chunk.column("chunks")[0].as_py() == 1 else least)
            keys = set()
            if every:
                for k, (places, _) in enumerate(levels, 1):
                    for p in places.tolist():
                        key = 0
                        for x in lines[p : p + k].tolist():
                            key = chain(key, x)
                        keys.add(signed(key))
            else:
                for s in block_starts(length).tolist():
                    keys.update(key for key, _ in windows(lines[s : s + length[s]].tolist(), size))
            return pa.table({"site": pa.array([chunk.column("site")[0].as_py()] * len(keys), pa.string()), "key": pa.array(list(keys), pa.int64())})

        sized = self._ids().join(self.sites.select("site", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks")), "site")
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("row_id", "lines"), F.col("chunks"))).drop("row_id")
        return cut(salted.groupBy("site", "salt").applyInArrow(run, "site string, key bigint").distinct())

    def _enough(self, counts: DataFrame) -> DataFrame:
        """Of site, key, rows those that are repeated in their site."""
        least = F.greatest(F.lit(self.least_rows), F.ceil(F.round(F.col("n") * self.share, 6)))
        return counts.join(self.sites, "site").where(F.col("rows") >= least)

    def places(self) -> DataFrame:
        """Every place of a repeated block: row_id, site, key, `at` (its line numbers)."""
        if self._places is None:
            known = self._candidates()
            found = cut(self._hits(known, _bitmap(known)).join(known, ["site", "key"], "left_semi"))
            self._repeated = cut(self._enough(found.groupBy("site", "key").agg(F.sum("first").alias("rows"))).select("site", "key"))
            self._places = found.drop("first").join(self._repeated, ["site", "key"], "left_semi")
        return self._places

    def _hits(self, known: DataFrame, bitmap: bytes) -> DataFrame:
        """row_id, site, key, at, first (1 at the first place in the row) of all blocks of `size` lines that hit the bitmap."""
        size, bits = self.size, len(bitmap) * 8
        sent = known.sparkSession.sparkContext.broadcast(bitmap)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen_bits, salts = sent.value, {}
            for part in slices(batches, 2):
                who, keys, at, first = [], [], [], []
                for i, (site, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    salt = salts.get(site)
                    if salt is None:
                        salt = salts[site] = site_salt(site)
                    seen: set[int] = set()
                    for key, numbers in windows(line_ids(text), size):
                        slot = (key ^ salt) % bits
                        if seen_bits[slot >> 3] >> (slot & 7) & 1:
                            who.append(i)
                            keys.append(key)
                            at.append(numbers)
                            first.append(int(key not in seen))
                            seen.add(key)
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(keys, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(first, pa.int32())], names=["row_id", "site", "key", "at", "first"])

        return self.counted.select("row_id", "site", "text").mapInArrow(run, f"row_id {self.kind}, site string, key bigint, at array<int>, first int")

    def found(self) -> DataFrame:
        """Row and number of every line of a repeated block."""
        placed = self.places().select("row_id", F.explode("at").alias("line_no"))
        # Blocks of several lines overlap; rows of one id may not be told apart then.
        return (placed if self.size == 1 else placed.distinct()).withColumnRenamed("row_id", self.row_id)

    def cleaned(self, text: str = "Article") -> DataFrame:
        """Every row's id and its text without its site's repeated blocks, with `n_removed` (lines). Null texts stay null; rows without a site or an id keep their text. Beyond BROADCAST_KEYS repeated blocks, ids must be unique: rows of one id are taken as one."""
        self.places()
        size = self.size
        if self._repeated.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
            gone = self.places().select("row_id", F.explode("at").alias("k")).groupBy("row_id").agg(F.collect_set("k").alias("gone"))
            kept = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains("gone", (k + 1).cast("int")))
            joined = self.rows.join(gone, "row_id", "left")
            return joined.select(F.col("row_id").alias(self.row_id), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
        sent = self.rows.sparkSession.sparkContext.broadcast(_by_site(self._repeated))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = {s: set(x.tolist()) for s, x in sent.value.items()}
            for part in slices(batches, 2):
                texts, removed = [], []
                for site, whole in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    gone = {k for key, numbers in windows(line_ids(whole), size) if key in by[site] for k in numbers} if whole and site in by else ()
                    texts.append("\n".join(x for k, x in enumerate(whole.split("\n"), 1) if k not in gone) if gone else whole)
                    removed.append(len(gone))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["row_id", "text", "n_removed"])

        return self.rows.mapInArrow(run, f"row_id {self.kind}, text string, n_removed int").withColumnsRenamed({"row_id": self.row_id, "text": text})

    def blocks(self) -> DataFrame:
        """Repeated blocks of any length, once for each site: site, `block` (its lines, without white space at both ends), `n_lines`, `n_rows`, `of_rows` (all rows of the site).

        Each is as long as it can be at one of its places, and no part of a longer block
        that begins a line before there. Sites are taken in groups that have at most about
        BROADCAST_KEYS blocks together; each group reads the rows of its own sites.
        """
        known = self._candidates(every=True)
        counts = cut(self._enough(self._grouped(known, self._counted_blocks, "site string, key bigint, rows bigint").groupBy("site", "key").agg(F.sum("rows").alias("rows"))))
        starts = self._grouped(counts.select("site", "key"), self._block_texts, "site string, key bigint, block string, n_lines int")
        once = starts.groupBy("site", "key").agg(F.min("block").alias("block"), F.first("n_lines").alias("n_lines"))
        return once.join(counts, ["site", "key"]).select("site", "block", "n_lines", F.col("rows").alias("n_rows"), F.col("n").alias("of_rows"))

    def _grouped(self, keys: DataFrame, scan, schema: str) -> DataFrame:
        """The rows that `scan(batches, keys of each site)` gives for the texts, with the keys of a group of sites sent at a time."""
        groups = max(1, -(-keys.count() // BROADCAST_KEYS))
        group = F.pmod(F.xxhash64("site"), F.lit(groups))
        parts = []
        for g in range(groups):
            sent = keys.sparkSession.sparkContext.broadcast(_by_site(keys.where(group == g)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                return scan(batches, {s: set(x.tolist()) for s, x in sent.value.items()})

            parts.append(self.counted.where(group == g).select("site", "text").mapInArrow(run, schema))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _counted_blocks(batches: Iterator[pa.RecordBatch], by: dict[str, set[int]]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches, 1):
            for site, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if site in by:
                    held.update({(site, key) for _, keys in _runs(line_ids(text), by[site]) for key in keys})
        sites, keys = zip(*held, strict=True) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(keys, pa.int64()), pa.array(list(held.values()), pa.int64())], names=["site", "key", "rows"])

    @staticmethod
    def _block_texts(batches: Iterator[pa.RecordBatch], by: dict[str, set[int]]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[str, int]] = {}
        for part in slices(batches, 1):
            for site, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if site not in by:
                    continue
                runs = list(_runs(line_ids(text), by[site]))
                length = np.array([len(keys) for _, keys in runs], np.int64)
                for s in block_starts(length).tolist():
                    key = (site, runs[s][1][-1])
                    if key not in held:
                        lines = text.split("\n")
                        held[key] = "\n".join(lines[runs[j][0] - 1].strip() for j in range(s, s + int(length[s]))), int(length[s])
        sites, keys = zip(*held, strict=True) if held else ((), ())
        texts, sizes = zip(*held.values(), strict=True) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=["site", "key", "block", "n_lines"])


def _runs(ids: list[int], known: set[int]) -> Iterator[tuple[int, list[int]]]:
    """For every line that is not blank its number, and the keys of the known blocks that begin there, shortest first. A block is known only if all that begin it are."""
    ink = [(k, x) for k, x in enumerate(ids, 1) if x]
    for i, (k, _) in enumerate(ink):
        keys: list[int] = []
        key = 0
        for _, x in ink[i:]:
            key = chain(key, x)
            if signed(key) not in known:
                break
            keys.append(signed(key))
        yield k, keys


def _by_site(keys: DataFrame) -> dict[str, np.ndarray]:
    """Keys of each site; of a table whose size was checked."""
    found = keys.select("site", "key").toArrow()
    sites = found.column("site").combine_chunks().dictionary_encode()
    at, values = np.asarray(sites.indices), found.column("key").to_numpy()
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.diff(at[order])) + 1
    return {sites.dictionary[int(at[g[0]])].as_py(): values[g] for g in np.split(order, edges) if len(g)}


def site_salt(site: str) -> int:
    return xxhash.xxh3_64_intdigest(site.encode("utf-8", "surrogatepass")) >> 1


def _bitmap(keys: DataFrame) -> bytes:
    """Bits of the (site, key) pairs, at least 16 for each pair up to MOST_BITS in all. A false hit costs a row of a later join."""
    bits = min(MOST_BITS, max(1 << 16, 1 << int(keys.count() * 16).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = [(key ^ site_salt(site)) % bits for site, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([x >> 15 for x in slot], pa.int64()), "bit": pa.array([x & 32767 for x in slot], pa.int64())})

    maps = keys.select("site", "key").mapInArrow(run, "block bigint, bit bigint").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in maps:
        out[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()
