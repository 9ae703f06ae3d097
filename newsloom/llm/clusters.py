"""Grouping vectors into clusters: distributed k-means with parallel oversampled seeding, and clusters of linked vectors.

Vectors are packed into blocks (one row holds thousands), so every pass moves a few rows
and works on whole matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed_features
from ..functions.words import mix
from ..session import cut
from .graph import components, union

#: Vectors of one block.
BLOCK = 5_000
#: Vectors of a cell that are linked with each other in one task; larger cells are taken in parts.
SIDE = 20_000
#: Members that stand for a larger part of a cluster when parts are compared.
STANDING = 16
#: Vectors of one side of one task in which parts are compared, and its sides at least.
WIDE, LEAST_SIDES = 50_000, 4
#: Vectors compared with one part in one task.
VISITORS = 50_000
_ROWS = 1_000
#: What rounding may take from an angle.
_SLACK = 2e-3


def pack(df: DataFrame, row_id: str = "chunk_id", vector: str = "emb", dims: int = 64) -> DataFrame:
    """Blocks of unit vectors: `ids` and `x` (float32, row by row) as binary. `vector` may also be a string column, which is turned into hashed weighted features.

    Null, non-finite, all-zero vectors and those of another length are left out, as are rows without id.
    """
    text = dict(df.dtypes)[vector] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0

        def block() -> pa.RecordBatch:
            i, x = np.concatenate(ids), np.concatenate(xs)
            return pa.RecordBatch.from_pydict({"ids": pa.array([i.astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.astype("<f4").tobytes()], pa.binary())})

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                if text:
                    x = hashed_features(batch.column(1), dims)
                    fit = np.arange(len(x))
                else:
                    lists = batch.column(1).cast(pa.list_(pa.float64()))
                    size = np.diff(lists.offsets.to_numpy())
                    fit = np.flatnonzero((size == dims) & lists.is_valid().to_numpy(zero_copy_only=False))
                    values = lists.values.to_numpy(zero_copy_only=False)
                    x = values[lists.offsets.to_numpy()[fit][:, None] + np.arange(dims)]
                with np.errstate(invalid="ignore", over="ignore"):
                    norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                if good.any():
                    ids.append(np.asarray(batch.column(0))[fit[good]])
                    xs.append(x[good] / norm[good, None])
                    held += int(good.sum())
                if held >= BLOCK:
                    yield block()
                    ids, xs, held = [], [], 0
        if held:
            yield block()

    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    return rows.mapInArrow(run, "ids binary, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
            yield np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), "<f4").reshape(-1, dims)


class KMeans:
    """Spherical k-means over packed blocks. `k` defaults to half the square root of the number of vectors, 16 to 4,096."""

    def __init__(self, blocks: DataFrame, dims: int = 64, k: int | None = None, rounds: int = 4, passes: int = 8, tolerance: float = 1e-4, seed: int = 7) -> None:
        self.blocks, self.dims = blocks, dims
        self.n = blocks.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
        self.k = int(min(max(1, self.n), k or min(4096, max(16, math.sqrt(self.n) / 2))))
        self.centroids = np.zeros((0, dims), np.float32)
        if self.n:
            self.centroids = self._seed(rounds, seed)
            for _ in range(passes):
                moved = self._lloyd()
                if moved <= tolerance:
                    break

    def _gather(self, fn, schema: str) -> list:
        """The rows that `fn(ids, vectors)` gives for each block; their number and size must not grow with the block."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _blocks(batches, dims):
                yield pa.RecordBatch.from_pydict(fn(ids, x))

        return self.blocks.mapInArrow(run, schema)

    def _totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and numbers of the vectors nearest to each centroid, and the cost, combined within each task first."""
        dims, k = self.dims, len(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, count, cost = np.zeros((k, dims)), np.zeros(k, np.int64), 0.0
            for _, x in _blocks(batches, dims):
                for at in range(0, len(x), _ROWS):
                    part = x[at : at + _ROWS]
                    near = part @ centroids.T
                    best = near.argmax(1)
                    count += np.bincount(best, minlength=k)
                    order = np.argsort(best, kind="stable")
                    begin = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) != 0]))
                    sums[best[order][begin]] += np.add.reduceat(part[order], begin, dtype=np.float64)
                    cost += float((1 - near.max(1)).sum())
            yield pa.RecordBatch.from_pydict({"j": pa.array([0]), "sums": pa.array([sums.tobytes()], pa.binary()), "count": pa.array([count.tobytes()], pa.binary()), "cost": pa.array([cost])})

        def add(part: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_buffer()) for x in part.column("sums"))
            count = sum(np.frombuffer(x.as_buffer(), np.int64) for x in part.column("count"))
            return pa.table({"j": pa.array([0]), "sums": pa.array([sums.tobytes()], pa.binary()), "count": pa.array([count.tobytes()], pa.binary()), "cost": pa.array([float(sum(part.column("cost").to_pylist()))])})

        schema = "j bigint, sums binary, count binary, cost double"
        parts = self.blocks.mapInArrow(run, schema)
        # Two levels, so that no task meets more than about the square root of the number of tasks' tables.
        wide = max(1, math.isqrt(self.blocks.rdd.getNumPartitions()))
        some = parts.withColumn("j", F.pmod(F.spark_partition_id(), F.lit(wide)).cast("bigint")).groupBy("j").applyInArrow(add, schema) if wide > 8 else parts
        total = some.withColumn("j", F.lit(0).cast("bigint")).groupBy("j").applyInArrow(add, schema).collect()
        return sum(np.frombuffer(bytes(r.sums)).reshape(k, dims) for r in total), sum(np.frombuffer(bytes(r["count"]), np.int64) for r in total), sum(r.cost for r in total)

    def _seed(self, rounds: int, seed: int) -> np.ndarray:
        """Parallel oversampled seeding: each round takes every vector with a probability in proportion to its cost; the sample, weighted, is clustered on the driver."""
        dims, want = self.dims, 2 * self.k

        def first(ids: np.ndarray, x: np.ndarray) -> dict:
            j = int(mix(ids.view(np.uint64) + np.uint64(seed)).argmin())
            return {"h": pa.array([int(mix(ids[j : j + 1].view(np.uint64) + np.uint64(seed))[0] >> np.uint64(1))]), "v": pa.array([x[j].tobytes()], pa.binary())}

        row = self._gather(first, "h bigint, v binary").orderBy("h", "v").first()
        chosen = np.frombuffer(bytes(row.v), "<f4").reshape(1, dims)
        for r in range(rounds):
            centres = chosen
            cost = self._totals(centres)[2]
            if cost <= 1e-9:
                break

            def sample(ids: np.ndarray, x: np.ndarray, r: int = r, centres: np.ndarray = centres, cost: float = cost) -> dict:
                near = np.concatenate([(x[a : a + _ROWS] @ centres.T).max(1) for a in range(0, len(x), _ROWS)])
                dice = mix(ids.view(np.uint64) + np.uint64((r + 1) * 7919 + seed)) / np.float64(2**64)
                taken = np.flatnonzero(dice < want * np.maximum(0, 1 - near) / cost)
                return {"id": pa.array(ids[taken]), "v": pa.array([v.tobytes() for v in x[taken]], pa.binary())}

            taken = self._gather(sample, "id bigint, v binary").orderBy("id", "v").collect()
            if taken:
                chosen = np.concatenate([chosen, *(np.frombuffer(bytes(t.v), "<f4").reshape(1, dims) for t in taken)])
        weight = self._totals(chosen)[1].astype(float)
        return _recluster(chosen, weight, self.k, np.random.default_rng(seed))

    def _lloyd(self) -> float:
        sums, count, _ = self._totals(self.centroids)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = np.where(norm > 0, sums / np.maximum(norm, 1e-30), self.centroids).astype(np.float32)
        moved = float(np.mean(1 - (fresh * self.centroids).sum(1)))
        self.centroids = fresh
        return moved

    def describe(self, typical: int = 5) -> DataFrame:
        """For each cluster: `cluster`, `size`, and the `typical` members nearest to its centroid as rows `place`, `id`, `cosine`."""
        dims, centroids = self.dims, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _blocks(batches, dims):
                near = x @ centroids.T
                best = near.argmax(1)
                cosine = near[np.arange(len(x)), best].astype(float)
                order = np.lexsort((ids, -cosine, best))
                begin = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) != 0]))
                size = np.diff(np.append(begin, len(order)))
                place = np.arange(len(order)) - np.repeat(begin, size)
                top = order[place < typical]
                n = np.where(place == 0, np.repeat(size, size), 0)[place < typical]
                yield pa.RecordBatch.from_pydict({"cluster": pa.array(best[top], pa.int32()), "n": pa.array(n, pa.int64()), "id": pa.array(ids[top]), "cosine": pa.array(cosine[top])})

        tops = self.blocks.mapInArrow(run, "cluster int, n bigint, id bigint, cosine double")
        by = Window.partitionBy("cluster")
        ranked = tops.select("cluster", F.sum("n").over(by).alias("size"), F.row_number().over(by.orderBy(F.desc("cosine"), "id")).alias("place"), "id", "cosine")
        return ranked.where(F.col("place") <= typical)


def _recluster(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ and a few Lloyd passes over the sample."""
    if len(x) <= k:
        return x.copy()
    picked = [int(weight.argmax())]
    far = 1 - x @ x[picked[0]]
    for _ in range(k - 1):
        p = np.maximum(far, 0) * weight
        total = p.sum()
        picked.append(int(np.searchsorted(np.cumsum(p), rng.random() * total)) if total > 0 else int(far.argmax()))
        picked[-1] = min(picked[-1], len(x) - 1)
        far = np.minimum(far, 1 - x @ x[picked[-1]])
    centres = x[picked].astype(np.float64)
    for _ in range(5):
        best = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x * weight[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-30), centres)
    return centres.astype(np.float32)


def _linked(x: np.ndarray, least: float) -> np.ndarray:
    """For each vector the first one of those it is joined with by links.

    Goes from vector to linked vectors that were not reached yet, so a vector is compared
    only with those still unreached: of a dense group, nearly all in the first step.
    """
    root = np.empty(len(x), np.int64)
    left, held = np.arange(len(x)), x
    while len(left):
        first, front = left[0], held[:1]
        root[first] = first
        left, held = left[1:], held[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), _ROWS):
                open_ = np.flatnonzero(~hit)
                hit[open_] = (front[at : at + _ROWS] @ (held if at == 0 else held[open_]).T >= least).any(0)
            if not hit.any():
                break
            root[left[hit]] = first
            front, left, held = held[hit], left[~hit], held[~hit]
    return root


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most `most` vectors that lie apart: the most central one, then always the one least like those taken."""
    if len(x) <= most:
        return np.arange(len(x))
    taken = [int((x @ x.mean(0)).argmax())]
    near = x @ x[taken[0]]
    for _ in range(most - 1):
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    return np.array(taken)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), "<f4").reshape(-1, dims)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), "<i8")


class LinkedClusters:
    """Clusters of linked vectors: two are linked if their cosine is at least `least`; a cluster is all vectors joined by links, directly or through others, if it has at least `members`.

    Vectors that `pack` leaves out are in no cluster. An id that comes twice is one member
    for each row. An empty table gives no rows. Other columns play no part.

    Method: k-means deals the vectors to cells; those of a cell (in parts of SIDE at most)
    are linked with each other directly. What is joined there is a part of a cluster; it
    has a centre and a radius (the largest angle from it). Parts of at most STANDING
    vectors are held by all their vectors, larger ones by STANDING that lie apart. All
    standing vectors are compared with each other, in squares of WIDE; that joins most of
    what belongs together. What is left is exact: a vector of a small part is compared
    with every vector of a larger part if the triangle inequality allows a link (its angle
    to the centre is at most the link's plus the radius), and so are two larger parts that
    are not joined yet. No link is missed; the work is at worst the square of the number
    of vectors outside larger parts.
    """

    def __init__(self, df: DataFrame, row_id: str = "chunk_id", vector: str = "emb", dims: int = 64, least: float = 0.8, members: int = 5) -> None:
        self.row_id, self.dims, self.least, self.members = row_id, dims, least, members
        self.blocks = cut(pack(df, row_id, vector, dims))
        # The cells only route: a few rounds are enough.
        self.model = KMeans(self.blocks, dims, rounds=2, passes=2)
        self.parts = cut(self._parts())
        self.root = self._joined()

    def _parts(self) -> DataFrame:
        """node (smallest id), n, ids, x of every part of a cluster; parts of one vector come packed, with a null node."""
        dims, least, centroids = self.dims, self.least, self.model.centroids

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _blocks(batches, dims):
                best = np.concatenate([(x[a : a + _ROWS] @ centroids.T).argmax(1) for a in range(0, len(x), _ROWS)])
                order = np.argsort(best, kind="stable")
                groups = np.split(order, np.flatnonzero(np.diff(best[order])) + 1)
                yield pa.RecordBatch.from_pydict({"cell": pa.array([int(best[g[0]]) for g in groups], pa.int32()), "ids": pa.array([ids[g].tobytes() for g in groups], pa.binary()), "x": pa.array([x[g].tobytes() for g in groups], pa.binary())})

        def link(cell: pa.Table) -> pa.Table:
            ids, x = _ids(cell.column("ids")), _vectors(cell.column("x"), dims)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            root = _linked(x, least)
            by = np.argsort(root, kind="stable")
            groups = np.split(by, np.flatnonzero(np.diff(root[by])) + 1)
            single = np.array([g[0] for g in groups if len(g) == 1], np.int64)
            groups = [g for g in groups if len(g) > 1] + ([single] if len(single) else [])
            nodes = [None if g is single else int(ids[g[0]]) for g in groups]
            return pa.table({"node": pa.array(nodes, pa.int64()), "n": pa.array([len(g) for g in groups], pa.int64()), "ids": pa.array([ids[g].tobytes() for g in groups], pa.binary()), "x": pa.array([x[g].tobytes() for g in groups], pa.binary())})

        dealt = cut(self.blocks.mapInArrow(deal, "cell int, ids binary, x binary"))
        sides = dealt.groupBy("cell").agg(F.ceil(F.sum(F.length("ids") / 8) / SIDE).cast("int").alias("sides"))
        sized = dealt.join(sides, "cell").withColumn("side", F.pmod(F.xxhash64("ids"), F.col("sides")).cast("int"))
        return sized.groupBy("cell", "side").applyInArrow(link, "node bigint, n bigint, ids binary, x binary")

    def _joined(self) -> DataFrame:
        """(node, root) of every part that belongs together with another."""
        dims, least = self.dims, self.least
        reach = float(np.arccos(np.clip(least, -1, 1)))

        def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # kind 0: a vector of a part held by all its vectors; 1: one that stands for a larger part; 2: a larger part's centre, with its radius.
            for batch in batches:
                for node, ids, x in zip(batch.column("node").to_pylist(), *(batch.column(c) for c in ("ids", "x")), strict=True):
                    ids, x = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), "<f4").reshape(-1, dims)
                    taken = x if node is None else x[_spread(x, STANDING)]
                    nodes = ids if node is None else np.full(len(taken), node)
                    kind, radius = np.full(len(taken), int(node is not None and len(x) > STANDING)), np.zeros(len(taken))
                    if node is not None and len(x) > STANDING:
                        centre = x.mean(0, dtype=np.float64)
                        centre = (centre / max(np.linalg.norm(centre), 1e-30)).astype(np.float32)
                        taken, nodes = np.concatenate([taken, centre[None]]), np.append(nodes, node)
                        kind, radius = np.append(kind, 2), np.append(radius, float(_angle((x @ centre).min())))
                    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "kind": pa.array(kind, pa.int32()), "radius": pa.array(radius), "v": pa.array([v.tobytes() for v in taken], pa.binary())})

        standing = cut(self.parts.mapInArrow(stand, "node bigint, kind int, radius double, v binary"))
        wide = max(LEAST_SIDES, math.ceil(standing.count() / WIDE))
        dealt = standing.withColumn("side", F.pmod(F.xxhash64("node", "v"), F.lit(wide)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
        squares = dealt.select(F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "node", "kind", "radius", "v")

        def compare(square: pa.Table) -> pa.Table:
            # Rows: (a, b) joined; (a, b, v) a vector of b that may be linked to the larger part a; (a, b, bound) larger parts that may be linked.
            sides = [square.filter(pc.equal(square.column("side"), square.column(c)[0])) for c in (("p", "q") if square.column("p")[0].as_py() != square.column("q")[0].as_py() else ("p",))]
            node, kind, radius = (np.concatenate([np.asarray(s.column(c)) for s in sides]) for c in ("node", "kind", "radius"))
            v = np.concatenate([_vectors(s.column("v"), dims) for s in sides])
            side = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
            names, code = np.unique(node, return_inverse=True)
            root = np.arange(len(names))
            points = [np.flatnonzero((kind < 2) & (side == k)) for k in range(len(sides))]
            root = _meet(v, code, points[0], points[-1], least, root)
            out: dict[str, list] = {c: [] for c in ("a", "b", "v", "bound")}

            def add(a: np.ndarray, b: np.ndarray, v_: list, bound: np.ndarray) -> None:
                for c, values in zip(out, (a.tolist(), b.tolist(), v_, bound.tolist()), strict=True):
                    out[c] += values

            joined = np.flatnonzero(root != np.arange(len(root)))
            add(names[joined], names[root[joined]], [None] * len(joined), np.full(len(joined), np.nan))
            large = np.flatnonzero(kind == 2)
            small = np.flatnonzero(kind == 0)
            for at in large.tolist():
                far = np.cos(min(np.pi, reach + radius[at] + _SLACK)) - 1e-5
                # Two sides meet: what one side holds meets the other side only; pairs within a side are another square's.
                met = small[side[small] != side[at]] if len(sides) > 1 else small
                near = met[v[met] @ v[at] >= far]
                near = near[root[code[near]] != root[code[at]]]
                add(np.full(len(near), node[at]), node[near], [x.tobytes() for x in v[near]], np.full(len(near), np.nan))
                others = large[(large > at) & ((side[large] != side[at]) | (len(sides) == 1))]
                others = others[(_angle(v[others] @ v[at]) <= reach + radius[at] + radius[others] + _SLACK) & (root[code[others]] != root[code[at]])]
                # The part with the larger radius is visited; its centre goes along.
                for o in others.tolist():
                    a, b = (at, o) if radius[at] >= radius[o] else (o, at)
                    add(node[[a]], node[[b]], [v[a].tobytes()], np.array([np.cos(min(np.pi, reach + radius[a] + _SLACK)) - 1e-5]))
            return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "v": pa.array(out["v"], pa.binary()), "bound": pa.array(out["bound"], pa.float64(), from_pandas=True)})

        met = cut(squares.groupBy("p", "q").applyInArrow(compare, "a bigint, b bigint, v binary, bound double"))
        links = met.where("v is null").select("a", "b")
        joined = components(links)
        roots = joined.select(F.col("node").alias("n"), "root")
        open_ = met.where("v is not null").join(roots.select(F.col("n").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("n").alias("b"), F.col("root").alias("rb")), "b", "left")
        open_ = cut(open_.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "v", "bound"))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, centre, bound, x in zip(*(batch.column(c) for c in ("a", "b", "v", "bound", "x")), strict=True):
                    x = np.frombuffer(x.as_buffer(), "<f4").reshape(-1, dims)
                    near = x[x @ np.frombuffer(centre.as_buffer(), "<f4") >= bound.as_py()]
                    yield pa.RecordBatch.from_pydict({"a": pa.array([a.as_py()] * len(near), pa.int64()), "b": pa.array([b.as_py()] * len(near), pa.int64()), "v": pa.array([v.tobytes() for v in near], pa.binary())})

        large = self.parts.where(F.col("n") > STANDING).select("node", "x")
        visitors = open_.where("bound is null").select("a", "b", "v").unionByName(open_.where("bound is not null").join(large.withColumnRenamed("node", "b"), "b").mapInArrow(visit, "a bigint, b bigint, v binary"))
        visitors = cut(visitors)
        tasks = visitors.groupBy("a").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("tasks"))
        going = visitors.join(tasks, "a").withColumn("task", F.pmod(F.xxhash64("v"), F.col("tasks")).cast("int"))
        hosts = large.join(tasks.withColumnRenamed("a", "node"), "node").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))

        def verify(key: tuple, guests: pa.Table, host: pa.Table) -> pa.Table:
            x, y = _vectors(guests.column("v"), dims), _vectors(host.column("x"), dims)
            near = np.zeros(len(x), bool)
            for at in range(0, len(x), _ROWS):
                near[at : at + _ROWS] = (x[at : at + _ROWS] @ y.T >= least).any(1)
            b = np.unique(np.asarray(guests.column("b"))[near])
            return pa.table({"a": pa.array(np.full(len(b), key[0].as_py(), np.int64)), "b": pa.array(b, pa.int64())})

        more = going.select("a", "task", "b", "v").groupBy("a", "task").cogroup(hosts.select(F.col("node").alias("a"), "task", "x").groupBy("a", "task")).applyInArrow(verify, "a bigint, b bigint")
        # The links so far as stars, so that the second time there is little to join.
        return cut(components(joined.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))

    def _clustered(self) -> DataFrame:
        """node, n, ids, x, root of the parts of clusters with enough members; packed single vectors are one row each."""
        dims = self.dims

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
                    ids, x = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), "<f4").reshape(-1, dims)
                    yield pa.RecordBatch.from_pydict({"node": pa.array(ids), "n": pa.array(np.ones(len(ids), np.int64)), "ids": pa.array([i.tobytes() for i in ids[:, None]], pa.binary()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

        schema = "node bigint, n bigint, ids binary, x binary"
        rows = self.parts.where("node is not null").unionByName(self.parts.where("node is null").mapInArrow(unpack, schema))
        rooted = rows.join(self.root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        large = rooted.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= self.members)
        return rooted.join(large, "root")

    def found(self) -> DataFrame:
        """The id and `cluster_id` (the cluster's smallest id) of every vector in a cluster."""

        def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False) // 8
                yield pa.RecordBatch.from_pydict({"id": pa.array(_ids(batch.column("ids"))), "cluster_id": pa.array(np.repeat(np.asarray(batch.column("root")), size))})

        return self._clustered().select("ids", "root").mapInArrow(ids_of, "id bigint, cluster_id bigint").withColumnRenamed("id", self.row_id)

    def described(self, typical: int = 5) -> DataFrame:
        """For each cluster: cluster_id, `size`, and its `typical` members nearest to its mean direction as rows `place`, id, `cosine` (six decimals; of equals the smaller id first)."""
        dims = self.dims
        clustered = cut(self._clustered())

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    total = [np.frombuffer(x.as_buffer(), "<f4").reshape(-1, dims).sum(0, dtype=np.float64) for x in batch.column("x")]
                    root = np.asarray(batch.column("root"))
                    order = np.argsort(root, kind="stable")
                    begin = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) != 0]))
                    yield pa.RecordBatch.from_pydict({"root": pa.array(root[order][begin]), "total": pa.array([t.tobytes() for t in np.add.reduceat(np.array(total)[order], begin)], pa.binary())})

        def mean(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(t.as_buffer()) for t in rows.column("total"))
            centre = total / max(np.linalg.norm(total), 1e-30)
            return pa.table({"root": rows.column("root")[:1], "centre": pa.array([centre.tobytes()], pa.binary())})

        centres = clustered.select("root", "x").mapInArrow(sums, "root bigint, total binary").groupBy("root").applyInArrow(mean, "root bigint, centre binary")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"cluster_id": [], "size": [], "id": [], "cosine": []}
                for root, size, ids, x, centre in zip(*(batch.column(c) for c in ("root", "size", "ids", "x", "centre")), strict=True):
                    ids, x = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), "<f4").reshape(-1, dims)
                    cosine = np.round(x.astype(np.float64) @ np.frombuffer(centre.as_buffer()), 6)
                    top = np.lexsort((ids, -cosine))[:typical]
                    for c, values in zip(out, ([root.as_py()] * len(top), [size.as_py()] * len(top), ids[top].tolist(), cosine[top].tolist()), strict=True):
                        out[c] += values
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.float64() if c == "cosine" else pa.int64()) for c, v in out.items()})

        near = clustered.select("root", "size", "ids", "x").join(centres, "root").mapInArrow(nearest, "cluster_id bigint, size bigint, id bigint, cosine double")
        ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), "id")))
        return ranked.where(F.col("place") <= typical).select("cluster_id", "size", "place", F.col("id").alias(self.row_id), "cosine")


def _meet(v: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, root: np.ndarray) -> np.ndarray:
    """`root` after joining the parts (by code) of all linked pairs of a left and a right vector."""
    for p in range(0, len(left), _ROWS):
        for q in range(0, len(right), SIDE):
            i, j = np.nonzero(v[left[p : p + _ROWS]] @ v[right[q : q + SIDE]].T >= least)
            a, b = root[code[left[i + p]]], root[code[right[j + q]]]
            apart = a != b
            if apart.any():
                pairs = np.unique(np.stack([a[apart], b[apart]]), axis=1)
                root = union(len(root), np.concatenate([np.arange(len(root)), pairs[0]]), np.concatenate([root, pairs[1]]))
    return root
