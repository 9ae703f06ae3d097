"""LDA by expectation maximisation, on blocks of documents held as numpy arrays.

The updates are those of Spark's EM optimizer: one joint step a pass for N_dk (document and
topic) and N_wk (term and topic), p(topic) of an occurrence being proportional to
(N_wk + eta - 1) (N_dk + alpha - 1) / (N_k + terms (eta - 1)). Instead of a graph with an edge
for each document and term that is shuffled in every pass, a pass sends N_wk (terms x topics)
to the tasks, and each task returns what it adds to the next N_wk; N_dk stays beside its block.
Shares of the documents are then inferred from the topics as by Spark's `transform`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import mix
from ..session import cut

#: Documents a partition is made for; cells (document and term) of a block, and of what is computed at once.
DOCUMENTS, BLOCK, STEP = 20_000, 1 << 20, 1 << 15
#: Cycles in which the inference of a document leaps ahead; it goes on without leaps after these.
LEAPS = 50
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = ("row_ids", "known", "lens", "ids", "tfs")


def fit(packed: DataFrame, terms: int, k: int, seed: int = 7, passes: int = 20, documents: int | None = None, least_change: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Topic-term table (topic, term_id, p) and document table (row_id, topic, theta), both distributions.

    `packed` has row_id, ids and tfs (arrays of equal length, tf > 0); rows of one row_id, null
    too, are one document; documents without terms have no shares. `documents` is about their
    number. The start depends on seed, row_id and term_id alone, not on how the rows lie.
    """
    if k < 1 or terms < 1:
        raise ValueError("k and terms must be positive")
    spark = packed.sparkSession
    context = spark.sparkContext
    if documents is None:
        packed = cut(packed)
        documents = packed.count()
    alpha, eta = 50.0 / k + 1, 1.1  # Spark's defaults for EM
    parts = max(context.defaultParallelism, -(-documents // DOCUMENTS))
    table = cut(packed.where(F.size("ids") > 0).select(F.col("row_id").cast("bigint").alias("row_id"), "ids", "tfs").repartition(parts, "row_id").sortWithinPartitions("row_id").mapInArrow(lambda b: _blocks(b, terms), ", ".join(f"{f} binary" for f in _FIELDS)))
    # One block an element in both, so that zip pairs them as they are.
    alone = BatchedSerializer(CPickleSerializer(), 1)
    kept = [table.rdd.map(lambda r: tuple(bytes(x) for x in r))._reserialize(alone).persist(StorageLevel.MEMORY_AND_DISK)]
    blocks, sent = kept[0], []

    def collected(state):  # noqa: ANN001, ANN202
        state = state._reserialize(alone).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(state)
        return state, state.map(lambda e: e[1]).filter(lambda x: x is not None).treeAggregate(np.zeros((k, terms)), np.add, np.add)

    try:
        state, n_wk = collected(blocks.mapPartitions(lambda it: _run(((b, None) for b in it), lambda b, _, out: _start(b, k, seed, out), (k, terms))))
        for _ in range(passes):
            sent.append(context.broadcast((n_wk + (eta - 1)) / (n_wk.sum(1, keepdims=True) + terms * (eta - 1))))
            state, n_wk = collected(blocks.zip(state).mapPartitions(_passed(sent[-1], alpha, (k, terms))))
            kept.pop(1).unpersist()
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):  # terms that do not occur
            sent.append(context.broadcast(np.nan_to_num(np.exp(digamma(n_wk) - digamma(n_wk.sum(1, keepdims=True))))))
        shares = blocks.zip(state).map(_inferred(sent[-1], alpha, least_change))
        done = cut(spark.createDataFrame(shares, "row_ids binary, known binary, shares binary", verifySchema=False))
    finally:
        for x in kept + sent:
            x.unpersist()
    total = n_wk.sum(1, keepdims=True)
    p = np.where(total > 0, n_wk / np.where(total > 0, total, 1), 1.0 / terms)
    phi = pa.table({"topic": np.repeat(np.arange(k, dtype=np.int32), terms), "term_id": np.tile(np.arange(terms, dtype=np.int32), k), "p": p.ravel()})
    return spark.createDataFrame(phi), done.mapInArrow(lambda b: _long(b, k), "row_id bigint, topic int, theta double")


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for x >= 0; -inf at 0."""
    y = np.asarray(x, float)
    less = np.zeros_like(y)
    for i in range(8):
        less += 1 / (y + i)
    y = y + 8
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - less


def _blocks(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK cells from rows sorted by row_id; rows of one row_id become one document."""
    held, cells = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ids, tfs = b.column(1), b.column(2)
        lens = np.diff(ids.offsets.to_numpy())
        rows = b.column(0)
        known = rows.is_valid().to_numpy(zero_copy_only=False)
        held.append((rows.fill_null(0).to_numpy(), known, lens, ids.flatten().to_numpy(), tfs.flatten().to_numpy()))
        cells += int(lens.sum())
        if cells >= BLOCK:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            # The last document may go on in the next batch.
            at = int(np.flatnonzero((whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]))[0])
            c = int(whole[2][:at].sum())
            if at:
                yield from _cut_blocks([x[:at] for x in whole[:3]] + [x[:c] for x in whole[3:]], terms)
            held = [tuple(x[at:] for x in whole[:3]) + tuple(x[c:] for x in whole[3:])]
            cells = len(held[0][3])
    if held:
        yield from _cut_blocks([np.concatenate(x) for x in zip(*held, strict=True)], terms)


def _cut_blocks(x: list[np.ndarray], terms: int) -> Iterator[pa.RecordBatch]:
    rows, known, lens, ids, tfs = x
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (known[1:] != known[:-1])
    if not fresh.all():
        cell = np.repeat(np.cumsum(fresh) - 1, lens) * terms + ids
        cell, where = np.unique(cell, return_inverse=True)
        tfs = np.bincount(where, tfs).astype(np.int64)
        rows, known, ids = rows[fresh], known[fresh], cell % terms
        lens = np.bincount(cell // terms, minlength=len(rows))
    ends = np.cumsum(lens)
    cuts = _cuts(ends, BLOCK)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        c = slice(int(ends[a - 1]) if a else 0, int(ends[z - 1]))
        made = (rows[a:z].astype(np.int64), known[a:z].astype(np.uint8), _small(lens[a:z]), _small(ids[c]), _small(tfs[c]))
        # The width of an item is told by a byte in front.
        yield pa.RecordBatch.from_arrays([pa.array([bytes([m.itemsize]) + m.tobytes()], pa.binary()) for m in made], names=list(_FIELDS))


def _cuts(ends: np.ndarray, most: int) -> np.ndarray:
    """Places between documents, about `most` cells apart."""
    inner = np.searchsorted(ends, np.arange(most, int(ends[-1]), most)) + 1
    return np.unique(np.concatenate([[0], inner, [len(ends)]]))


def _small(x: np.ndarray) -> np.ndarray:
    """As unsigned integers of as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max())))


def _read(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[x[0]], offset=1)


def _steps(block: tuple) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a few documents at once: which, lengths, ids, tfs."""
    lens, ids, tfs = (_read(x) for x in block[2:])
    ends = np.cumsum(lens, dtype=np.int64)
    cuts = _cuts(ends, STEP)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        c = slice(int(ends[a - 1]) if a else 0, int(ends[z - 1]))
        yield slice(int(a), int(z)), lens[a:z].astype(np.int64), ids[c].astype(np.int64), tfs[c].astype(float)


def _run(pairs: Iterator, one, shape: tuple[int, int]) -> Iterator[tuple]:  # noqa: ANN001
    """(N_dk, None) of each block; the last of a partition has what all its blocks add to N_wk."""
    out, last = np.zeros(shape), None
    for block, before in pairs:
        if last is not None:
            yield last, None
        last = one(block, before, out)
    if last is not None:
        yield last, out


def _add(p: np.ndarray, lens: np.ndarray, ids: np.ndarray, n_dk: np.ndarray, n_wk: np.ndarray) -> None:
    starts = np.cumsum(lens) - lens
    for t in range(len(p)):
        n_dk[t] = np.add.reduceat(p[t], starts)
        n_wk[t] += np.bincount(ids, p[t], n_wk.shape[1])


def _start(block: tuple, k: int, seed: int, n_wk: np.ndarray) -> np.ndarray:
    """N_dk from random shares of every cell."""
    rows = mix(_read(block[0]).astype(np.uint64) + np.full(1, seed, np.uint64) * _GOLD)
    n_dk = np.empty((k, len(rows)))
    for at, lens, ids, tfs in _steps(block):
        x = mix(np.repeat(rows[at], lens) + ids.astype(np.uint64) * _GOLD)
        p = np.concatenate([mix(x + np.full(1, j + 1, np.uint64) * _GOLD).view(np.uint16).reshape(-1, 4).T for j in range(-(-k // 4))])[:k] + 0.5
        p *= tfs / p.sum(0)
        _add(p, lens, ids, n_dk[:, at], n_wk)
    return n_dk


def _passed(weights, alpha: float, shape: tuple[int, int]):  # noqa: ANN001, ANN202
    """One EM pass over a partition of (block, (N_dk, ...))."""

    def one(block: tuple, before: tuple, n_wk: np.ndarray) -> np.ndarray:
        a, n_dk, room = weights.value, np.empty_like(before[0]), np.empty(0)
        for at, lens, ids, tfs in _steps(block):
            b = before[0][:, at] + (alpha - 1)
            if len(room) < len(a) * len(ids):
                room = np.empty(len(a) * len(ids))  # the same memory for all steps of a block
            p = room[: len(a) * len(ids)].reshape(len(a), -1)
            for t in range(len(a)):
                a[t].take(ids, out=p[t], mode="clip")
                p[t] *= np.repeat(b[t], lens)
            r = tfs / p.sum(0)
            for t in range(len(a)):
                p[t] *= r
            _add(p, lens, ids, n_dk[:, at], n_wk)
        return n_dk

    return lambda pairs: _run(pairs, one, shape)


def _inferred(weights, alpha: float, least_change: float):  # noqa: ANN001, ANN202
    """row_ids, known and shares of a block, the topics given: each document goes on until a step changes its parameters by at most `least_change` on average, from where EM left it.

    Two steps in a row tell where steps lead, and the next begins there (squared extrapolation, Varadhan and Roland
    2008), if that is a place that steps can reach at all. What ends it is always a plain step.
    """

    def one(pair: tuple) -> tuple[bytearray, bytearray, bytearray]:
        block, (n_dk, _) = pair
        e, gamma = weights.value, n_dk + alpha
        for at, lens, ids, tfs in _steps(block):
            now, left = gamma[:, at], np.arange(len(lens))
            g, x, before, turn = np.stack([row.take(ids) for row in e]), now.copy(), None, 0
            while len(left):
                w = np.exp(digamma(x) - digamma(x.sum(0)))
                s = np.full(len(tfs), 1e-100)
                for row, y in zip(g, w, strict=True):
                    s += row * np.repeat(y, lens)
                r, starts = tfs / s, np.cumsum(lens) - lens
                new = np.stack([np.add.reduceat(row * r, starts) for row in g]) * w + alpha
                on = np.abs(new - x).mean(0) > least_change
                now[:, left] = new
                if not on.all():
                    cells = np.repeat(on, lens)
                    left, lens, g, tfs, x, new = left[on], lens[on], g[:, cells], tfs[cells], x[:, on], new[:, on]
                    before = None if before is None else before[:, on]
                if before is None or turn > 2 * LEAPS:
                    x, before = new, x
                else:
                    d = x - before
                    v = new - x - d
                    far = np.maximum(1, np.sqrt((d * d).sum(0) / np.maximum((v * v).sum(0), 1e-300)))
                    leap = before + 2 * far * d + far * far * v
                    x, before = np.where(leap.min(0) >= alpha, leap, new), None
                turn += 1
            gamma[:, at] = now
        return bytearray(block[0]), bytearray(block[1]), bytearray((gamma / gamma.sum(0)).T.tobytes())

    return one


def _long(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, known, shares in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = pa.array(np.repeat(_read(rows), k), mask=np.repeat(_read(known) == 0, k))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(k, dtype=np.int32), len(ids) // k)), pa.array(np.frombuffer(shares))], names=["row_id", "topic", "theta"])
