from collections import Counter

import numpy as np
import pytest

from newsloom.llm import clusters, graph
from newsloom.session import cut

SCHEMA = "id string, chunk_id bigint, emb array<float>, cluster_id int"


def planted(seed=0, n=600, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = [centres[i % 6] + rng.normal(0, 0.04, dims) for i in range(n)] + list(rng.normal(size=(60, dims)))
    return np.array(x) * rng.uniform(0.5, 3, len(x))[:, None]


def brute(x, ids, least=0.8, members=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(u @ u.T >= least)
    root = np.array([min(ids)] * 0 + list(range(len(ids))))
    changed = True
    while changed:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        changed = (new != root).any()
        root = new
    size = Counter(root.tolist())
    return {(ids[i], ids[root[i]]) for i in range(len(ids)) if size[root[i]] >= members}


@pytest.mark.parametrize(("block", "side", "standing", "wide", "visitors"), [(5_000, 20_000, 16, 50_000, 50_000), (100, 60, 3, 50, 7), (50, 9, 2, 200, 50_000)])
def test_linked_clusters(frame, monkeypatch, block, side, standing, wide, visitors):
    for name, value in (("BLOCK", block), ("SIDE", side), ("STANDING", standing), ("WIDE", wide), ("VISITORS", visitors)):
        monkeypatch.setattr(clusters, name, value)
    x = planted()
    ids = list(range(10, 10 + len(x)))
    bad = [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 64), (904, [0.0] * 64), (None, [1.0] * 64), (905, [float("inf")] + [1.0] * 63)]
    df = frame([("", i, [float(v) for v in e] if e is not None else None, 0) for i, e in [*zip(ids, x.astype(np.float32)), *bad]], SCHEMA).repartition(3)
    got = {tuple(r) for r in clusters.LinkedClusters(df).found().collect()}
    want = brute(x.astype(np.float32).astype(float), ids)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    assert got == want


def test_links_to_members_that_stand_for_nothing(frame, monkeypatch):
    # Arms of one component, in one block; beyond each tip, in other blocks, a vector linked to that tip alone.
    unit = np.eye(64)
    arms = [np.cos(t) * unit[0] + np.sin(t) * unit[j] for t in (np.pi / 6, np.pi / 3) for j in range(1, 61)]
    x = np.array([unit[0], *arms, *unit[1:61]])
    monkeypatch.setattr(clusters, "BLOCK", 121)
    df = frame([("", i, [float(v) for v in e], 0) for i, e in enumerate(x)], SCHEMA).coalesce(1)
    assert {tuple(r) for r in clusters.LinkedClusters(df).found().collect()} == brute(x, list(range(len(x)))) == {(i, 0) for i in range(len(x))}


@pytest.mark.parametrize("seed", range(3))
def test_chains_across_parts(frame, monkeypatch, seed):
    # Long thin clusters, linked at few places, in parts that are hardly represented by the vectors that stand for them.
    for name, value in (("BLOCK", 64), ("SIDE", 40), ("STANDING", 2), ("LEAST_SIDES", 3)):
        monkeypatch.setattr(clusters, name, value)
    rng = np.random.default_rng(seed)
    x = []
    for _ in range(12):
        q = np.linalg.qr(rng.normal(size=(64, 4)))[0]
        for t in np.arange(0, rng.uniform(1, 6), 0.45 if rng.random() < 0.5 else 0.66):
            x.append(np.cos(t) * q[:, 0] + np.sin(t) * q[:, 1] + 0.02 * rng.normal(size=64) @ q @ q.T)
    x = np.array(x).astype(np.float32)
    x = x[rng.permutation(len(x))]
    df = frame([("", i, [float(v) for v in e], 0) for i, e in enumerate(x)], SCHEMA).repartition(4)
    assert {tuple(r) for r in clusters.LinkedClusters(df).found().collect()} == brute(x.astype(float), list(range(len(x))))


def test_described(frame):
    x = planted(4, 120)
    df = frame([("", i, [float(v) for v in e], 0) for i, e in enumerate(x)], SCHEMA)
    model = clusters.LinkedClusters(df)
    found = {r.chunk_id: r.cluster_id for r in model.found().collect()}
    got = model.described(3).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for c in set(found.values()):
        mine = sorted(i for i in found if found[i] == c)
        mean = u[mine].mean(0)
        cosine = u[mine] @ mean / np.linalg.norm(mean)
        want |= {(c, len(mine), k + 1, mine[j]) for k, j in enumerate(np.argsort(-cosine.round(6), kind="stable")[:3])}
    assert {(r.cluster_id, r["size"], r.place, r.chunk_id) for r in got} == want
    assert clusters.LinkedClusters(frame([], SCHEMA)).described().count() == 0


def test_kmeans_finds_planted_groups(frame):
    x = planted(1)
    df = frame([("", i, [float(v) for v in e], 0) for i, e in enumerate(x)], SCHEMA)
    model = clusters.KMeans(cut(clusters.pack(df)), k=10)
    rows = model.describe(3).collect()
    assert sum(r["size"] for r in rows if r.place == 1) == len(x)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    assert all(r.place <= 3 for r in rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = (u @ model.centroids.T).argmax(1)
    purity = sum(Counter(i % 6 for i in np.flatnonzero(best[:600] == c)).most_common(1)[0][1] for c in set(best[:600].tolist()))
    assert purity > 0.98 * 600


def test_empty_and_text(frame):
    assert clusters.LinkedClusters(frame([], SCHEMA)).found().count() == 0
    df = frame([(i, "alpha beta gamma" if i < 6 else f"word{i} other{i}") for i in range(9)] + [(20, None), (21, "")], "chunk_id bigint, emb string")
    assert {tuple(r) for r in clusters.LinkedClusters(df).found().collect()} == {(i, 0) for i in range(6)}


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(frame, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    edges = frame([(i, i + 1) for i in range(30, 70)] + [(1, 2), (2, 1), (5, 5)], "a bigint, b bigint").repartition(5)
    got = {tuple(r) for r in graph.components(edges).collect()}
    assert got == {(i, 30) for i in range(30, 71)} | {(1, 1), (2, 1)}
    assert graph.components(frame([], "a bigint, b bigint")).count() == 0
    assert graph.union(4, np.array([3, 1]), np.array([1, 0])).tolist() == [0, 0, 2, 0]
