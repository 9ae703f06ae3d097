import random

import numpy as np
import pytest

from newsloom.llm import site_lines

SCHEMA = "site string, row_id bigint, Url string, Article string, line_no int"


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60):
        ids = rng.integers(0, 3, n)
        order, shared = site_lines.suffix_array(ids)
        want = sorted(range(n), key=lambda i: ids[i:].tolist())
        assert order.tolist() == want
        for k in range(1, n):
            a, b = ids[want[k - 1] :], ids[want[k] :]
            m = min(len(a), len(b))
            assert shared[k] == (np.flatnonzero(a[:m] != b[:m]).tolist() + [m])[0]


def test_blocks_of_several_lines():
    rows = [np.array(r) for r in ([1, 5, 6, 7, 2], [5, 6, 7, 3], [4, 5, 6, 7], [5, 6, 7], [6, 8], [0, 9])]
    assert dict(site_lines.repeated_blocks(rows, 4)) == {(5, 6, 7): 4, (6,): 5}
    assert dict(site_lines.repeated_blocks(rows, 5)) == {(6,): 5}
    assert site_lines.repeated_blocks([], 1) == []
    assert site_lines.repeated_blocks([np.array([0, 0])], 1) == []


def plain_blocks(rows, least):
    """Every run of lines in at least `least` rows, and those the definition keeps."""
    spread = {}
    for r, row in enumerate(rows):
        ink = [x for x in row if x]
        for i in range(len(ink)):
            for j in range(i + 1, len(ink) + 1):
                spread.setdefault(tuple(ink[i:j]), set()).add(r)
    often = {b: len(s) for b, s in spread.items() if len(s) >= least}
    kept = set()
    for row in rows:
        ink = [x for x in row if x]
        length = [max((j - i for j in range(i + 1, len(ink) + 1) if tuple(ink[i:j]) in often), default=0) for i in range(len(ink))]
        kept |= {tuple(ink[i : i + n]) for i, n in enumerate(length) if n and (not i or length[i - 1] <= n)}
    return often, {b: often[b] for b in kept}


@pytest.mark.parametrize("seed", range(8))
def test_blocks_by_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, 4, rng.integers(0, 9)) for _ in range(25)]
    rows += rows[:3]
    for least in (1, 3, 8):
        often, kept = plain_blocks([r.tolist() for r in rows], least)
        assert dict(site_lines.repeated_blocks(rows, least)) == kept
        lines, _, levels = site_lines.common_prefixes(rows, least)
        every = {tuple(lines[p : p + k].tolist()): n for k, (places, counts) in enumerate(levels, 1) for p, n in zip(places.tolist(), counts.tolist())}
        assert every == often


def brute(rows):
    by = {}
    for r, (site, text) in enumerate(rows):
        if site and text is not None:
            by.setdefault(site, []).append((r, text.split("\n")))
    out = set()
    for docs in by.values():
        spread = {}
        for r, lines in docs:
            for x in {s.strip() for s in lines} - {""}:
                spread[x] = spread.get(x, 0) + 1
        often = {x for x, n in spread.items() if n >= 4 and n >= len(docs) / 10}
        out |= {(r, k) for r, lines in docs for k, s in enumerate(lines, 1) if s.strip() in often}
    return out


@pytest.mark.parametrize(("chunk", "broadcast", "bits"), [(20_000, 500_000, 1 << 27), (15, 500_000, 1 << 27), (20_000, 0, 1 << 16), (15, 2, 1 << 15)])
def test_against_brute_force(frame, monkeypatch, chunk, broadcast, bits):
    monkeypatch.setattr(site_lines, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(site_lines, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(site_lines, "MOST_BITS", bits)
    rng = random.Random(2)
    urls = {"http://www.A.example:80/x": "a.example", "https://a.example/y?z": "a.example", "HTTP://u@b.example": "b.example", "c.example/x": None, None: None, "n/a": None}
    rows = []
    for _ in range(160):
        lines = [rng.choice(["Share this ", " Legal notice", "", "  ", *(f"unique {rng.random()}" for _ in range(6)), "rare"]) for _ in range(rng.randrange(7))]
        rows.append((rng.choice(list(urls)), rng.choice([None, "\n".join(lines), "\n".join(lines), "\n".join(lines)])))
    df = frame([("x", i, u, t, 0) for i, (u, t) in enumerate(rows)], SCHEMA)
    want = brute([(urls[u], t) for u, t in rows])
    lines = site_lines.SiteLines(df)
    assert {tuple(r) for r in lines.found().collect()} == want
    clean = {r.row_id: r for r in lines.cleaned().collect()}
    assert len(clean) == len(rows)
    for i, (_, t) in enumerate(rows):
        kept = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n"), 1) if (i, k) not in want)
        assert clean[i].Article == kept


def texts_of_two_sites(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(140):
        lines = [f"unique {rng.random()}"]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(4)
            lines += ["a", "b", " c", "d", "e"][at : at + rng.randrange(1, 6)] + rng.choice([[], [""], [f"unique {rng.random()}"]])
        rows.append((rng.choice("xxxxy"), "\n".join(lines + ["few"] * (i % 20 == 0))))
    return rows


@pytest.mark.parametrize(("seed", "most"), [(0, 2_000_000), (1, 9)])
def test_blocks_are_those_of_whole_sites(frame, monkeypatch, seed, most):
    monkeypatch.setattr(site_lines, "CHUNK_ROWS", 15)
    monkeypatch.setattr(site_lines, "BROADCAST_KEYS", most)
    rows = texts_of_two_sites(seed)
    df = frame([("", i, f"http://{s}.example/{i}", t, 0) for i, (s, t) in enumerate(rows)], SCHEMA)
    want = []
    for s in "xy":
        texts = [[line.strip() for line in t.split("\n")] for x, t in rows if x == s]
        _, kept = plain_blocks(texts, max(4, -(-len(texts) // 10)))
        want += [(f"{s}.example", "\n".join(b), len(b), n, len(texts)) for b, n in kept.items()]
    for parts in (1, 3):
        got = [tuple(r) for r in site_lines.SiteLines(df.repartition(parts)).blocks().collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("chunk", "most"), [(20_000, 2_000_000), (15, 0)])
def test_blocks_of_two_lines_leave_single_lines(frame, monkeypatch, chunk, most):
    monkeypatch.setattr(site_lines, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(site_lines, "BROADCAST_KEYS", most)
    # "share" stands alone in many rows, and after "legal" in many: only the block goes.
    texts = [f"story {i}\n" + ("legal\n\n share \nlast" if i % 2 else f"share\nmiddle {i}\nlegal") for i in range(40)]
    lines = site_lines.SiteLines(frame([("", i, "http://x.example", t, 0) for i, t in enumerate(texts)], SCHEMA), size=2)
    clean = {r.row_id: (r.Article, r.n_removed) for r in lines.cleaned().collect()}
    assert clean[1] == ("story 1\n", 3) and clean[2] == ("story 2\nshare\nmiddle 2\nlegal", 0)
    assert {tuple(r) for r in lines.found().where("row_id = 1").collect()} == {(1, 2), (1, 4), (1, 5)}
    single = site_lines.SiteLines(frame([("", i, "http://x.example", t, 0) for i, t in enumerate(texts)], SCHEMA))
    assert {r.row_id: r.Article for r in single.cleaned().collect()}[2] == "story 2\nmiddle 2"


def test_empty(frame):
    assert site_lines.SiteLines(frame([], SCHEMA)).found().count() == 0
    assert site_lines.SiteLines(frame([("", 1, None, None, 0)], SCHEMA)).cleaned().count() == 1
