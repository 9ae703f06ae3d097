import random
import re
from itertools import combinations

import numpy as np
import pytest

from newsloom.llm import near_duplicates

SCHEMA = "id string, row_id bigint, Article_title string, Article string, rep int"


def words(text):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(rows, k=3, share=0.5, least=40):
    sets = {}
    for i, title, text in rows:
        if i is not None and text is not None and len(w := words((title or "") + " " + text)) >= least:
            sets[i] = set(zip(*(w[j:] for j in range(k))))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}, sets


def make(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6 and (base := rng.choice(rows)[2]):
            w = base.split()
            for _ in range(rng.randrange(14)):
                p = rng.randrange(len(w)) if w else 0
                if rng.random() < 0.5:
                    w[p:p] = [rng.choice(vocab)]
                else:
                    w[p : p + rng.randrange(1, 9)] = []
            text = " ".join(w)
        else:
            text = " ".join(rng.choices(vocab, k=rng.randrange(20, 140)))
        rows.append((i, rng.choice([None, "Some Title"]), text))
    rows += [(200, None, None), (201, "t", ""), (202, None, "w " * 100), (203, None, "w " * 300), (None, None, "x " * 90), (0, *rows[0][1:])]
    return rows + [(300 + j, rows[1][1], rows[1][2].upper()) for j in range(3)]


@pytest.mark.parametrize(("seed", "part", "hot"), [(0, 1_000_000, 20_000), (1, 20, 20_000), (2, 20, 7)])
def test_against_brute_force(frame, monkeypatch, seed, part, hot):
    monkeypatch.setattr(near_duplicates, "PART_SETS", part)
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    monkeypatch.setattr(near_duplicates, "_EVENTS", 50)
    rows = make(seed)
    want, sets = brute(rows)
    assert len(want) > 10
    nd = near_duplicates.NearDuplicates(frame([("x", *r, 1) for r in rows], SCHEMA))
    got = [tuple(r) for r in nd.expanded().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.row_id: r.group_id for r in nd.groups().collect()}
    assert set(groups) == set(sets)
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert groups == root


def test_five_word_shingles_at_four_fifths(frame):
    rows = make(4)
    want, _ = brute(rows, 5, 0.8)
    nd = near_duplicates.NearDuplicates(frame([("x", *r, 1) for r in rows], SCHEMA), k=5, share=0.8)
    assert {tuple(r) for r in nd.expanded().collect()} == want


def test_packed_columns():
    columns = [np.arange(5, dtype="<u8") << np.uint64(33), np.zeros(0, "<u4"), np.array([7, 2**32 - 1], "<u4")]
    for a, b in zip(columns, near_duplicates._unpack(near_duplicates._pack(*columns)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_prefixes_lose_no_pair_whatever_the_order():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 52, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 120), replace=False), rng.integers(1, 1 << 52, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[: -rng.integers(1, 1 + len(s) // 2)], rng.integers(1, 1 << 52, rng.integers(0, 9), dtype=np.uint64)])) for s in sets[:60]]
    sign = np.arange(1, 1 + len(sets), dtype=np.uint64)
    size, tokens = np.array([len(s) for s in sets]), np.concatenate(sets)
    want = {(i + 1, j + 1) for i, j in combinations(range(len(sets)), 2) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
    assert len(want) > 30
    bits = 18
    level_of = near_duplicates._levels(np.bincount(near_duplicates._cells(tokens, bits), minlength=1 << bits))
    for levels in (level_of, np.full(1 << bits, 9, np.uint8)):
        for subs in (1, 7):
            held = {}
            for part, packed in near_duplicates.Postings(sign, size, tokens, levels, bits, 0.5).records(subs):
                held.setdefault(part, []).append(packed)
            met, over = set(), {}
            for part, h in held.items():
                for x, y, more, classes in zip(*(v.tolist() for v in near_duplicates.Part(h).pairs(0.5))):
                    met.add((min(x, y), max(x, y)))
                    over.setdefault((min(x, y), max(x, y)), {})[part // subs] = (more, classes)
            assert want <= met
            for p in want:  # what is lacking elsewhere is never counted too high
                assert sum(m for m, _ in over[p].values()) + 1e-4 >= (min(c for _, c in over[p].values()) - len(over[p])) * near_duplicates.least_lack(0.5)


def test_empty_and_long(frame):
    assert near_duplicates.NearDuplicates(frame([], SCHEMA)).expanded().count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    df = frame([("", 1, None, long, 0), ("", 2, None, long + " end", 0)], SCHEMA)
    assert [tuple(r) for r in near_duplicates.NearDuplicates(df).expanded().collect()] == [(1, 2)]
