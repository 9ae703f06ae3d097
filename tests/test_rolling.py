import datetime as dt
import random

import pytest

from newsloom.operators import rolling

SCHEMA = "permno bigint, date date, ret double, loaded_at timestamp, day string, total_7 int"


def brute(rows, spans, least=-1.0):
    newest = {}
    for p, d, r, v, *_ in rows:
        if p is None or d is None:
            continue
        r = None if r is None or r != r else r
        key = (v is not None, v or dt.datetime.min, r is not None, r or 0.0)
        if (p, d) not in newest or key > newest[p, d][0]:
            newest[p, d] = key, r
    out = {}
    for p in {p for p, _ in newest}:
        days = [d for q, d in newest if q == p]
        day, first = min(days), min(days)
        while day <= max(days):
            row = []
            for w in spans:
                xs = [newest[p, day - dt.timedelta(i)][1] for i in range(w) if (p, day - dt.timedelta(i)) in newest]
                xs = [x for x in xs if x is not None and x >= least]
                row += [round(sum(xs), 6) + 0.0, len(xs), round(sum(xs) / min(w, (day - first).days + 1), 8)]
            out[p, day] = row
            day += dt.timedelta(1)
    return out


def check(frame, rows, spans=(7, 30)):
    got = rolling.rolling_totals(frame(rows, SCHEMA), spans=spans).collect()
    want = brute(rows, spans)
    assert {(r.permno, r[1]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert list(r)[2:] == pytest.approx(want[r.permno, r[1]], abs=2e-6)


def test_against_brute_force(frame):
    rng = random.Random(3)
    rows = []
    for p in (1, 2, None):
        for _ in range(120):
            d = dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(150)) if rng.random() > 0.05 else None
            rows.append((p, d, rng.choice([None, float("nan"), -66.0, round(rng.gauss(0, 0.1), 6)]), dt.datetime(2020, 9, 1, rng.randrange(3)) if rng.random() > 0.1 else None, "x", 1))
    check(frame, rows + rows[:40])
    check(frame, rows, (1, 2, 5))


def test_empty_single_and_ties(frame):
    check(frame, [])
    check(frame, [(1, dt.date(2020, 1, 1), 0.5, None, None, None)] * 3)
    t = dt.datetime(2020, 1, 2)
    check(frame, [(1, dt.date(2020, 1, 1), None, t, "", 0), (1, dt.date(2020, 1, 1), 0.25, t, "", 0), (1, dt.date(2020, 1, 1), 0.9, None, "", 0)])


def test_below_reports_each_span(frame):
    rows = [(1, dt.date(2020, 1, i), -0.1, dt.datetime(2020, 2, 1), "", 0) for i in range(1, 5)]
    got = rolling.below(rolling.rolling_totals(frame(rows, SCHEMA)), {7: -0.2, 30: -0.35}).collect()
    assert sorted((r.permno, r.day, r.span) for r in got) == [(1, "2020-01-03", 7), (1, "2020-01-04", 7), (1, "2020-01-04", 30)]
