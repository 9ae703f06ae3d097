import datetime as dt

import numpy as np
import pytest

from newsloom.operators import returns

D = dt.date


def test_monthly_counts_repeated_rows_and_total_loss(frame):
    rows = [(D(2020, 1, i), 1, 0.01) for i in range(1, 16)] + [(D(2020, 1, 1), 1, -1.0), (D(2020, 1, 2), 2, 0.1), (D(2020, 1, 3), 1, None), (D(2020, 1, 3), 1, float("nan"))]
    got = returns.monthly(frame(rows, "date date, id bigint, ret double")).collect()
    assert [(r.id, r.ret) for r in got] == [(1, -1.0)]


def test_forward_as_of(frame):
    theta = frame([(D(2020, 1, 4), 0, 0.2), (D(2020, 1, 6), 0, 0.4), (D(2020, 1, 9), 0, 0.9)], "date date, topic int, theta double")
    days = frame([(D(2020, 1, 3),), (D(2020, 1, 6),)], "date date")
    assert [tuple(r) for r in returns.to_trading_days(theta, days).collect()] == [(D(2020, 1, 6), 0, pytest.approx(0.3))]


def test_shocks_drop_five_rows(frame):
    rows = [(D(2020, 1, i), t, i * 0.01 * (t + 1)) for i in range(1, 11) for t in (0, 1)]
    got = returns.shocks(frame(rows, "date date, topic int, theta double")).orderBy("date", "topic").collect()
    assert len(got) == 10 and got[0].date == D(2020, 1, 6) and got[1].z == pytest.approx(0.06)


def test_covariance_against_formula(frame):
    rng = np.random.default_rng(1)
    days = [D(2020, 1, 1) + dt.timedelta(i) for i in range(200)]
    r, z = rng.normal(0, 0.02, (200, 3)), rng.normal(0, 0.01, (200, 2))
    seen = rng.random((200, 3)) > 0.15
    gone = [None, float("nan")]
    df = frame([(d, j, float(r[i, j]) if seen[i, j] else gone[i % 2]) for i, d in enumerate(days) for j in range(3)], "date date, id bigint, ret double")
    zs = frame([(d, t, float(z[i, t])) for i, d in enumerate(days) for t in range(2)], "date date, topic int, z double")
    got = returns.covariances(df, zs, (20, 60), 120, 60).collect()
    assert got
    for g in got:
        end = next(i for i, d in enumerate(days) if d == g.month)
        i = np.arange(max(0, end - 120), end)
        i = i[seen[i, g.id]]
        for h in (20, 60):
            w = 0.5 ** ((end - 1 - i) / h)
            w /= w.sum()
            a, b = r[i, g.id], z[i, g.topic]
            assert g[f"cov_{h}"] == pytest.approx((w * (a - (w * a).sum()) * (b - (w * b).sum())).sum(), abs=1e-12)


def test_covariances_over_many_stocks_and_blocks_of_topics(frame, monkeypatch):
    rng = np.random.default_rng(2)
    days = [D(2020, 1, 1) + dt.timedelta(i) for i in range(70)]
    r, z = rng.normal(0, 0.02, (70, 150)), rng.normal(0, 0.01, (70, 5))
    df = frame([(d, f"s{j}", float(r[i, j])) for i, d in enumerate(days) for j in range(150)], "date date, id string, ret double")
    zs = frame([(d, f"t{t}", float(z[i, t])) for i, d in enumerate(days) for t in range(5)], "date date, topic string, z double")
    whole = {(g.month, g.id, g.topic): g.cov_60 for g in returns.covariances(df, zs, (60,), 40, 20).collect()}
    assert len(whole) == 2 * 150 * 5
    monkeypatch.setattr(returns, "_SHOCKS", 140)
    again = {(g.month, g.id, g.topic): g.cov_60 for g in returns.covariances(df, zs, (60,), 40, 20).collect()}
    assert again == pytest.approx(whole, rel=1e-9, abs=1e-18)
    w = 0.5 ** (np.arange(31)[::-1] / 60)
    w /= w.sum()
    a, b = r[:31, 7], z[:31, 3]
    assert whole[D(2020, 2, 1), "s7", "t3"] == pytest.approx((w * a * b).sum() - (w * a).sum() * (w * b).sum(), abs=1e-14)


def test_covariances_of_nothing(frame):
    df, zs = frame([], "date date, id bigint, ret double"), frame([], "date date, topic int, z double")
    assert returns.covariances(df, zs).count() == 0
    assert returns.covariances(frame([(D(2020, 1, 1), 1, 0.1), (None, 1, 0.1), (D(2020, 1, 1), None, 0.2)], "date date, id bigint, ret double"), frame([(D(2020, 1, 1), 0, 0.1)], "date date, topic int, z double")).count() == 0


def test_validity_and_universe(frame):
    daily = frame([(D(2020, 6, 1), 1, 0.1, -5.0, 10.0), (D(2020, 6, 2), 1, 0.1, None, 10.0), (D(2020, 6, 1), 2, 0.1, 1.0, 10.0), (D(2020, 1, 1), 1, 0.2, 1.0, 1.0)], "date date, permno bigint, ret double, prc double, shrout double")
    names = frame([(1, "A", D(2020, 1, 1), D(2020, 3, 1), 11, 1), (1, "B", D(2020, 3, 2), D(2020, 12, 1), 11, 1)], "permno bigint, ticker string, namedt date, nameendt date, shrcd int, exchcd int")
    assert sorted(r.name_ticker for r in returns.valid_join(daily, names).collect()) == ["A", "B", "B"]
    top = returns.largest_by_year(daily, 1)
    assert [(r.permno, r.me) for r in top.collect()] == [(1, 50.0)]
    assert returns.of_universe(daily, top).count() == 3


def test_excess_needs_every_rate(frame):
    df = frame([(D(2020, 1, 1), 1, 0.1), (D(2020, 1, 2), 1, 0.1)], "date date, id bigint, ret double")
    rate = frame([(D(2020, 1, 1), 0.01)], "date date, rf double")
    with pytest.raises(Exception, match="risk-free"):
        returns.excess(df, rate).collect()
