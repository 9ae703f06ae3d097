import datetime as dt

import numpy as np
import pytest

from newsloom.operators import quality, topics


def test_sparsify_toy(frame):
    theta = [[0.70, 0.20, 0.10], [0.40, 0.35, 0.25], [0.90, 0.06, 0.04], [0.50, 0.30, 0.20]]
    df = frame([(d, t, x) for d, row in enumerate(theta) for t, x in enumerate(row)], "doc bigint, topic int, theta double")
    got = np.zeros((4, 3))
    for r in topics.sparsify(df, 2, 2.0).collect():
        got[r.doc, r.topic] = r.weight
    assert (got[[1, 3]] == 0).all() and (np.count_nonzero(got, axis=1) <= 2).all()
    assert got[0, 0] == pytest.approx(0.49 / 0.53 * 0.5)


def test_ctfidf_keeps_zero_cells(frame):
    counts = frame([(0, 0, 10), (0, 2, 1), (1, 1, 10), (1, 2, 1), (2, 0, 6), (2, 1, 4)], "row_id bigint, term_id int, tf bigint")
    members = frame([(0, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0)], "doc bigint, topic int, weight double")
    terms = frame([(0,), (1,), (2,), (3,)], "term_id int")
    m = np.array([[17.0, 5, 2, 1], [1, 11, 2, 1]])
    w = m * np.log1p(m.sum() / 2 / m.sum(0))
    want = w / w.sum(1, keepdims=True)
    got = {(r.topic, r.term_id): r.p for r in topics.ctfidf(counts, members, terms, [0, 1]).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(2) for j in range(4)})


def test_soft_assign_and_weights(frame):
    c = frame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, centroid array<double>")
    v = frame([(1, 7, 2.0, [3.0, 0.0]), (2, 7, 1.0, [0.0, 1.0])], "id bigint, doc bigint, w double, v array<float>")
    docs = frame([(7,), (8,)], "doc bigint")
    got = {(r.doc, r.topic): r.theta for r in topics.document_weights(docs, topics.soft_assign(v, c, 1.0), [0, 1]).collect()}
    e = np.exp(1) / (np.exp(1) + 1)
    assert got == pytest.approx({(7, 0): (2 * e + 1 - e) / 3, (7, 1): (2 - 2 * e + e) / 3, (8, 0): 0.5, (8, 1): 0.5})
    assert [(r.topic, r.place, r.id) for r in topics.representatives(v, c, 1).orderBy("topic").collect()] == [(0, 1, 1), (1, 1, 2)]
    with pytest.raises(ValueError):
        topics.soft_assign(v, c, 0)


def test_hard_topic_takes_the_first_of_equals(frame):
    df = frame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.2), (2, 1, 0.8)], "doc bigint, topic int, theta double")
    assert {r.doc: r.topic for r in topics.hard_topic(df).collect()} == {1: 0, 2: 1}


def test_npmi_keeps_pairs_that_never_meet(frame):
    tops = frame([(0, 0), (0, 1), (1, 0), (1, 2)], "topic int, term_id int")
    counts = frame([(d, t, 1) for d in range(4) for t in (0, 1)] + [(4, 2, 1)], "row_id bigint, term_id int, tf bigint")
    got = {r.topic: r.npmi for r in quality.npmi(tops, counts, 8).collect()}
    never = np.log(1e-12 / (4 / 8 * 1 / 8)) / -np.log(1e-12)
    assert got == pytest.approx({0: 1, 1: never}, abs=1e-6)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(20):
        cost = rng.random((5, 5))
        got = quality.assignment(cost)
        assert cost[range(5), got].sum() == pytest.approx(min(cost[range(5), list(p)].sum() for p in permutations(range(5))))


def test_contract(frame):
    theta = frame([(dt.date(2020, 1, 1), 0, 0.5), (dt.date(2020, 1, 1), 1, 0.6), (dt.date(2020, 1, 2), 0, -0.5)], "date date, topic int, theta double")
    phi = frame([(0, 0, 1.0)], "topic int, term_id int, p double")
    assert {r.check: r.broken for r in topics.contract(theta, phi).collect()} == {"theta_negative": 1, "theta_simplex": 2, "phi_simplex": 0}
