"""EM for LDA against a dense version, and the packed counts against the counts by row and term."""

import re
from math import lgamma
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import em_lda, models, text
from newsloom.plans import topic_queries

PACKED = "row_id bigint, ids array<int>, tfs array<int>"


def corpus(n=60, terms=12, seed=1):
    """Texts of two kinds, each mostly of one half of the terms, as rows of dense counts."""
    rng = np.random.default_rng(seed)
    p = np.full((2, terms), 0.02)
    p[0, : terms // 2] = p[1, terms // 2 :] = 1
    return np.array([rng.multinomial(rng.integers(20, 60), p[i % 2] / p[i % 2].sum()) for i in range(n)])


def rows_of(counts):
    return [(i, [int(j) for j in np.flatnonzero(c)], [int(x) for x in c[c > 0]]) for i, c in enumerate(counts)]


def dense(counts, k, seed, passes):
    """N_wk and shares by the formulas, one document after the other."""
    terms, alpha, eta = counts.shape[1], 50 / k + 1, 1.1
    n_wk, n_dk = np.zeros((k, terms)), []
    for i, ids, tfs in rows_of(counts):
        block = next(em_lda._cut_blocks([np.array([i]), np.array([True]), np.array([len(ids)]), np.array(ids), np.array(tfs)], terms))
        n_dk.append(em_lda._start(tuple(c[0].as_py() for c in block.columns), k, seed, n_wk)[:, 0])
    for _ in range(passes):
        a, new = (n_wk + eta - 1) / (n_wk.sum(1, keepdims=True) + terms * (eta - 1)), np.zeros_like(n_wk)
        for i, c in enumerate(counts):
            p = a * (n_dk[i] + alpha - 1)[:, None]
            p = p / p.sum(0) * c
            new += p
            n_dk[i] = p.sum(1)
        n_wk = new
    e = np.exp(em_lda.digamma(n_wk) - em_lda.digamma(n_wk.sum(1, keepdims=True)))
    shares = []
    for i, c in enumerate(counts):
        g = n_dk[i] + alpha
        for _ in range(500):
            w = np.exp(em_lda.digamma(g) - em_lda.digamma(g.sum()))
            g = alpha + w * (e * (c / (w @ e + 1e-100))).sum(1)
        shares.append(g / g.sum())
    return n_wk, np.array(shares)


def got(found, n, k):
    shares = np.full((n, k), np.nan)
    for r in found.collect():
        shares[r.row_id, r.topic] = r.theta
    return shares


@pytest.mark.parametrize("k", [2, 5])
def test_fit_is_that_of_the_formulas(frame, monkeypatch, k):
    counts = corpus()
    n_wk, shares = dense(counts, k, 7, 6)
    for documents in (20_000, 9):
        monkeypatch.setattr(em_lda, "DOCUMENTS", documents)
        phi, theta = em_lda.fit(frame(rows_of(counts), PACKED), 12, k, passes=6, least_change=1e-9)
        p = np.zeros((k, 12))
        for r in phi.collect():
            p[r.topic, r.term_id] = r.p
        assert np.allclose(p, n_wk / n_wk.sum(1, keepdims=True), atol=1e-9)
        assert np.allclose(got(theta, len(counts), k), shares, atol=1e-7)


def test_blocks_and_steps_of_any_size(monkeypatch):
    """The work of the tasks, done here, as the sizes are those of this process."""
    counts = corpus()
    sent = lambda x: SimpleNamespace(value=x)
    n_wk, shares = dense(counts, 3, 7, 1)
    rows = [x for r in rows_of(counts) for x in ((r[0], r[1][:2], r[2][:2]), (r[0], r[1][2:], r[2][2:]))]  # each in two
    for size in (1, 15, 40, 1 << 20):
        monkeypatch.setattr(em_lda, "BLOCK", size)
        monkeypatch.setattr(em_lda, "STEP", size)
        batches = (pa.RecordBatch.from_pydict({n: pa.array(x, t) for n, x, t in zip(("row_id", "ids", "tfs"), zip(*rows[i : i + 7]), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))}) for i in range(0, len(rows), 7))
        blocks = [tuple(c[0].as_py() for c in b.columns) for b in em_lda._blocks(batches, 12)]
        assert len(blocks) > (size < 100) * 10
        start = list(em_lda._run(((b, None) for b in blocks), lambda b, _, out: em_lda._start(b, 3, 7, out), (3, 12)))
        n = start[-1][1]
        assert all(x is None for _, x in start[:-1])
        after = list(em_lda._passed(sent((n + 0.1) / (n.sum(1, keepdims=True) + 1.2)), 50 / 3 + 1, (3, 12))(zip(blocks, start)))
        assert np.allclose(after[-1][1], n_wk)
        e = np.exp(em_lda.digamma(n_wk) - em_lda.digamma(n_wk.sum(1, keepdims=True)))
        found = [em_lda._inferred(sent(e), 50 / 3 + 1, 1e-9)(x) for x in zip(blocks, after)]
        assert np.concatenate([em_lda._read(bytes(x[0])) for x in found]).tolist() == list(range(len(counts)))
        assert np.allclose(np.concatenate([np.frombuffer(x[2]).reshape(-1, 3) for x in found]), shares, atol=1e-7)


def test_em_does_without_a_graph_and_however_the_rows_lie(spark, frame, monkeypatch):
    monkeypatch.delattr(models, "LDA")  # Spark's EM shuffles an edge for every cell in every pass
    counts = corpus()
    cells = [(i, j, int(x)) for i, c in enumerate(counts) for j, x in enumerate(c) if x]
    df = frame(cells, "row_id bigint, term_id int, tf bigint")
    first, second = (got(models.lda(d, 12, 2, "em")[1], len(counts), 2) for d in (df.repartition(3), df.orderBy(F.desc("term_id")).coalesce(1)))
    assert np.allclose(first, second, atol=1e-9) and np.allclose(first.sum(1), 1)
    assert len(set(first[::2].argmax(1))) == 1 and len(set(first[1::2].argmax(1))) == 1 and first[0].argmax() != first[1].argmax()


def test_rows_of_one_id_are_one_document(frame):
    whole = [(None, [0, 1, 2], [3, 1, 2]), (0, [1, 2], [5, 1]), (4, [0, 2], [2, 70_000])]
    apart = [(None, [0], [1]), (4, [2], [69_999]), (None, [0, 1, 2], [2, 1, 2]), (4, [0, 2], [2, 1]), (0, [1, 2], [5, 1]), (9, [], [])]
    a, b = ({(r.row_id, r.topic): r.theta for r in em_lda.fit(frame(x, PACKED), 3, 2, passes=4)[1].collect()} for x in (whole, apart))
    assert set(a) == {(i, t) for i in (None, 0, 4) for t in (0, 1)} and a == pytest.approx(b)


def test_no_documents(frame):
    phi, theta = em_lda.fit(frame([], PACKED), 4, 2)
    assert theta.collect() == [] and {r.p for r in phi.collect()} == {0.25}


def test_digamma():
    x = np.array([1e-3, 0.3, 1.0, 7.25, 1e6])
    h = 1e-5 * x
    assert np.allclose(em_lda.digamma(x), [(lgamma(a + b) - lgamma(a - b)) / (2 * b) for a, b in zip(x, h, strict=True)], rtol=1e-5)
    with np.errstate(divide="ignore"):
        assert em_lda.digamma(np.zeros(1))[0] == -np.inf


def test_packed_counts_are_the_term_counts(frame):
    rows = [
        (1, "Alpha beta alpha beta gamma. See https://alpha.com/beta gamma"), (2, None), (3, "no such, at all"), (4, "éalphaébeta ALPHA　Beta x beta"),
        (5, "gamma"), (1, "gamma alpha"), (None, "alpha beta"), (6, ""), (7, "beta http://x.y/alpha alpha://beta"), (8, "ab alpha ab beta alphabeta"),
    ]
    df = frame(rows, "row_id bigint, text string").repartition(3)
    for terms in (["alpha", "alpha beta", "beta alpha", "beta beta", "gamma", "see gamma"], ["alpha"], ["beta gamma"], []):
        vocab = frame(list(enumerate(terms)), "term_id int, term string")
        want = sorted(map(tuple, text.term_counts(df, vocab).collect()), key=str)
        packed = text.packed_counts(df, vocab)
        cells = packed.select("row_id", F.explode(F.arrays_zip("ids", "tfs")).alias("c")).groupBy("row_id", "c.ids").agg(F.sum("c.tfs")).collect()
        assert sorted(map(tuple, cells), key=str) == want


def test_texts_are_counted_in_slices_of_any_size(frame, monkeypatch):
    texts = ["alpha beta gamma " * i + "Eins zwei alpha the beta" * (i % 3) for i in range(20)] + [None, "", "to be", "the"]
    want = {}
    for t in texts:
        words = [w for w in re.findall("[a-z]{3,}", (t or "").lower()) if w != "the"]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        for x in terms:
            tf, df = want.get(x, (0, 0))
            want[x] = (tf + 1, df)
        for x in set(terms):
            want[x] = (want[x][0], want[x][1] + 1)
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(text, "_AT_ONCE", size)
        sums = {}
        for b in text._term_sums(iter([pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in (texts[:11], [], texts[11:])]), ("the",)):
            for term, tf, df in zip(*(c.to_pylist() for c in b.columns)):
                a, d = sums.get(term, (0, 0))
                sums[term] = (a + tf, d + df)
        assert sums == want
    top = text.vocabulary(frame(list(enumerate(texts)), "row_id bigint, text string").repartition(5), 1000, 1, 1.0, ("the",)).collect()
    assert {r.term: (r.tf, r.df) for r in top} == want and [r.term for r in sorted(top)] == sorted(want)


def test_query_lda_em_has_shares_for_every_text_with_terms(spark):
    folder = "/root/testdata/sf0.001"
    rows = topic_queries.lda_em(spark, folder).groupBy("row_id").agg(F.count("*").alias("n"), F.sum("theta").alias("s")).collect()
    base = topic_queries.base_of(spark, folder)
    assert {r.row_id for r in rows} == {r.row_id for r in base.counts.select("row_id").distinct().collect()}
    assert all(r.n == 8 and r.s == pytest.approx(1) for r in rows)
