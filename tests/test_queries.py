"""Queries on small folders of their own."""

import inspect
from itertools import product

import pytest

from newsloom.plans import corpus_queries, pricing_queries, topic_queries

RAW = "row_id bigint, Date string, Article_title string, Stock_symbol string, Url string, Article string"


@pytest.fixture
def folder(frame, tmp_path):
    """A folder whose download_fnspid has the given articles."""

    def made(articles):
        rows = [(i, "2020-01-01", "t", "ABC", f"u{i}", a) for i, a in enumerate(articles)]
        frame(rows, RAW).write.parquet(f"{tmp_path}/download_fnspid.parquet")
        return str(tmp_path)

    return made


def test_vocabulary_holds_the_references_15000_terms(spark, folder):
    words = ["q" + "".join(x) for x in product("bdfgjklmnprtvz", repeat=4)][: 3 * 3_000]
    groups = [words[i::3] for i in range(3)]
    # Every word and pair stands in 10 of 30 texts: about 18,000 terms fit.
    path = folder([" ".join(groups[i % 3]) for i in range(30)])
    vocab = corpus_queries.vocabulary(spark, path).toPandas()
    assert len(vocab) == 15_000 and set(vocab.df) == {10}
    assert sum(r.n_tokens for r in corpus_queries.token_totals(spark, path).collect()) == 10 * 15_000


def test_hashed_passages_are_all_passages(spark, folder):
    path = folder(["\n".join(f"paragraph {k} of text {i} with words enough to count as one passage" for k in range(7)) for i in range(2)])
    key = ("row_id", "piece", "weight")
    got = topic_queries.hashed_passages(spark, path).select(*key, "v").collect()
    assert sorted(r[:3] for r in got) == sorted(tuple(r) for r in corpus_queries.passages(spark, path).select(*key).collect())
    assert len(got) == 2 * 7 and all(len(r.v) == 64 and abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in got)


def test_factor_queries_have_three_factors_and_twelve_penalties(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(pricing_queries, "_moments", lambda *_: None)
    for name in ("tune", "out_of_sample", "fit"):
        real = inspect.signature(getattr(pricing_queries.ipca, name))

        def spy(*args, name=name, real=real, **kw):
            bound = real.bind(*args, **kw)
            bound.apply_defaults()
            asked[name] = bound.arguments
            raise LookupError

        monkeypatch.setattr(pricing_queries.ipca, name, spy)
    for query in (pricing_queries.lambda_path, pricing_queries.oos_portfolio, pricing_queries.ipca_fit):
        with pytest.raises(LookupError):
            query(spark, "")
    assert [asked[n]["k"] for n in ("tune", "out_of_sample", "fit")] == [3, 3, 3]
    assert [asked[n]["n_lams"] for n in ("tune", "out_of_sample")] == [12, 12]


def test_parts_are_kept_while_the_files_stay_the_same(spark, frame, tmp_path):
    def write(n):
        frame([(i, "2020-01-01", "t", "ABC", f"u{i}", "words of an article " * 30) for i in range(n)], RAW).write.mode("overwrite").parquet(f"{tmp_path}/download_fnspid.parquet")

    for name in topic_queries._TABLES[1:]:
        frame([(1,)], "x int").write.parquet(f"{tmp_path}/{name}.parquet")
    write(3)
    first = topic_queries.base_of(spark, str(tmp_path))
    assert topic_queries.base_of(spark, str(tmp_path)) is first and first.articles.count() == 3
    write(5)
    assert topic_queries.base_of(spark, str(tmp_path)).articles.count() == 5
