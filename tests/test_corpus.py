import random

import pytest

from newsloom.operators import corpus, text

RAW = "row_id bigint, Date string, Article_title string, Stock_symbol string, Url string, Article string, body int"


def test_raw_filter(frame):
    rows = [(1, "2020-01-01 00:00:00 UTC", "t", "ABC", "u", "x", 0), (2, None, "t", "ABC", "u", "x", 0), (3, "2020-01-01", "t", "abc", "u", "x", 0), (4, "2020-01-01", None, "A.B", None, "x", 0), (5, "01/01/2020", "t", "A", "u", "x", 0), (6, "2030-01-01", "t", "A", "u", "x", 0), (7, "2020-01-01", "t", "NA", "u", "x", 0), (8, "2020-01-01", "t", "A", "u", "null", 0), (9, "2020-01-01", "t", "A", "u", "x" * 5000, 0)]
    got = {r.row_id: r for r in corpus.raw_filter(frame(rows, RAW)).collect()}
    assert set(got) == {1, 4, 9} and len(got[9].body) == 5000
    assert corpus.raw_filter(frame([], RAW)).count() == 0


def greedy(rows):
    urls, titles, kept = set(), set(), []
    for o, u, d, t in sorted(rows):
        u, t = u or "", f"{d}|{t or ''}"
        if u not in urls and t not in titles:
            urls.add(u)
            titles.add(t)
            kept.append(o)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedupe_equals_a_walk(frame, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *"abcdefgh"]), "d", rng.choice([None, *"stuvwxyz"])) for i in range(40)]
    df = frame(rows, "row_id bigint, url string, date string, title string")
    assert sorted(r.row_id for r in corpus.greedy_dedupe(df).collect()) == greedy(rows)


def test_greedy_dedupe_chain(frame):
    df = frame([(1, "a", "d", "x"), (2, "b", "d", "x"), (3, "b", "d", "y")], "row_id bigint, url string, date string, title string")
    assert sorted(r.row_id for r in corpus.greedy_dedupe(df).collect()) == [1, 3]
    assert corpus.greedy_dedupe(df.limit(0)).count() == 0


def test_clean_and_terms(frame):
    df = frame([(1, "See https://x.y/z Now: THE cat's mat"), (2, None), (3, "")], "row_id bigint, text string")
    got = {r.row_id: r.c for r in df.select("row_id", text.clean("text").alias("c")).collect()}
    assert got == {1: "see now the cat s mat", 2: "", 3: ""}
    terms = {r.row_id: r.terms for r in text.terms_of(df).collect()}
    assert terms == {1: ["cat", "mat", "cat mat"], 2: [], 3: []}  # "see" is a stop word too
    terms = {r.row_id: r.terms for r in text.terms_of(df, ("now", "the")).collect()}
    assert terms == {1: ["see", "cat", "mat", "see cat", "cat mat"], 2: [], 3: []}


def test_vocabulary_bridges_stop_words_but_counts_do_not(frame):
    df = frame([(i, "red the fox") for i in range(3)] + [(9, "blue")], "row_id bigint, text string")
    vocab = text.vocabulary(df, 10, 2, 0.9)
    assert [r.term for r in vocab.orderBy("term_id").collect()] == ["fox", "red", "red fox"]
    counts = text.term_counts(df, vocab)
    assert {r.term_id for r in counts.collect()} == {0, 1}
    assert {r.row_id: r.n_tokens for r in text.token_totals(df, counts).collect()}[9] == 0


def test_passages(frame):
    long = " ".join(f"w{i}" for i in range(25))
    df = frame([(1, f"short\n{long}\n\n"), (2, "one two"), (3, "a b c d e f g h i"), (4, "")], "row_id bigint, text string")
    got = [(r.row_id, r.piece, int(r.weight)) for r in text.passages(df, 10).orderBy("row_id", "piece").collect()]
    assert got == [(1, 1, 10), (1, 2, 10), (3, 1, 9)]
    assert text.passages(df, 10, first=1).count() == 2
