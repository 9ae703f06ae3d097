import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from newsloom.llm import term_counts

SCHEMA = "term string, Article string, df int"


def brute(texts, least, share):
    tf, df = Counter(), Counter()
    for t in texts:
        if t is None:
            continue
        t = re.sub(r"[^A-Za-z\s]", " ", re.sub(r"https?://\S+", " ", t)).lower()
        found = re.findall("[a-z]{3,}", t)
        tf.update(found)
        df.update(set(found))
    n = sum(t is not None for t in texts)
    return {w: (tf[w], df[w], "rare" if df[w] < least else "common" if df[w] > share * n else None) for w in tf}


def run(frame, texts, **kw):
    got = term_counts.term_counts(frame([("x", t, 1) for t in texts], SCHEMA), **kw).collect()
    assert len({r.term for r in got}) == len(got)
    return {r.term: (r.tf, r.df, r.mark) for r in got}


def test_heavy_terms_are_never_held_as_light_ones():
    texts = ["the cat sat", "The the dog", "cat", "", None, "abc", "def", "xthe"]
    arrays = np.zeros((2, 2), np.int64)
    names, tf, docs = term_counts.split_counts(pa.array(texts), pa.array([b"cat", b"the"], pa.large_binary()), arrays)
    assert arrays.tolist() == [[2, 3], [2, 2]]
    assert dict(zip(names.to_pylist(), zip(tf.tolist(), docs.tolist()))) == {b"sat": (1, 1), b"dog": (1, 1), b"abc": (1, 1), b"def": (1, 1), b"xthe": (1, 1)}
    # All terms heavy, or none.
    names, tf, _ = term_counts.split_counts(pa.array(["abc abc"]), pa.array([b"abc"], pa.large_binary()), np.zeros((2, 1), np.int64))
    assert not len(names) and not len(tf)
    names, tf, docs = term_counts.split_counts(pa.array(["abc abc"]), pa.array([], pa.large_binary()), np.zeros((2, 0), np.int64))
    assert (names.to_pylist(), tf.tolist(), docs.tolist()) == ([b"abc"], [2], [1])


def test_heavy_terms(frame):
    top, n = term_counts.heavy_terms(frame([(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(26)) + " often often" * 5,) for i in range(26)] + [("",)], "t string"), 2)
    assert b"often" in top and len(top) <= 2 and n == 27


def test_against_brute_force(frame):
    rng = random.Random(1)
    words = ["the", "Alpha", "beta", "KKelvin", "cafés", "x1yzz", "https://a.b/the?q", "http://u beta", "it's", "İstanbul"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(80)] + [None, "", " ", "the " * 50_000]
    texts += texts[:10]
    want = brute(texts, 4, 0.3)
    assert run(frame, texts, least_docs=4, most_share=0.3) == want
    assert run(frame, texts, least_docs=4, most_share=0.3, heavy=2) == want


def test_empty_and_null(frame):
    assert run(frame, []) == {}
    assert run(frame, [None, None]) == {}
    assert run(frame, ["abc"], least_docs=1, most_share=1.0) == {"abc": (1, 1, None)}
