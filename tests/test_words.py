import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.functions import hashing, words


def plain(text):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 -é中\n", max_size=40)), max_size=8))
def test_words_are_those_of_a_regex(texts):
    w = words.words(pa.array(texts, pa.string()))
    data, _ = words.buffers(pa.array(texts, pa.string()))
    got = [(int(t), bytes(data[s:e]).decode().lower()) for t, s, e in zip(w.text, w.start, w.end, strict=True)]
    assert got == [(i, x) for i, t in enumerate(texts) for x in plain(t or "")]


def test_equal_words_have_equal_hashes_across_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 16)
    texts = ["the cat sat on the mat " * 5, "x" * 50 + " the", None, "", "the"]
    w = words.words(pa.array(texts))
    names = [x for t in texts for x in plain(t or "")]
    by = {}
    for n, h in zip(names, w.hash.tolist(), strict=True):
        assert by.setdefault(n, h) == h
    assert len(set(by.values())) == len(by)


def test_shingles_stay_within_a_text():
    w = words.words(pa.array(["a b c d", "a b", "a b c"]))
    h, text, first = words.shingles(w, 3)
    assert text.tolist() == [0, 0, 2]
    assert h[0] == h[2] != h[1]


def test_distinct():
    assert words.distinct(np.array([3, 1, 3, 2])).tolist() == [1, 2, 3]
    assert words.distinct(np.array([], int)).tolist() == []


def test_hashed_features_are_unit_or_zero():
    x = hashing.hashed_features(pa.array(["one two two", None, "...", "one two two"]))
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 0, 1])
    assert np.array_equal(x[0], x[3])
