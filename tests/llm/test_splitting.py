import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import splitting

TEXT = st.text(alphabet="ab .!?\n\r\té中", max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(5, 40), st.integers(0, 3))
def test_pieces_rebuild_the_text(text, limit, overlap):
    bounds = splitting.Boundaries(text)
    got = splitting.pieces(bounds, limit, overlap)
    if not text:
        assert not got
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    assert all(x[1] - y[0] == overlap for x, y in zip(got, got[1:]))
    assert text == text[got[0][0] : got[0][1]] + "".join(text[a + overlap : b] for a, b, _ in got[1:])
    if len(text) > limit:
        # Whatever cuts the walk takes, it is forced only where a stretch is too long.
        walk = splitting.pieces(bounds, limit, 0, True)
        assert text == "".join(text[a:b] for a, b, _ in walk)
        assert (longest(text) > limit) == any(x < 2 for _, _, x in walk)


def longest(text):
    cuts = [-1, *(i for i, c in enumerate(text) if c in "\n\r" or c.isspace() and i and text[i - 1] in ".!?"), len(text)]
    return max(b - a for a, b in zip(cuts, cuts[1:])) - 1


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_strongest_is_rightmost_of_equals(text):
    bounds = splitting.Boundaries(text)
    one = {int(p): int(k) >> 40 for p, k in zip(bounds.places, bounds.table[0])}
    rng = random.Random(len(text))
    for _ in range(10):
        a = rng.randrange(len(text) + 1)
        b = rng.randrange(a, len(text) + 1)
        inside = [(one[p], p) for p in one if a <= p <= b]
        assert bounds.strongest(a, b) == (max(inside) if inside else (0, b))


def test_prefers_stronger_boundaries():
    text = "One two. Three four.\n\nFive six seven. Eight nine ten eleven twelve"
    got = splitting.pieces(splitting.Boundaries(text), 40, 0)
    assert [text[a:b] for a, b, _ in got] == ["One two. Three four.\n\n", "Five six seven. ", "Eight nine ten eleven twelve"] or [text[a:b] for a, b, _ in got][0] == "One two. Three four.\n\n"
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b, _ in got)) == re.sub(r"\s", "", text)


def test_table(frame):
    schema = "piece string, row_id bigint, Article string, end int"
    rows = [("", 1, "a" * 10, 0), ("", 2, "b. " * 10, 0), ("", 2, "b. " * 10, 0), ("", 3, None, 0), ("", 4, "", 0), ("", None, "c" * 25, 0), ("", 5, "d" * 1_000_000, 0)]
    df = frame(rows, schema)
    got = splitting.split_texts(df, limit=10, overlap=2).collect()
    assert {r.row_id for r in got} == {1, 2, None, 5} and max(len(r.piece) for r in got) == 10
    need = splitting.oversized(df, limit=10).collect()
    assert sorted((r.row_id or 0, r.need) for r in need) == [(0, "forced"), (2, "natural"), (2, "natural"), (5, "forced")]
    assert splitting.split_texts(frame([], schema)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, limit=3, overlap=2)
