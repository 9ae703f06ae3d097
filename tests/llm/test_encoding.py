from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import encoding

HOME = Path("/opt/tokenizers")
pytestmark = pytest.mark.skipif(not HOME.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(HOME / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, encoding.Encoder(encoding.MergeReplay(*encoding.MergeReplay.of(encoding.load_ranks(str(HOME / "byte_bpe_50k.tiktoken"))).tables()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aab  \n\t'st.,1é中", max_size=60)), max_size=5))
def test_equal_to_the_tokenizer(both, texts):
    reference, encoder = both
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_long_words_and_forgetting(both, monkeypatch):
    reference, encoder = both
    monkeypatch.setattr(encoding, "_KEPT", 1)
    for text in ("a" * 20_000, "<|endoftext|> <|endoftext|>", "it's  we'll   x"):
        ids, _ = encoder.encode([text])
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_table(frame, both):
    schema = "ids string, doc_id bigint, text string"
    df = frame([("x", 1, "Hello world"), ("x", 2, None), ("x", 3, ""), ("x", 1, "Hello world"), ("x", None, " ")], schema)
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encoding.encode_texts(df, str(HOME / "byte_bpe_50k.tiktoken")).collect()))
    hello = both[0].encode("Hello world").ids
    assert got == [(0, [220]), (1, hello), (1, hello), (2, []), (3, [])]
    assert encoding.encode_texts(frame([], schema), str(HOME / "byte_bpe_50k.tiktoken")).count() == 0
