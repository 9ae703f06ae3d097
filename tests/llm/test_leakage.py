import random
import re

from newsloom.llm import leakage

DOCS = "item_id string, doc_id bigint, text string, n_words int"
ITEMS = "doc_id int, item_id bigint, text string, task string"


def grams(text, n=12):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(frame):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta One two 3 four".split())
    items = [(k, " ".join(word() for _ in range(rng.randrange(5, 30)))) for k in range(12)] + [(50, None), (51, ""), (0, "repeated id with other words " * 4)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.randrange(40))]
        if d % 2:
            source = (items[rng.randrange(12)][1]).split()
            a = rng.randrange(len(source))
            body[len(body) // 2 : len(body) // 2] = source[a : a + rng.randrange(8, 25)]
        docs.append((d, ", ".join(body)))
    docs += [(90, None), (91, ""), (3, docs[3][1])]
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    a, b = frame([("x", d, t, 0) for d, t in docs], DOCS), frame([(1, i, t, "t") for i, t in items], ITEMS)
    assert {tuple(r) for r in leakage.leaked(leakage.leaks(a, b)).collect()} == want
    assert {tuple(r) for r in leakage.leaked(leakage.leaks(a, b, block_chars=200)).collect()} == want


def test_substituted_words_are_tolerated(frame):
    item = " ".join(f"w{i}" for i in range(40))
    text = "intro " + " ".join("other" if i in (13, 27) else f"w{i}" for i in range(40)) + " outro"
    got = leakage.leaks(frame([("", 1, text, 0)], DOCS), frame([(0, 7, item, "")], ITEMS)).collect()
    best = max(got, key=lambda r: r.n_words)
    assert (best.doc_id, best.item_id, best.doc_word, best.item_word, best.n_words, best.n_same) == (1, 7, 1, 0, 40, 38)


def test_empty_tables(frame):
    full = frame([("", 1, "a b c d e f g h i j k l m", 0)], DOCS)
    assert leakage.leaks(frame([], DOCS), frame([], ITEMS)).count() == 0
    assert leakage.leaked(leakage.leaks(full, frame([], ITEMS))).count() == 0
    assert leakage.leaked(leakage.leaks(frame([], DOCS), frame([(1, 1, "a " * 20, "")], ITEMS))).count() == 0
