import random

import pytest

from newsloom.llm import truncation

SCHEMA = "cut string, doc_id bigint, text string, source string, kind int"

KNOWN = frozenset(k for line in ["Reporting by C D; editing by E F", "-0- 12/31 23:59", "Full notes: https://b.example/1", "Related: One thing", "XYZ\t9.10\t+0.25%", "— Some Name, Some Place", "More to follow"] for k in truncation.closing_keys(line) if k)
WHOLE = ["A full sentence.", 'He said: "Enough."', "Was it so? (It was.)", "完整的句子。", "A sentence.\nReporting by A B; editing by C D", "A sentence.</p>", "A sentence.\n-0- 05/01 04:54", "A sentence.\nFull notes: https://a.example/n/12345", "A sentence.\nABCQ\t190.59\t+5.75%", "X\t1.50\t+0.25\nY\t2.50\t-0.75", "A 1.50 +0.25% | B 2.50 -0.75% | C 3.50 +1.25%", "In 2016 we came. He left in 2016.", "A sentence.\nMore to follow...", "A sentence.\nRelated: Why it fell (again)", "A sentence.\nhttps://a.example/x?y"]
CUT = ["A sentence. Then the plan", "A sentence. Then the pl\n— A Name, Place", "A sentence. It rose 33.", "A sentence. It was worth $1…", "A sentence. It was [+120 chars]", "A sentence. Then </p>", "X\t1.50\t+0.25\nY\t2.50\t-0.", "A 1.50 +0.25% | B 2.50 -0.75% | C 3.5", "句子。然后公司", "A sentence. One b�", "A sentence. Then the\nMore to follow..."]


def ended(text):
    return truncation.ending(*truncation.strip_marks(text, KNOWN), KNOWN)


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert ended(text).kind in ("stop", "row") or ended(text).kind == "figure" and ended(text).last == "Y."


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert ended(text).kind in ("open", "figure")


def test_templates():
    same = [("Reporting by Ann Lee; editing by Bo", "Reporting by C D E; editing by F G"), ("(END)", "(END)"), ("— A B, C", "— Dee, Eff Gee"), ("#one #Two", "#three #four"), ("X.A\t1.5\t-2%", "YZ\t10.25\t+3%"), ("Also: A (B), C (D), E (F)", "Also: G (H)")]
    for a, b in same:
        assert truncation.template(a) == truncation.template(b)
    assert truncation.template("On Monday, Ann") != truncation.template("By Monday, Ann")
    assert truncation.closing_keys("plain words")[1] == 0
    assert len(truncation.template("a, A 1, " * 200_000)) > 0  # linear in the length


@pytest.mark.parametrize("tag", ["<img src='data:image/png;base64," + "A" * 3_000 + "'>", "</p>" * 200, "<a href='" + "x" * 500 + "'></a>"])
@pytest.mark.parametrize("feed", ["", "\n"])
def test_long_markup_at_the_end(tag, feed):
    assert ended(f"A sentence. It is whole.{feed}{tag}").kind == "stop"
    assert ended(f"A sentence. Then the plan{feed}{tag}").kind == "open"
    assert truncation.strip_marks(f"A sentence.{feed}{tag}")[0] == "A sentence."


def planted(n, seed):
    """Texts of invented words, a tenth of them cut, with closing matter after some of both; and the ids of the cut ones with whether the cut is inside a word."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "pra", "sto", "ven"]) for _ in range(rng.randint(2, 5))) + rng.choice(["", "s", "ed", "ing"]) for _ in range(900)})
    closers = ["Filed by {A} {B}", "Source: desk of {A}, extension {n}", "({n} views)", "### {n}", "© {n} {A} Media"]

    def filled(line):
        return line.format(A=rng.choice(words).title(), B=rng.choice(words).title(), n=rng.randint(1, 9999))

    docs, cut = [], {}
    for i in range(n):
        text = "\n".join(" ".join(" ".join(rng.choice([*[rng.choice(words)] * 9, f"{rng.randint(1, 99)}.{rng.randint(0, 9)}"]) for _ in range(rng.randint(6, 15))).capitalize() + " " + rng.choice(words) + "." for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(2, 4)))
        if rng.random() < 0.1:
            at = rng.randint(len(text) // 2, len(text) - 2)
            while text[at - 1] in ".\n " or text[at] == "." or not text[at - 1].isalpha():
                at -= 1
            cut[i] = text[at].isalpha()
            text = text[:at]
        if rng.random() < 0.5:
            text += "\n" + filled(rng.choice(closers))
        docs.append((i, text, rng.choice(["a", "b"])))
    return docs, cut


def test_planted_cuts(frame):
    docs, cut = planted(3_000, 4)
    judged = truncation.Truncation(frame([("", d, t, s, 0) for d, t, s in docs], SCHEMA)).judged().where("cut").collect()
    found = {r.doc_id: r.why for r in judged}
    both = found.keys() & cut.keys()
    assert len(both) >= 0.99 * len(cut) and len(both) >= 0.99 * len(found)
    # Cuts inside a word come through the trie, but for those whose rest is a word too.
    inside = [k for k in both if cut[k]]
    assert sum(found[k] == "word" for k in inside) >= 0.9 * len(inside) > 100


def corpus():
    rng = random.Random(0)
    heads = ["Markets today"] + [f"{a} raised {b} exports" for a in ("Alpha", "Beta", "Gamma") for b in ("seasonal", "domestic", "quarterly")]
    docs = []
    for i in range(120):
        lines = rng.sample(heads, 5)
        docs.append((i, "\n".join(lines), rng.choice(["a", None])))
    body = "\n".join(heads[:3])
    docs += [(500, body + "\nAlpha raised seasonal expo", "a"), (501, body + "\nAlpha raised", "a"), (502, body + "\nBeta raised domestic exports", "a"), (503, None, "a"), (504, "", None), (505, " \n ", "b"), (506, "Prose goes on. And the", None), (506, "Prose goes on. And the", None)]
    docs += [(507, "x. " * 100_000 + "and", "b")]
    return docs


def test_table(frame):
    t = truncation.Truncation(frame([("x", d, s, o, 0) for d, s, o in corpus()], SCHEMA))
    assert sorted(r.doc_id for r in t.found().collect()) == [500, 501, 506, 506, 507]
    by = {r.source: (r.n_docs, r.n_cut) for r in t.by_source().collect()}
    assert by["b"] == (2, 1) and by[None][1] == 2 and by["a"][1] == 2
    why = {r.doc_id: r.why for r in t.judged().where("cut").collect()}
    assert why[500] == "word" and why[501] == "entry" and why[506] == "sentence"


def test_empty(frame):
    t = truncation.Truncation(frame([], SCHEMA))
    assert t.found().count() == 0 and t.by_source().count() == 0
