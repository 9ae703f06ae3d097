import datetime as dt

import pytest

from newsloom.operators import models, reports, text, topics
from newsloom.operators.reports import Settings, Step

D = dt.date


def test_stop_words():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) and all(w.isalpha() and w.islower() and len(w) > 2 for w in text.STOP_WORDS)
    assert {"whereupon", "everything", "amongst", "zacks", "ourselves"} <= set(text.STOP_WORDS) and not {"market", "oil", "make"} & set(text.STOP_WORDS)


def test_names_and_settings():
    assert reports.check_name("lda_L80.b-1") == "lda_L80.b-1"
    for bad in ("", "a b", "a/b", "..\n"):
        with pytest.raises(ValueError):
            reports.check_name(bad)
    assert Settings.load({"NEWSLOOM_TOPICS": "80"}) == Settings(topics=80)
    with pytest.raises(ValueError):
        Settings.load({"NEWSLOOM_TOPICS": "0"})


def test_upsert_and_roll_up(frame):
    old = frame([("a", 0, 0.1), ("b", 0, 0.2)], "variant string, topic int, npmi double")
    new = frame([("b", 0, 0.5), ("c", 0, 0.6)], "variant string, topic int, npmi double")
    assert sorted(map(tuple, reports.upsert(old, new).collect())) == [("a", 0, 0.1), ("b", 0, 0.5), ("c", 0, 0.6)]
    assert reports.upsert(None, new) is new
    kinds = "done boolean, kept bigint"
    assert tuple(reports.roll_up(frame([(True, 3), (True, 4)], kinds)).first()) == (True, 7, 2)
    assert tuple(reports.roll_up(frame([(True, 3), (None, None)], kinds)).first()) == (False, 3, 2)
    assert tuple(reports.roll_up(frame([], kinds)).first()) == (False, 0, 0)


def test_comparison_of_a_model_with_itself(frame):
    phi = frame([(t, i, 0.7 if i % 3 == t else 0.15) for t in range(3) for i in range(3)], "topic int, term_id int, p double")
    tops = frame([(t, t) for t in range(3)], "topic int, term_id int")
    theta = frame([(D(2020, 1, d), t, 0.1 * ((d * (t + 1)) % 7)) for d in range(1, 9) for t in range(3)], "date date, topic int, theta double")
    got = {r.measure: r for r in reports.comparison((phi, phi), (tops, tops), (theta, theta)).collect()}
    assert got["diversity"].baseline == got["diversity"].candidate == 1.0
    assert got["term_cosine"].least == pytest.approx(1.0) and got["attention_correlation"].least == pytest.approx(1.0)
    assert (got["attention_gap"].baseline, got["attention_gap"].candidate) == (0.0, 1.0)


def test_pricing_summary(frame):
    got = reports.pricing_summary({"x": frame([(0.123456, 5)], "sharpe double, months bigint"), "y": frame([(1.0,)], "sharpe double")}).collect()
    assert sorted(map(tuple, got)) == [("x", 0.1235, 5), ("y", 1.0, None)]
    with pytest.raises(ValueError):
        reports.pricing_summary({})


def test_steps_run_once_and_refuse_stale_output(tmp_path):
    source, out = tmp_path / "in.txt", tmp_path / "out.txt"
    source.write_text("a")
    steps = [Step("copy", lambda: out.write_text(source.read_text()), str(out), [str(source)])]
    assert reports.run_steps(steps, Settings()) == ["copy"] and reports.run_steps(steps, Settings()) == []
    assert reports.run_steps(steps, Settings(topics=9)) == ["copy"]
    source.write_text("bb")
    with pytest.raises(ValueError):
        reports.run_steps(steps, Settings(topics=9), "raise")
    assert reports.run_steps(steps, Settings(topics=9)) == ["copy"] and out.read_text() == "bb"


def test_centroids_are_checked(frame):
    vectors = frame([(1, 1, 1.0, [1.0, 0.0])], "id bigint, doc bigint, w double, v array<double>")
    kinds = "topic int, centroid array<double>"
    for bad in ([(0, [0.0, 0.0])], [(0, [float("nan"), 1.0])], [(0, [1.0, 0.0]), (1, [1.0])], [(0, [1.0, 0.0]), (0, [0.0, 1.0])], []):
        with pytest.raises(ValueError):
            topics.soft_assign(vectors, frame(bad, kinds))
    a, b = (topics.soft_assign(vectors, frame([(0, [1.0, 0.0]), (1, [0.0, s])], kinds)).first().p for s in (1.0, 5.0))
    assert a == pytest.approx(b)  # centroids made before are normalised


def test_values_are_checked(frame):
    counts, vocab = frame([(1, 0, 2)], "row_id bigint, term_id int, tf bigint"), frame([(0, "x")], "term_id int, term string")
    members = frame([(1, 0, -0.5)], "doc bigint, topic int, weight double")
    with pytest.raises(Exception, match="negative"):
        topics.ctfidf(counts, members, vocab, [0]).collect()
    with pytest.raises(ValueError):
        topics.ctfidf(counts, members, vocab, [0], smooth=0)
    with pytest.raises(ValueError):
        topics.sparsify(frame([(1, 0, 0.5)], "doc bigint, topic int, theta double"), keep=0)
    with pytest.raises(ValueError):
        models.kmeans(frame([(1, 1.0, [1.0, 0.0])], "id bigint, w double, v array<double>"), 2)


@pytest.mark.parametrize("weighting", topics.WEIGHTINGS)
def test_fit_in_one_call(frame, weighting):
    passages = frame([(i, i // 2, 1.0 + i, [1.0, 0.1 * i] if i % 4 < 2 else [0.1 * i, 1.0]) for i in range(12)], "id bigint, doc bigint, w double, v array<double>")
    docs = frame([(d, f"2020-01-0{1 + d % 3}", 4) for d in range(7)], "doc bigint, date string, n_tokens bigint")
    counts = frame([(d, d % 4, 1 + d) for d in range(7)], "row_id bigint, term_id int, tf bigint")
    vocab = frame([(i, f"t{i}") for i in range(4)], "term_id int, term string")
    got = topics.fit_topics(passages, docs, counts, vocab, frame([(0, [2.0, 0.0]), (1, [0.0, 1.0])], "topic int, centroid array<double>"), weighting, meta={"seed": 3})
    assert sum(r.broken for r in got["contract"].collect()) == 0
    assert got["theta"].count() == 14 and got["attention"].count() == 6 and got["labels"].count() == 2
    assert got["meta"]["topics"] == 2 and got["meta"]["seed"] == 3 and ("documents_kept" in got["meta"]) == (weighting == "sparse")
    with pytest.raises(ValueError):
        topics.fit_topics(passages, docs, counts, vocab, frame([(0, [1.0, 0.0])], "topic int, centroid array<double>"), "other")


def test_kmeans_weights_and_objective(frame):
    rows = [(i, 1.0 + i % 3, [1.0, 0.01 * i] if i < 10 else [0.01 * i, 1.0]) for i in range(20)]
    got = models.kmeans(frame(rows, "id bigint, w double, v array<double>"), 2).collect()
    assert sorted(r["size"] for r in got) == [10, 10]
    assert sum(r.weight for r in got) == sum(r[1] for r in rows) and all(0.99 < r.objective <= 1.0 for r in got)
