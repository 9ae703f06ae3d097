import csv
import datetime as dt
import io
import zipfile

import pytest

from newsloom.operators.malformed import FIELDS
from newsloom.plans import stream_queries
from newsloom.sources import readers, writers


def test_range_reader_reads_each_record_once(spark, tmp_path):
    path, n = tmp_path / "news.csv", 200
    with path.open("w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(FIELDS)
        for i in range(n):
            w.writerow([f"{i}.0", "2020-01-01 00:00:00 UTC", "t", "A", "u", "", "", f"body {i}\nline, \"two\"\n" + "x" * (i * 7 % 90), "", "", "", ""])
    for parts in (1, 3, 7, 40):
        got = readers.news_csv(spark, str(path), parts).where("reason is null").select("`Unnamed: 0`", "Article").collect()
        assert sorted(float(r[0]) for r in got) == [float(i) for i in range(n)]
    assert readers.complete(spark, str(path), readers.news_csv(spark, str(path), 3))


def test_returns_and_rates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Date,PERMNO,RET\n2020-01-01,7,0.5\n2020-01-02,7,C\n")
    got = readers.daily_returns(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.date, r.id, r.ret) for r in got] == [(dt.date(2020, 1, 1), "7", 0.5), (dt.date(2020, 1, 2), "7", None)]
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.CSV", "a\nb\nc\n,Mkt,RF\n20200102, 1.0, 0.006\nCopyright\n20201399,1,1\n")
    assert [tuple(r) for r in readers.factor_rates(spark, str(tmp_path / "f.zip")).collect()] == [(dt.date(2020, 1, 2), pytest.approx(6e-5))]


def test_attention_round_trip_and_reports(spark, frame, tmp_path):
    df = frame([(dt.date(2020, 1, 1), t, 0.5) for t in (0, 1)], "date date, topic int, theta double")
    writers.attention(df, str(tmp_path / "a"), 2)
    assert sorted(map(tuple, readers.attention(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, df.collect()))
    writers.report(df, str(tmp_path / "r.md"), "md")
    assert (tmp_path / "r.md").read_text().count("\n") == 4
    writers.atomic_json(str(tmp_path / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')


def test_cache_follows_its_key(spark, frame, tmp_path):
    made = []

    def make():
        made.append(1)
        return frame([(len(made),)], "n int")

    path = str(tmp_path / "t")
    assert [writers.cached(spark, path, k, make).first().n for k in ("a", "a", "b")] == [1, 1, 2]
    with pytest.raises(ValueError):
        writers.cached(spark, path, "c", make, on_change="raise")


def test_stream_equals_batch(spark, frame, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), "ab"[i % 2], float(i)) for i in range(50)]
    frame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    a, b = (sorted(map(tuple, f(spark, str(tmp_path)).collect())) for f in (stream_queries.daily_events, stream_queries.daily_events_batch))
    assert a == b and len(a) == 6
