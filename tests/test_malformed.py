import csv
import io
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from newsloom.operators import malformed

GOOD = "2020-02-29 23:59:59 UTC"


def record(date=GOOD, article="text", n=12):
    cells = [""] * n
    cells[1:2] = [date]
    if n > 7:
        cells[7] = article
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def fields(raw):
    """A record's fields by reading it character by character; None if the quotes are out of place."""
    out, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            cell, i = "", i + 1
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + raw[i], i + 1
            if i < len(raw) and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = len(raw) if j < 0 else j
            cell, i = raw[i:j], j
            if '"' in cell:
                return None
        out.append(cell)
        if i >= len(raw):
            return out
        i += 1


def reasons(raws):
    why, cells = malformed.parse(pa.array(raws, pa.string()))
    return why.to_pylist(), cells


def test_reasons():
    cases = {
        record(): None,
        record(article='say "hi", twice\nover\r\nlines'): None,
        record(n=11): "columns",
        record(n=13): "columns",
        "": "columns",
        record() + '"': "quoting",
        record(article="x").replace(",x,", ',"x,'): "quoting",
        record(article="x").replace(",x,", ',"x"y,'): "quoting",
        record(article="x").replace(",x,", ',x"y,'): "quoting",
        record(date="2021-02-29 00:00:00 UTC"): "date",
        record(date="2020-02-29 00:00:60 UTC"): "date",
        record(date="0000-02-29 00:00:00 UTC"): "date",
        record(date="2020-02-29 24:00:00 UTC"): "date",
        record(date="2020-02-29"): "date",
        record(date=GOOD + "\n"): "date",
        record(article="   "): "article",
        record(article=" NaN "): "article",
        record(article="a�b"): "article",
        record(article="a\x07b"): "article",
        record(article="a\tb\x7f"): "article",
        record(article="bare\nbreak").replace('"', ""): None,
        "﻿" + record(): None,
    }
    why, cells = reasons(list(cases))
    assert why == list(cases.values())
    assert cells["Article"].to_pylist()[1] == 'say "hi", twice\nover\r\nlines'
    assert cells["Article"].to_pylist()[-2] == "bare\nbreak"
    assert str(cells["Date"][0]) == "2020-02-29 23:59:59"


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet='a",\n\r é', max_size=30), max_size=6))
def test_structure_as_read_by_character(raws):
    why, _ = reasons(raws)
    for raw, w in zip(raws, why, strict=True):
        got = fields(raw)
        assert w == ("quoting" if got is None else "columns" if len(got) != 12 else w)
        assert w not in ("quoting", "columns") or got is None or len(got) != 12


def test_table(frame):
    schema = "reason string, raw_id bigint, raw string, Date int"
    rows = [("x", 1, record(), 0), ("x", 2, None, 0), ("x", 2, None, 0), (None, None, record(n=3), 0), ("y", 3, record(article="z" * 3_000_000), 0)]
    loaded = malformed.load_records(frame(rows, schema))
    assert sorted(map(tuple, malformed.rejects(loaded).collect()), key=str) == sorted([(2, "columns"), (2, "columns"), (None, "columns")], key=str)
    good = {r.raw_id: len(r.Article) for r in malformed.good_rows(loaded).collect()}
    assert good == {1: 4, 3: 3_000_000}
    assert malformed.load_records(frame([], schema)).count() == 0
