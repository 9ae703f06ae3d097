"""Loading raw CSV records, with every record that does not load labelled by its reason.

Structural rejects come from the CSV reader's invalid-row callback; fields are read as
strings and cast as whole vectors, the failing cells giving the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("Unnamed: 0", "Date", "Article_title", "Stock_symbol", "Url", "Publisher", "Author", "Article", "Lsa_summary", "Luhn_summary", "Textrank_summary", "Lexrank_summary")
#: Cells that stand for no article.
NO_TEXT = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>")
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
#: A record whose quotes are all in place.
WELL_QUOTED = rf"\A{_FIELD}(?:,{_FIELD})*\z"
_BARE_BREAK = re.compile(rf'(?:\A|,)(?:"(?:[^"]|"")*"|[^",\r\n]*[\r\n])')
_SPLIT = re.compile(rf"({_FIELD})(?:,|\Z)")
_DATE = r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC\z"
_CONTROL = "[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
_MONTH = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _requoted(record: str) -> str:
    """The record with every field in quotes, so that line breaks within bare fields stay inside it."""
    fields, at = [], 0
    while True:
        m = _SPLIT.match(record, at)
        text = m[1]
        fields.append(text if text[:1] == '"' else f'"{text}"')
        if m.end() == m.end(1):
            return ",".join(fields)
        at = m.end()


def _dates(cells: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Timestamps, and which cells are exact `YYYY-MM-DD HH:MM:SS UTC` with a real date and time."""
    shaped = pc.match_substring_regex(cells, _DATE).to_numpy(zero_copy_only=False).astype(bool)
    text = pc.if_else(pa.array(shaped), cells, "1970-01-01 00:00:00 UTC")
    part = [pc.cast(pc.utf8_slice_codeunits(text, a, b), pa.int64()).to_numpy() for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19))]
    year, month, day, hour, minute, second = part
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = _MONTH[np.clip(month, 0, 12)] + (leap & (month == 2))
    good = shaped & (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= days) & (hour <= 23) & (minute <= 59) & (second <= 59)
    month0 = np.where(good, (year - 1970) * 12 + month - 1, 0)
    date = month0.astype("datetime64[M]").astype("datetime64[D]") + np.where(good, day - 1, 0)
    micros = date.astype("datetime64[us]").astype(np.int64) + np.where(good, (hour * 60 + minute) * 60 + second, 0) * 1_000_000
    return pa.array(micros, pa.int64(), mask=~good).cast(pa.timestamp("us")), good


def parse(raw: pa.Array, fields: tuple[str, ...] = FIELDS, date: str = "Date", article: str = "Article") -> tuple[pa.Array, dict[str, pa.Array]]:
    """Reason (null where the record loads) and field values of raw records."""
    n, width = len(raw), len(fields)
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    text = raw.fill_null("")
    reason = np.full(n, None, object)
    quoted = pc.match_substring_regex(text, WELL_QUOTED).to_numpy(zero_copy_only=False).astype(bool)
    reason[~quoted] = "quoting"
    blank = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(bool)
    if width > 1:
        reason[blank] = "columns"
    keep = np.flatnonzero(quoted & ~blank)
    records = text.take(pa.array(keep))
    breaks = pc.match_substring_regex(records, r"[\r\n]").to_numpy(zero_copy_only=False).astype(bool)
    if breaks.any():  # a bare field may hold a line break too; the reader would end the record there
        fixed = records.to_pylist()
        for i in np.flatnonzero(breaks):
            if any(m[0][-1:] in "\r\n" for m in _BARE_BREAK.finditer(fixed[i])):
                fixed[i] = _requoted(fixed[i])
        records = pa.array(fixed, pa.string())

    names = [f"f{i}" for i in range(width)]
    data = "\n".join([",".join(names), *records.to_pylist(), ""]).encode()
    rejected: list[int] = []

    def on_invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(row.number - 2)  # the header is row 1
        return "skip"

    table = pacsv.read_csv(
        pa.py_buffer(data),
        read_options=pacsv.ReadOptions(use_threads=False, block_size=len(data) + 1),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=on_invalid),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    reason[keep[rejected]] = "columns"
    whole = np.delete(keep, rejected)
    if table.num_rows != len(whole):
        raise ValueError(f"the reader gave {table.num_rows} of {len(whole)} records")
    place = np.full(n, -1)
    place[whole] = np.arange(len(whole))
    at = pa.array(place, pa.int64(), mask=place < 0)
    cells = {f: table.column(c).combine_chunks().take(at) for f, c in zip(fields, names, strict=True)}

    stamps, good = _dates(cells[date].fill_null(""))
    loaded = place >= 0
    reason[loaded & ~good] = "date"
    body = cells[article].fill_null("")
    nothing = pc.is_in(pc.utf8_trim_whitespace(body), pa.array(NO_TEXT)).to_numpy(zero_copy_only=False).astype(bool)
    broken = pc.match_substring_regex(body, _CONTROL).to_numpy(zero_copy_only=False).astype(bool)
    reason[loaded & good & (nothing | broken)] = "article"
    why = pa.array(reason, pa.string())
    ok = pc.is_null(why)
    cells = {f: pc.if_else(ok, c, pa.scalar(None, c.type)) for f, c in (cells | {date: stamps}).items()}
    return why, cells


def _pieces(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of raw text, so that memory does not follow record length."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def load_records(df: DataFrame, record_id: str = "raw_id", raw: str = "raw", fields: tuple[str, ...] = FIELDS, date: str = "Date", article: str = "Article") -> DataFrame:
    """Every record with `reason` (null where it loads) and its fields (all null where it does not).

    Columns: the id, `reason`, and `fields`, `date` as a timestamp and the others as
    strings. The first fault that applies is the reason: 'quoting' (a quoted field that
    never closes or is followed by something other than a comma or the end, or a double
    quote in a bare field), 'columns' (not exactly as many fields), 'date' (not exactly
    `YYYY-MM-DD HH:MM:SS UTC` with a real date and time), 'article' (no text, or text
    with U+FFFD or a control character other than tab, line feed, carriage return).

    A null or empty record has one empty field, so it is a 'columns' reject. Repeated
    records and ids come out as often as they come in. An empty table gives no rows.
    Other columns of `df` play no part. No shuffle: one pass over the rows.
    """
    at = {f: ("timestamp_ntz" if f == date else "string") for f in fields}
    kind = dict(df.dtypes)[record_id]
    schema = f"record_id {kind}, reason string, " + ", ".join(f"`{f}` {k}" for f, k in at.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                why, cells = parse(part.column(1), fields, date, article)
                yield pa.RecordBatch.from_arrays([part.column(0), why, *cells.values()], names=["record_id", "reason", *fields])

    rows = df.select(F.col(record_id), F.col(raw).cast("string")).mapInArrow(run, schema)
    return rows.withColumnRenamed("record_id", record_id)


def rejects(loaded: DataFrame, record_id: str = "raw_id") -> DataFrame:
    """Id and reason of the records that do not load."""
    return loaded.where("reason is not null").select(record_id, "reason")


def good_rows(loaded: DataFrame) -> DataFrame:
    """The records that load, without the reason."""
    return loaded.where("reason is null").drop("reason")
