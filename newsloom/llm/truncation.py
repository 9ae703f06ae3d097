"""Texts cut off by field limits or in transfer."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut as cut_
from .batches import slices

# How full sentences end, markup, marks of a cut, list bullets, links.
_STOP = re.compile(r"""[.!?。！？؟।]["'”’»›)\]）」』*_~`]*\Z""")
_TAGS = re.compile(r"(?:\s*(?:</?[A-Za-z][^<>]*>|&[A-Za-z]+;))+\s*\Z")
_MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\[\+\d+\s\w+\]|\.\.\.|…|�+)\s*\Z")
_BULLET = re.compile(r"(?:[-*+•·]|\d{1,3}[.)])\s+\S")
_LINK = re.compile(r"https?://\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_FIGURE = re.compile(r"[$€£¥]?\d[\d,]*(?:\.\d+)*\.?")
_INNER_STOP = re.compile(r"[.!?]\s+\S")
#: The first words of a line up to a colon.
_LABEL = re.compile(r"[^\W\d]\S*(?:\s\S+){0,2}?:\s")
_NAME = re.compile(r"[^\W\d_][\w.&'’-]*")
_NAMES = re.compile(r"A(?:\sA)+")
_YEAR = re.compile(r"(?:19|20)\d\d\.?\Z")


def template(line: str) -> str:
    """The line with numbers, links and capitalised words as placeholders and repeated parts of a list once; its first word stays, but for a tag's or a table row's."""
    first, _, rest = line.partition(" ")
    if "\t" in line:
        first, rest = "", line
    first = "#" if first.startswith("#") else first
    rest = _NAME.sub(lambda m: "A" if m[0][0].isupper() else m[0], _LINK.sub("9", rest))
    rest = re.sub(r"#\w+", "#", re.sub(r"[-+]?\d+", "9", rest))
    parts = _NAMES.sub("A", rest).replace("; ", ", ").split(", ")
    return re.sub(r"\d+", "9", first) + " " + ", ".join(p for k, p in enumerate(parts) if not k or p != parts[k - 1])


def closing_keys(line: str) -> tuple[int, int]:
    """Keys of a line's template and of its label (0 without one)."""
    label = _LABEL.match(line)
    return (xxhash.xxh3_64_intdigest("T" + template(line)) >> 1) or 1, (xxhash.xxh3_64_intdigest("L" + label[0]) >> 1) or 1 if label else 0


#: Characters at the end of a text in which marks are looked for at once; what lies before comes up when those are taken off.
_TAIL = 400


def _off(pattern: re.Pattern, text: str) -> str:
    """The text without what the pattern, which ends at the end, matches there. A tag at the end is taken in from its `<` on, however long it is."""
    tag = text.rfind("<") if text.endswith(">") else -1
    cut = max(0, min(len(text) - _TAIL, tag if tag >= 0 else len(text)))
    return text[:cut] + pattern.sub("", text[cut:])


def _bare(line: str) -> str:
    """The line without all the markup at its end."""
    while (shorter := _off(_TAGS, line.rstrip())) != line:
        line = shorter
    return line


def _stops(text: str) -> bool:
    return bool(_STOP.search(text[-_TAIL:]))


def _unmarked(text: str) -> str:
    """The text without markup and marks of a cut at its end."""
    body = text.rstrip()
    while True:
        before = body
        if body.endswith((">", ";")):
            body = _off(_TAGS, body).rstrip()
        bare = _off(_MARK, body)
        if bare != body and (body.endswith(("]", "�", "…")) or not _stops(bare)):
            body = bare.rstrip()
        if body == before:
            return body


def last_line(text: str) -> str:
    """The last line of a text that might be closing matter: without markup and marks; empty if it is the only one, or a full sentence."""
    body = _unmarked(text)
    feed = body.rfind("\n")
    line = body[feed + 1 :].strip()
    return line if feed >= 0 and body[:feed].strip() and not _stops(line) else ""


def strip_marks(text: str, closing: frozenset[int] = frozenset()) -> tuple[str, str]:
    """The text without what was put after its end: markup, cut marks, and lines whose template or label is known as closing matter, or that end with a link; and the last such line with a label, whose wording is free."""
    body, labelled = _unmarked(text), ""
    while line := last_line(body):
        whole, label = closing_keys(line)
        if whole not in closing and label not in closing and not _LINK.fullmatch(line.rsplit(None, 1)[-1]):
            break
        if whole not in closing and label in closing:
            labelled = labelled or line
        body = _unmarked(body[: body.rfind("\n")])
    return body, labelled


def _ends(line: str) -> bool:
    return _stops(_bare(line.strip()))


def _shape(cell: str) -> str:
    """'word', or a figure with its places: the sign and the digits before the point don't matter."""
    if not re.search(r"\d", cell):
        return "word"
    head, point, tail = cell.lstrip("+-").partition(".")
    return re.sub(r"\d+", "9", head) + point + re.sub(r"\d", "8", tail)


def _figure_path(figure: str) -> str:
    """A figure as a path of the trie: digits between its points are one step, and years are told apart."""
    return "Y" + "." * figure.endswith(".") if _YEAR.match(figure) else re.sub(r"\d+", "9", figure.replace(",", ""))


def _last_token(line: str) -> str:
    """The path of the last token: a word without what stands around it, or a figure."""
    tail = line[-_TAIL:].rpartition("|")[2]
    if not tail.strip() or line[-1].isspace():
        return ""
    token = tail.split()[-1]
    return (_WORD.findall(token) or [""])[-1]


def _row(last: str, lines: list[str]) -> tuple[str, str]:
    """Kind and last word of a text that ends with a table row: it is entire if it has as many cells as others, and a last figure with as many places."""
    gap = "\t" if "\t" in last else " | "
    cells = last.split(gap)
    others = [x.strip().split(gap) for x in lines[:-1] if gap in x]
    if gap == " | " and len(cells) > 2 and not others:
        shapes, fits = {_shape(c.split()[-1]) for c in cells[:-1] if c.split()}, True
    else:
        shapes, fits = {_shape(c[-1].split()[-1]) for c in others if c[-1].split()}, not others or len(cells) in {len(c) for c in others}
    tail = cells[-1].split()[-1] if cells[-1].split() else ""
    if not fits or not tail:
        return "open", ""
    if _shape(tail) == "word":
        return "line", _last_token(last)
    return ("open" if shapes and _shape(tail) not in shapes else "whole"), ""


class Ending(NamedTuple):
    """How a text ends once closing matter is taken off.

    kind: 'stop': after a mark that ends sentences. 'figure': after a figure and a point,
    which may be its decimal point. 'open': prose without such a mark, or a broken row.
    'line': an entry of a list, a headline or a cell, which needs no mark. 'row': a table
    row like the others.
    last, entry, label: paths to look up in the trie: the last token of the text itself,
    of a list put after it, of a closing line with free wording; empty if there is none.
    chars, size: length of the text in code points and in bytes.
    """

    kind: str
    last: str
    entry: str
    label: str
    chars: int
    size: int


def ending(body: str, labelled: str = "", closing: frozenset[int] = frozenset()) -> Ending:
    """The ending of what `strip_marks` gives."""
    label = _last_token(_bare(labelled)) if labelled and labelled[-1:].isalpha() else ""

    def said(kind: str, last: str = "", entry: str = "", of: str = body) -> Ending:
        return Ending(kind, last, entry, label, len(of), len(of.encode("utf-8", "replace")))

    def prose(line: str, of: str, entry: str = "") -> Ending | None:
        if _stops(line):
            figure = [m for m in _FIGURE.findall(line[-_TAIL:].split()[-1])]
            if figure and line.endswith(figure[-1]) and figure[-1].count(".") == 1 and line.endswith("."):
                return said("figure", _figure_path(figure[-1]), entry, of)
            return said("stop", "", entry, of)
        return said("open", _last_token(line), entry, of) if _INNER_STOP.search(line) else None

    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return said("stop")
    last = lines[-1].strip()
    plain = _bare(last)
    table = "\t" in last or " | " in last
    if table or _BULLET.match(last):
        kind, entry = _row(last, lines) if table else ("stop", "") if _stops(plain) else ("line", _last_token(plain))
        # Rows and entries may have been put after a cut text: what stands before them is looked at too.
        k = len(lines)
        while k and ("\t" in lines[k - 1] or " | " in lines[k - 1] or _BULLET.match(lines[k - 1].strip())):
            k -= 1
        inner = strip_marks("\n".join(lines[:k]), closing)[0].strip()
        if inner and kind != "open":
            end = _bare(inner.rsplit("\n", 1)[-1].strip())
            found = prose(end, inner, entry)
            if found and found.kind != "stop":
                return found
            if not found and not end.endswith((":", "：")):
                return said("line", _last_token(end), entry, inner)
        return said(kind, "", entry) if kind == "line" else said("row" if table and kind != "open" else kind, entry)
    found = prose(plain, body)
    if found:
        return found
    if plain[-1:] in ",;(-–—$€£" or len(lines) == 1 or _ends(lines[-2]):
        return said("open", _last_token(plain))
    return said("line", _last_token(plain))


def _paths(tokens: Counter, last: bool) -> Counter:
    """Counts of the words and figures in counted tokens; of the last word of each only, if `last`."""
    out: Counter = Counter()
    for token, n in tokens.items():
        found = _WORD.findall(token)
        for w in found[-1:] if last else found:
            out[w] += n
        if not last and not token.isalpha():
            for figure in _FIGURE.findall(token):
                out[_figure_path(figure)] += n
    return out


class Truncation:
    """Cut-off texts of a table.

    A text is cut off if, without marks and closing matter put after it, it stops inside a
    word, a figure, a sentence or an entry.

    Closing matter is learned: lines whose template (names, numbers and links as
    placeholders), or whose label before a colon, is that of the last line of at least
    `closing_share` of all texts, and that of the line before at most half as often (lines
    before closing lines count as last ones). Full sentences are never closing matter.

    The last token is looked up in a trie of all words and figures of the corpus, a text's
    own last token left out. The trie tells how often the path stands as a token (n), how
    often it ends a line, and how often it is the beginning of longer tokens. The token is
    broken if it stands at most `broken_share` as often as what it is the beginning of:
    the text stops inside a word or a figure. Else it is judged by what it ends: prose
    without a mark that ends sentences is cut off; an entry or headline, which needs no
    such mark, is if its last word stands `known` times and as good as never ends a line
    (`line_share` of its occurrences). Length evidence: at a length, in characters or
    bytes, at which at least `spike` and the share `spike_share` of its source's texts
    without an end mark stop, ten times that share is asked. The last word of a closing
    line with a label, whose wording is free, counts as broken only if it is unknown and
    the beginning of words that stand `known` times.

    Null, empty and blank texts are never cut off. A null source is a source of its own.
    Repeated rows and ids come out as often as they come in; an empty table gives no rows;
    other columns play no part.
    """

    _HELD = 300_000

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", closing_share: float = 5e-4, broken_share: float = 1e-3, line_share: float = 0.005, known: int = 20, spike: int = 4, spike_share: float = 0.2) -> None:
        self.doc_id, self.source = doc_id, source
        self.closing_share, self.broken_share, self.line_share, self.known, self.spike, self.spike_share = closing_share, broken_share, line_share, known, spike, spike_share
        self.kind = dict(df.dtypes)[doc_id]
        self.rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
        self._closing: frozenset[int] | None = None

    def closing(self) -> frozenset[int]:
        """Keys of the templates and labels of closing matter; at most 4 / `closing_share` of them."""
        if self._closing is not None:
            return self._closing
        names = ["t", "l", "bt", "bl", "n"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()

            def flush() -> pa.RecordBatch:
                columns = [*zip(*held, strict=True)] if held else [()] * 4
                out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, list(held.values()))], names=names)
                held.clear()
                return out

            for part in slices(batches, 0):
                for text in part.column(0).to_pylist():
                    body = _unmarked(text)
                    line = last_line(body)
                    before = last_line(body[: body.rfind("\n")]) if line else ""
                    held[(*(closing_keys(line) if line else (0, 0)), *(closing_keys(before) if before else (0, 0)))] += 1
                if len(held) > Truncation._HELD:
                    yield flush()
            yield flush()

        pairs = cut_(self.rows.where("text is not null").select("text").mapInArrow(run, "t bigint, l bigint, bt bigint, bl bigint, n bigint").groupBy("t", "l", "bt", "bl").agg(F.sum("n").alias("n")))
        least = max(3, math.ceil(self.closing_share * (pairs.agg(F.sum("n")).first()[0] or 0)))
        known: list[int] = []
        for _ in range(2):  # the second time a line before a closing line counts as last
            last = F.col("t").isin(known) | F.col("l").isin(known) if known else F.lit(False)
            votes = F.array(*(F.struct(F.col(c).alias("key"), (F.col("n") * end.cast("bigint")).alias("last"), (F.col("n") * (~end).cast("bigint")).alias("before")) for c, end in (("t", F.lit(True)), ("l", F.lit(True)), ("bt", last), ("bl", last))))
            counted = pairs.select(F.explode(votes).alias("v")).where("v.key <> 0").groupBy("v.key").agg(F.sum("v.last").alias("last"), F.sum("v.before").alias("before"))
            known = [r.key for r in counted.where((F.col("last") >= least) & (F.col("before") * 2 <= F.col("last"))).select("key").collect()]
        self._closing = frozenset(known)
        return self._closing

    def _scanned(self) -> DataFrame:
        """One pass over the texts: a row for each text's ending (`word` is null), and rows of the vocabulary (`kind` is null), combined within each task first."""
        held, closing = self._HELD, self.closing()
        blank = Ending("stop", "", "", "", 0, 0)
        names = ["doc_id", "source", "kind", "last", "entry", "label", "chars", "bytes", "word", "n", "n_end"]
        kinds = [pa.string()] * 4 + [pa.int32()] * 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens: Counter = Counter()
            ends: Counter = Counter()
            id_kind = pa.int64()

            def flush() -> pa.RecordBatch:
                n, end = _paths(tokens, False), _paths(ends, True)
                tokens.clear()
                ends.clear()
                words = [w for w in n.keys() | end.keys() if w]
                empty = [pa.nulls(len(words), k) for k in (id_kind, pa.string(), *kinds)]
                return pa.RecordBatch.from_arrays([*empty, pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([end[w] for w in words], pa.int64())], names=names)

            for part in slices(batches, 2):
                found = []
                id_kind = part.column(0).type
                for text in part.column(2).to_pylist():
                    if not text or text.isspace():
                        found.append(blank)
                        continue
                    body, labelled = strip_marks(text, closing)
                    found.append(ending(body, labelled, closing))
                    for stretch in (body, text[len(body) :]):  # but for the last tokens of the text itself and of what was put after it
                        tokens.update(stretch.split()[:-1])
                        ends.update(line[-1] for x in stretch.split("\n")[:-1] if (line := x.rsplit(None, 1)))
                columns = [pa.array([x or None for x in c] if k == pa.string() else c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                if len(tokens) > held:
                    yield flush()
            if tokens:
                yield flush()

        return self.rows.mapInArrow(run, f"doc_id {self.kind}, source string, kind string, last string, entry string, label string, chars int, bytes int, word string, n bigint, n_end bigint")

    def _nodes(self, counted: DataFrame, asked: DataFrame) -> DataFrame:
        """The trie's nodes at the given paths: times the path is a token, ends a line, and goes on to longer tokens."""
        steps = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.substring(F.col("word"), F.lit(1), i).alias("path"), (i == F.length("word")).alias("here")))
        vocabulary = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
        paths = vocabulary.select("n", "n_end", F.explode(steps).alias("at")).select("n", "n_end", "at.path", "at.here")
        wanted = paths.join(asked, "path", "left_semi")
        return wanted.groupBy("path").agg(F.sum(F.when(F.col("here"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("here"), F.col("n_end")).otherwise(0)).alias("n_end"), F.sum(F.when(~F.col("here"), F.col("n")).otherwise(0)).alias("n_longer"))

    def _limits(self, ends: DataFrame) -> DataFrame:
        """source, unit ('chars' or 'bytes'), length: where many of a source's texts without an end mark stop. At most 2 / `spike_share` for each source."""
        lengths = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
        broken = ends.where("kind in ('open', 'figure', 'line')")
        totals = broken.groupBy("source").agg(F.count("*").alias("n_open"))
        counts = broken.select("source", lengths.alias("at")).groupBy("source", "at.unit", "at.length").agg(F.count("*").alias("n")).where(F.col("n") >= self.spike)
        both = counts.join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        return both.where(F.col("n") >= F.ceil(F.col("n_open") * self.spike_share)).select("source", "unit", "length")

    def judged(self) -> DataFrame:
        """Every row: doc_id, source, `cut` (boolean), `why` ('word', 'figure', 'sentence', 'entry'), `chars`, and `at_limit`: whether many texts of its source stop at that length."""
        scanned = cut_(self._scanned())
        ends = scanned.where("word is null").drop("word", "n", "n_end")
        limits = cut_(self._limits(ends))
        for unit in ("chars", "bytes"):
            one = limits.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias("l"), F.lit(True).alias(f"at_{unit}"))
            ends = ends.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("l")), "left").drop("s", "l")
        at_limit = (F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))) & F.col("kind").isin("open", "figure", "line")
        asked = ends.select(F.explode(F.array("last", "entry", "label")).alias("path")).where("path is not null").distinct()
        nodes = cut_(self._nodes(scanned.where("word is not null").select("word", "n", "n_end"), asked))
        rows = ends.withColumn("at_limit", at_limit)
        for which in ("last", "entry", "label"):
            one = nodes.select(F.col("path").alias(which), *(F.col(c).alias(f"{which}_{c}") for c in ("n", "n_end", "n_longer")))
            rows = rows.join(one, which, "left")
        share = F.when(F.col("at_limit"), self.line_share * 10).otherwise(self.line_share)

        def broken(which: str) -> Column:
            return (F.coalesce(f"{which}_n_longer", F.lit(0)) > 0) & (F.col(f"{which}_n") <= F.col(f"{which}_n_longer") * self.broken_share)

        def never_ends(which: str) -> Column:
            return F.coalesce((F.col(f"{which}_n") >= self.known) & (F.col(f"{which}_n_end") < F.col(f"{which}_n") * share), F.lit(False))

        line = F.col("kind") == "line"
        label = F.coalesce((F.col("label_n") == 0) & (F.col("label_n_longer") >= self.known), F.lit(False))
        why = (
            F.when(F.col("kind").isin("open", "line") & broken("last") | (line & broken("entry")) | label, "word")
            .when((F.col("kind") == "figure") & broken("last"), "figure")
            .when(F.col("kind") == "open", "sentence")
            .when(line & (never_ends("last") | never_ends("entry")), "entry")
        )
        return rows.select("doc_id", "source", why.isNotNull().alias("cut"), why.alias("why"), "chars", "at_limit")

    def found(self) -> DataFrame:
        """Ids of the texts that were cut off."""
        return self.judged().where("cut").select(F.col("doc_id").alias(self.doc_id))

    def by_source(self) -> DataFrame:
        """For each source: its texts, those cut off, their share, and how many of those stop at a length at which many do."""
        return self.judged().groupBy(F.col("source").alias(self.source)).agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit"))
