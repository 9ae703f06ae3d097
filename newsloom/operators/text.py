"""Cleaning, tokens, n-grams, vocabulary, counts and passages, all in built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import buffers

# Words left out when a vocabulary is learned, in families and one by one; words of one or two letters are never tokens.
_HERE = [f"{a}{b}" for a in ("here", "there", "where") for b in ("", "after", "by", "in", "upon")] + ["therefore", "whereas", "wherever", "thence", "whence", "hence", "thereby"]
_SOME = [f"{a}{b}" for a in ("any", "every", "some", "no") for b in ("one", "thing", "where")] + ["anyhow", "anyway", "somehow", "nobody", "noone", "none"]
_SELF = ["myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves"]
_PRONOUNS = ["him", "his", "she", "her", "hers", "its", "our", "ours", "you", "your", "yours", "they", "them", "their", "mine", "who", "whom", "whose", "whoever", "what", "whatever", "which", "this", "that", "these", "those", "others", "other", "another", "each", "either", "neither", "both", "such", "same", "own"]
_NUMBERS = ["one", "two", "three", "four", "five", "six", "eight", "nine", "ten", "eleven", "twelve", "fifteen", "twenty", "forty", "fifty", "sixty", "hundred", "first", "third", "once"]
_VERBS = ["are", "was", "were", "been", "being", "has", "had", "have", "hasnt", "can", "cannot", "cant", "could", "couldnt", "may", "might", "must", "should", "will", "would", "became", "become", "becomes", "becoming", "seem", "seemed", "seeming", "seems", "call", "cry", "describe", "detail", "done", "fill", "find", "found", "get", "give", "keep", "made", "move", "name", "namely", "put", "see", "serious", "show", "take", "please", "interest", "sincere"]
_PLACES = ["about", "above", "across", "after", "afterwards", "against", "along", "among", "amongst", "amoungst", "around", "before", "beforehand", "behind", "below", "beside", "besides", "between", "beyond", "down", "during", "for", "from", "into", "off", "onto", "out", "over", "per", "since", "than", "through", "throughout", "thru", "toward", "towards", "under", "until", "upon", "via", "with", "within", "without", "bottom", "top", "side", "front", "back", "amount", "part", "mill", "bill", "fire", "system", "con", "due", "etc", "inc", "ltd"]
_OTHERS = ["again", "all", "almost", "alone", "already", "also", "although", "always", "and", "because", "but", "else", "elsewhere", "empty", "enough", "even", "ever", "except", "few", "former", "formerly", "full", "further", "how", "however", "indeed", "last", "latter", "latterly", "least", "less", "many", "meanwhile", "more", "moreover", "most", "mostly", "much", "never", "nevertheless", "next", "nor", "not", "now", "often", "only", "otherwise", "perhaps", "rather", "several", "sometime", "sometimes", "still", "the", "then", "thick", "thin", "though", "thus", "together", "too", "very", "well", "when", "whenever", "whether", "while", "whither", "whole", "why", "yet", "any", "every", "some"]
_NEWS = ["said", "says", "corp", "llc", "company", "companies", "share", "shares", "stock", "stocks", "percent", "pct", "quarter", "year", "week", "month", "reuters", "nasdaq", "views", "opinions", "author", "herein", "com", "www", "http", "https", "zacks", "motley", "fool", "benzinga"]
STOP_WORDS = tuple(sorted({*_HERE, *_SOME, *_SELF, *_PRONOUNS, *_NUMBERS, *_VERBS, *_PLACES, *_OTHERS, *_NEWS}))
#: White space as Unicode has it; Java's \s is ASCII only.
WHITE = "\\t-\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def clean(text: str) -> Column:
    """Null as empty, URLs and all but letters A-Z as blanks, lower case, single spaces."""
    return F.trim(F.lower(F.regexp_replace(_bare(text), "[^A-Za-z]+", " ")))


def _bare(text: str) -> Column:
    """Null as empty, URLs as blanks."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(whole, F.lit("://")), F.regexp_replace(whole, f"https?://[^{WHITE}]+", " ")).otherwise(whole)


def tokens(cleaned: Column) -> Column:
    """Longest runs of at least three letters."""
    return F.regexp_extract_all(cleaned, F.lit("([a-z]{3,})"), F.lit(1))


def without(words: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """The words that are not stop words, repeated ones kept."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def with_bigrams(words: str) -> Column:
    """Words, then pairs of neighbours."""
    w = F.col(words)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def terms_of(df: DataFrame, stop: Sequence[str] | None = STOP_WORDS) -> DataFrame:
    """row_id and `terms`: words and bigrams of `text`; stop words leave before bigrams are made, so bigrams bridge them."""
    words = tokens(clean("text"))
    rows = df.select("row_id", (words if stop is None else without(words, stop)).alias("words"))
    return rows.select("row_id", with_bigrams("words").alias("terms"))


#: Bytes to lower letters, and blanks for all that is no letter of A-Z.
_LETTERS = np.full(256, ord(" "), np.uint8)
_LETTERS[list(range(97, 123))] = _LETTERS[list(range(65, 91))] = np.arange(97, 123)
#: Bytes of text whose words are counted at once.
_AT_ONCE = 8 << 20


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows of about `_AT_ONCE` bytes together; a text is never cut."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return (slice(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of `tokens(clean(text))` of texts without URLs, and the place of the text each is in."""
    data, offsets = buffers(texts)
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(_LETTERS[data])])
    split = pc.ascii_split_whitespace(clean)
    words, text = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    long = pc.greater_equal(pc.binary_length(words), 3)
    return words.filter(long), text[long.to_numpy(zero_copy_only=False)]


def _term_sums(batches: Iterator[pa.RecordBatch], stop: Sequence[str] | None) -> Iterator[pa.RecordBatch]:
    """term, tf, df of slices of texts: words that are no stop words and pairs of them."""
    for batch in batches:
        for rows in _slices(batch.column(0)):
            words, text = _words(batch.column(0)[rows])
            if stop:
                kept = pc.invert(pc.is_in(words, pa.array(stop, words.type)))
                words, text = words.filter(kept), text[kept.to_numpy(zero_copy_only=False)]
            if not len(words):
                continue
            coded = words.dictionary_encode()
            w, n, texts = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), rows.stop - rows.start
            near = np.flatnonzero(text[:-1] == text[1:])
            # A pair is first * n + second, a word n * n + word; all fit in 63 bits with the text beside them.
            keys = np.sort(np.concatenate([(w[near] * n + w[near + 1]) * texts + text[near], (w + n * n) * texts + text]))
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
            code = keys // texts
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            code, tf, df = code[first], np.diff(np.append(first, len(code))), np.add.reduceat(fresh.astype(np.int64), first)
            two = int(np.searchsorted(code, n * n))
            pairs = pc.binary_join_element_wise(coded.dictionary.take(pa.array(code[:two] // n)), coded.dictionary.take(pa.array(code[:two] % n)), pa.scalar(" ", words.type))
            terms = pa.concat_arrays([pairs, coded.dictionary.take(pa.array(code[two:] - n * n))])
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=["term", "tf", "df"])


def vocabulary(df: DataFrame, size: int = 15_000, least_docs: int = 10, most_share: float = 0.4, stop: Sequence[str] | None = STOP_WORDS) -> DataFrame:
    """term_id, term, tf, df: the `size` most frequent terms found in at least `least_docs` texts and `most_share` of all; numbered in alphabetical order."""
    n = df.count()
    # Every occurrence counts for tf, the first in its text for df too: added up by slices of a task, then by term.
    counted = df.select(_bare("text").alias("text")).mapInArrow(lambda b: _term_sums(b, stop), "term string, tf bigint, df bigint").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    fit = counted.where((F.col("df") >= least_docs) & (F.col("df") <= most_share * n))
    top = fit.orderBy(F.desc("tf"), "term").limit(size)
    # One task numbers the terms: at most `size` rows.
    return top.select((F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"), "term", "tf", "df")


def term_counts(df: DataFrame, vocab: DataFrame, stop: Sequence[str] | None = None) -> DataFrame:
    """row_id, term_id, tf over a fixed vocabulary. By default stop words are not left out here, unlike when learning."""
    occurring = terms_of(df, stop).select("row_id", F.explode_outer("terms").alias("term")).where("term is not null")
    # The vocabulary has a fixed size; only its terms are shuffled, as numbers.
    return occurring.join(F.broadcast(vocab.select("term_id", "term")), "term").groupBy("row_id", "term_id").agg(F.count("*").alias("tf"))


def packed_counts(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """row_id, ids, tfs: the cells of `term_counts`, those of each row in arrays by term_id; rows are not shuffled, so those of one row_id stay apart. Rows without a term are left out."""
    known = [(int(r.term_id), r.term.split(" ")) for r in vocab.select("term_id", "term").collect()]
    parts = sorted({w for _, t in known for w in t})
    place = {w: i for i, w in enumerate(parts)}
    single, size = np.full(len(parts) + 1, -1), max((t for t, _ in known), default=0) + 1
    for t, w in known:
        if len(w) == 1:
            single[place[w[0]]] = t
    pairs = sorted((place[w[0]] * len(parts) + place[w[1]], t) for t, w in known if len(w) == 2)
    codes, numbers = (np.array([x[i] for x in pairs] + [-1][: not pairs], np.int64) for i in (0, 1))
    sent = df.sparkSession.sparkContext.broadcast((parts, single, codes, numbers))

    def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the text, term_id and tf, in this order."""
        parts, single, codes, numbers = sent.value
        words, text = _words(texts)
        w = pc.fill_null(pc.index_in(words, pa.array(parts, words.type)), -1).to_numpy().astype(np.int64)
        near = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0) & (text[:-1] == text[1:]))
        code = w[near] * len(parts) + w[near + 1]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        two = codes[at] == code
        one = single[w]  # the last, at -1, is no term
        cells = np.sort(np.concatenate([text[one >= 0] * size + one[one >= 0], text[near[two]] * size + numbers[at[two]]]))
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        return cells[first] // size, cells[first] % size, np.diff(np.append(first, len(cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in _slices(whole.column(1)):
                b = whole.slice(rows.start, rows.stop - rows.start)
                text, ids, tfs = count(b.column(1))
                found, lens = np.unique(text, return_counts=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found)), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tfs))], names=["row_id", "ids", "tfs"])

    return df.select(F.col("row_id").cast("bigint").alias("row_id"), _bare("text").alias("text")).mapInArrow(run, "row_id bigint, ids array<int>, tfs array<int>")


def token_totals(df: DataFrame, counts: DataFrame) -> DataFrame:
    """row_id and n_tokens, 0 for texts without a term of the vocabulary."""
    sums = counts.groupBy("row_id").agg(F.sum("tf").alias("n_tokens"))
    return df.select("row_id").join(sums, "row_id", "left").select("row_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def passages(df: DataFrame, most_words: int = 200, least_words: int = 8, first: int | None = None) -> DataFrame:
    """row_id, piece (from 1), chunk, weight (words): paragraphs of at least `least_words` words, or the whole text, in slices of `most_words`; short slices are dropped. `first` keeps that many of each text."""
    blank = f"[{WHITE}]+"

    def split_words(c: Column) -> Column:
        return F.filter(F.split(c, blank), lambda w: w != "")

    paragraphs = F.filter(F.transform(F.split("text", "\n"), split_words), lambda p: F.size(p) >= least_words)
    rows = df.select("row_id", F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(split_words(F.col("text")))).alias("paragraphs"))
    sliced = F.flatten(F.transform("paragraphs", lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(p) / most_words).cast("int") - 1)), lambda j: F.slice(p, j * most_words + 1, most_words))))
    good = F.filter(sliced, lambda s: F.size(s) >= least_words)
    kept = good if first is None else F.slice(good, 1, first)
    return rows.select("row_id", F.posexplode_outer(kept).alias("at", "words")).where("words is not null").select("row_id", (F.col("at") + 1).alias("piece"), F.array_join("words", " ").alias("chunk"), F.size("words").cast("double").alias("weight"))
