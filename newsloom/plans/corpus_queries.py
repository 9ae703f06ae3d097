"""Queries over raw news rows: filters, deduplication, samples, tokens, vocabulary, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, text
from ..session import table

#: Terms of the shared vocabulary, as in the reference (VOCAB_SIZE).
VOCABULARY = 15_000


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.raw_filter(table(spark, folder, "download_fnspid", spread=True))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, date, text of the rows with a long body."""
    return corpus.whole_text(corpus.long_bodies(raw(spark, folder)))


def raw_filter(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder)


def short_body_filter(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.long_bodies(raw(spark, folder)).select("row_id", "date", "symbol")


def greedy_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.greedy_dedupe(corpus.long_bodies(raw(spark, folder))).select("row_id", "date", "url")


def per_day_sample(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.day_sample(corpus.long_bodies(raw(spark, folder))).select("row_id", "date", "sample_key")


def vocab_sample(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.seeded_sample(articles(spark, folder), 60_000).select("row_id")


def concat_text(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder)


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("row_id", text.clean("text").alias("cleaned"))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("row_id", F.array_join(text.tokens(text.clean("text")), " ").alias("tokens"))


def stopword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("row_id", F.array_join(text.without(text.tokens(text.clean("text"))), " ").alias("tokens"))


def bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return text.terms_of(articles(spark, folder)).select("row_id", F.array_join("terms", "|").alias("terms"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vocab(spark, folder)


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return text.vocabulary(articles(spark, folder), VOCABULARY)


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return text.term_counts(articles(spark, folder), vocab(spark, folder))


def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    return text.token_totals(articles(spark, folder), term_counts(spark, folder))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return text.passages(articles(spark, folder))


def first_k_passages(spark: SparkSession, folder: str) -> DataFrame:
    return text.passages(articles(spark, folder), first=3)


QUERIES = {f.__name__: f for f in (raw_filter, short_body_filter, greedy_dedupe, per_day_sample, vocab_sample, concat_text, clean_text, tokens, stopword_filter, bigrams, vocabulary, term_counts, token_totals, passages, first_k_passages)}

_WHITE = "\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_NULLS = _quoted(corpus.NULL_TOKENS)
RAW_SQL = f"""
known as (
  select row_id, {", ".join(f"case when {c} not in ({_NULLS}) then {c} end as {n}" for c, n in (("Date", "stamp"), ("Article_title", "title"), ("Stock_symbol", "symbol"), ("Url", "url"), ("Article", "body")))}
  from download_fnspid),
raw as (
  select row_id, substring(stamp, 1, 10) as date, title, symbol, url, body from known
  where regexp_full_match(substring(stamp, 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') and substring(stamp, 1, 10) between '2015-01-01' and '2023-12-31'
    and regexp_full_match(symbol, '[A-Z][A-Z0-9.\\-]{{0,7}}') and body is not null),
long as (select * from raw where length(body) >= 400),
articles as (select row_id, date, coalesce(title, '') || '. ' || coalesce(body, '') as text from long)
"""
TEXT_SQL = f"""{RAW_SQL},
cleaned as (
  select row_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, 'https?://[^{_WHITE}]+', ' ', 'g'), '[^A-Za-z{_WHITE}]', ' ', 'g')), '[{_WHITE}]+', ' ', 'g')) as cleaned from articles),
tokens as (select row_id, regexp_extract_all(cleaned, '[a-z]{{3,}}') as words from cleaned),
stopped as (select row_id, list_filter(words, lambda w: w not in ({_quoted(text.STOP_WORDS)})) as words from tokens)
"""


def _terms(source: str) -> str:
    return f"select row_id, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as terms from {source}"


VOCAB_SQL = f"""{TEXT_SQL},
learned as ({_terms("stopped")}),
pairs as (select row_id, term, count(*) as tf from (select row_id, unnest(terms) as term from learned) group by row_id, term),
frequent as (
  select term, cast(sum(tf) as bigint) as tf, count(*) as df from pairs group by term
  having count(*) >= 10 and count(*) <= 0.4e0 * (select count(*) from articles) order by sum(tf) desc, term limit {VOCABULARY}),
vocab as (select cast(row_number() over (order by term) - 1 as int) as term_id, term, tf, df from frequent),
counted as ({_terms("tokens")}),
counts as (select row_id, term_id, count(*) as tf from (select row_id, unnest(terms) as term from counted) join vocab using (term) group by row_id, term_id),
totals as (select row_id, coalesce(sum(c.tf), 0)::bigint as n_tokens from articles left join counts c using (row_id) group by row_id)
"""


def _passages(first: str) -> str:
    words = f"list_filter(string_split_regex(%s, '[{_WHITE}]+'), lambda x: x <> '')"
    return f"""with {RAW_SQL},
split as (select row_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {words % "p"}), lambda p: len(p) >= 8) as good, {words % "text"} as whole from articles),
used as (select row_id, case when len(good) > 0 then good else [whole] end as ps from split),
sliced as (select row_id, list_filter(flatten(list_transform(ps, lambda p: list_transform(range(0, greatest(1, (len(p) + 199) // 200)), lambda j: p[j * 200 + 1:j * 200 + 200]))), lambda s: len(s) >= 8){first} as s from used)
select row_id, cast(i as int) as piece, array_to_string(s[i], ' ') as chunk, cast(len(s[i]) as double) as weight from (select row_id, s, unnest(range(1, len(s) + 1)) as i from sliced)"""


ORACLE = {
    "raw_filter": f"with {RAW_SQL} select row_id, date, title, symbol, url, body from raw",
    "short_body_filter": f"with {RAW_SQL} select row_id, date, symbol from long",
    "greedy_dedupe": f"""with recursive {RAW_SQL},
numbered as (select row_number() over (order by row_id) as k, row_id, date, url, md5(coalesce(url, '')) as u, md5(date || '|' || coalesce(title, '')) as t from long),
walk as (
  select 0::bigint as k, false as kept, []::varchar[] as us, []::varchar[] as ts
  union all
  select n.k, not (list_contains(w.us, n.u) or list_contains(w.ts, n.t)),
    case when list_contains(w.us, n.u) or list_contains(w.ts, n.t) then w.us else list_append(w.us, n.u) end,
    case when list_contains(w.us, n.u) or list_contains(w.ts, n.t) then w.ts else list_append(w.ts, n.t) end
  from walk w join numbered n on n.k = w.k + 1)
select row_id, date, url from numbered join (select k from walk where kept) using (k)""",
    "per_day_sample": f"""with {RAW_SQL},
keyed as (select row_id, date, md5('corpus-v1' || coalesce(url, '') || '#' || row_id) as sample_key from long)
select row_id, date, sample_key from keyed qualify row_number() over (partition by date order by sample_key, row_id) <= 120""",
    "vocab_sample": f"with {RAW_SQL} select row_id from articles order by md5('vocab-v1' || row_id), row_id limit 60000",
    "concat_text": f"with {RAW_SQL} select row_id, date, text from articles",
    "clean_text": f"with {TEXT_SQL} select row_id, cleaned from cleaned",
    "tokens": f"with {TEXT_SQL} select row_id, array_to_string(words, ' ') as tokens from tokens",
    "stopword_filter": f"with {TEXT_SQL} select row_id, array_to_string(words, ' ') as tokens from stopped",
    "bigrams": f"with {TEXT_SQL}, learned as ({_terms('stopped')}) select row_id, array_to_string(terms, '|') as terms from learned",
    "vocabulary": f"with {VOCAB_SQL} select term_id, term, tf, df from vocab",
    "term_counts": f"with {VOCAB_SQL} select row_id, term_id, tf from counts",
    "token_totals": f"with {VOCAB_SQL} select row_id, n_tokens from totals",
    "passages": _passages(""),
    "first_k_passages": _passages("[1:3]"),
}
