"""Queries of the operators on training text, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut, table
from . import clusters, encoding, leakage, near_duplicates, site_lines, splitting, term_counts, truncation

#: Where the public tokenizers' vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.term_counts(table(spark, folder, "download_fnspid", spread=True))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark is not null").select("term", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, folder, "download_fnspid", spread=True)).expanded()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, folder, "download_fnspid", spread=True)).groups()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_texts(table(spark, folder, "download_fnspid", spread=True))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(table(spark, folder, "download_fnspid", spread=True))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.SiteLines(table(spark, folder, "download_fnspid", spread=True)).found()


def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.SiteLines(table(spark, folder, "download_fnspid", spread=True)).cleaned()


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.SiteLines(table(spark, folder, "download_fnspid", spread=True)).blocks()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.LinkedClusters(table(spark, folder, "fit_transformer_topics", spread=True)).found()


def p7_described(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.LinkedClusters(table(spark, folder, "fit_transformer_topics", spread=True)).described()


def p7_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.KMeans(cut(clusters.pack(table(spark, folder, "fit_transformer_topics", spread=True)))).describe()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_texts(table(spark, folder, "documents", spread=True), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents", spread=True), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(p9_leaks(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.Truncation(table(spark, folder, "documents", spread=True)).found()


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.Truncation(table(spark, folder, "documents", spread=True)).by_source()


QUERIES = {f.__name__: f for f in (p1_terms, p1_found, p3_found, p3_groups, p5_pieces, p5_found, p6_found, p6_cleaned, p6_blocks, p7_found, p7_described, p7_clusters, p8_ids, p9_leaks, p9_found, p10_found, p10_sources)}

_WHITE = "\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_TERMS = f"""
with texts as (select row_number() over () as k, Article as t from download_fnspid where Article is not null),
found as (select k, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(t, 'https?://[^{_WHITE}]+', ' ', 'g'), '[^A-Za-z]', ' ', 'g')), '[a-z]{{3,}}')) as term from texts),
counts as (select term, count(*) as tf, count(distinct k) as df from found group by term),
marked as (select term, tf, df, case when df < 10 then 'rare' when df * 10000 > 4000 * (select count(*) from texts) then 'common' end as mark from counts)
"""
_ITEM_WORDS = """
with docs as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), '[a-z0-9]+') as w from documents where text is not null),
items as (select item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), '[a-z0-9]+') as w from eval_items where text is not null),
doc_runs as (select doc_id, array_to_string(w[i:i + 11], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from docs)),
item_runs as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as run from (select item_id, w, unnest(range(1, len(w) - 10)) as i from items))
"""
_LINES = f"""
with counted as (
  select row_id, Article, regexp_replace(regexp_extract(lower(trim(Url)), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), '^www\\.', '') as site
  from download_fnspid where Article is not null and Url is not null),
lines as (
  select row_id, site, unnest(string_split(Article, chr(10))) as line, unnest(range(1, 1 + len(string_split(Article, chr(10))))) as line_no
  from counted where site <> ''),
bare as (select row_id, site, line_no, regexp_replace(line, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') as line from lines),
sizes as (select site, count(*) as n from counted where site <> '' group by site),
repeated as (
  select site, line from bare join sizes using (site) where line <> '' group by site, line, n having count(distinct row_id) >= greatest(4, n / 10e0))
"""
ORACLE = {
    "p1_terms": _TERMS + "select term, tf, df, mark from marked",
    "p1_found": _TERMS + "select term, mark from marked where mark is not null",
    "p5_found": """
with long as (select row_id, regexp_replace(Article, '([.!?])[\\x{0009}\\x{000B}\\x{000C}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '\\1' || chr(10), 'g') as t from download_fnspid where length(Article) > 3000)
select row_id, case when list_max(list_transform(string_split_regex(t, '[\\r\\n]'), lambda s: length(s))) > 3000 then 'forced' else 'natural' end as need from long""",
    "p5_pieces": f"""
with recursive points as (
  select row_id, unnest(c) as c, unnest(range(1, len(c) + 1)) as p from (select row_id, regexp_extract_all(Article, '(?s).') as c from download_fnspid where length(Article) > 3000)),
seen as (
  select row_id, p, regexp_full_match(c, '[{_WHITE}]') as space, c in (chr(10), chr(13)) as line, lag(c) over w in ('.', '!', '?') as after, c = chr(13) and lead(c) over w = chr(10) as pair
  from points window w as (partition by row_id order by p)),
inked as (select *, sum(case when space then 0 else 1 end) over (partition by row_id order by p) as ink from seen),
line_ends as (select row_id, p, case when lag(ink) over (partition by row_id order by p) = ink then 4 else 3 end::bigint as strength from inked where line and not coalesce(pair, false)),
bounds as (
  select row_id, p as place, strength from line_ends
  union all select row_id, p, case when after then 2 else 1 end::bigint from inked where space and not line),
walk as (
  select row_id, length(Article)::int as n_chars, 0 as piece_no, 0::bigint as begin, null::bigint as key from download_fnspid where length(Article) > 0
  union all
  select w.row_id, w.n_chars, w.piece_no + 1, x.key % 1000000000 - 200, x.key
  from walk w join lateral (
    select case when late >= 2000000000 then late when early is not null then early else coalesce(late, w.begin + 3000) end as key
    from (select max(case when place >= w.begin + 1500 then strength * 1000000000 + place end) as late, max(case when place < w.begin + 1500 and strength >= 2 then strength * 1000000000 + place end) as early
          from bounds b where b.row_id = w.row_id and place between w.begin + 201 and w.begin + 3000)) x on true
  where w.n_chars - w.begin > 3000),
ends as (select row_id, n_chars, piece_no, begin, lead(key) over (partition by row_id order by piece_no) as key from walk)
select row_id, n_chars, cast(piece_no as int) as piece_no, cast(begin as int) as begin, cast(coalesce(key % 1000000000, n_chars) as int) as "end",
  case when key is null then 'end' else ['inside', 'space', 'sentence', 'line', 'blank line'][key // 1000000000 + 1] end as cut,
  substring(Article, begin + 1, coalesce(key % 1000000000, n_chars) - begin) as piece
from ends join download_fnspid using (row_id)""",
    "p6_found": _LINES + "select row_id, cast(line_no as int) as line_no from bare join repeated using (site, line)",
    "p6_cleaned": _LINES + """, gone as (select row_id, line_no from bare join repeated using (site, line)),
removed as (select row_id, count(*) as n_removed from gone group by row_id),
kept as (select row_id, string_agg(line, chr(10) order by line_no) as t from (select l.row_id, l.line_no, l.line from lines l anti join gone g on g.row_id = l.row_id and g.line_no = l.line_no) group by row_id)
select d.row_id, case when n_removed is null then d.Article else coalesce(t, '') end as Article, cast(coalesce(n_removed, 0) as int) as n_removed
from download_fnspid d left join removed using (row_id) left join kept using (row_id)""",
    "p6_blocks": _LINES.replace("with counted", "with recursive counted") + """,
ink as (select site, row_id, line, row_number() over (partition by row_id order by line_no) as k from bare where line <> ''),
grown as (
  select i.site, i.row_id, i.k, 1 as n_lines, i.line as block from ink i join repeated r on r.site = i.site and r.line = i.line
  union all
  select g.site, u.row_id, u.k, g.n_lines, g.block
  from (
    select p.site, p.n_lines + 1 as n_lines, p.block || chr(10) || i.line as block, s.n, list({'row_id': p.row_id, 'k': p.k}) as at
    from grown p join ink i on i.row_id = p.row_id and i.k = p.k + p.n_lines join sizes s on s.site = p.site
    group by p.site, p.n_lines, p.block || chr(10) || i.line, s.n having count(distinct p.row_id) >= greatest(4, s.n / 10e0)) g, unnest(g.at) as t(u)),
longest as (select site, row_id, k, max(n_lines) as n_lines, max_by(block, n_lines) as block from grown group by site, row_id, k),
starts as (select l.* from longest l left join longest b on b.row_id = l.row_id and b.k = l.k - 1 where coalesce(b.n_lines, 0) <= l.n_lines),
rows_of as (select site, block, count(distinct row_id) as n_rows from grown group by site, block)
select site, block, cast(any_value(n_lines) as int) as n_lines, any_value(n_rows) as n_rows, any_value(n) as of_rows from starts join rows_of using (site, block) join sizes using (site) group by site, block""",
    "p9_found": _ITEM_WORDS + "select distinct doc_id, item_id from doc_runs join item_runs using (run)",
}
