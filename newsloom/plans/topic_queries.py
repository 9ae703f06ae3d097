"""Queries of the topic layer over passage vectors and term counts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import em_lda, models, quality, reports, text, topics
from ..session import cut, stamp, table
from . import corpus_queries as c

TOPICS = tuple(range(10))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, doc, w, v of the sound passage vectors."""
    rows = table(spark, folder, "fit_transformer_topics")
    return rows.where(topics.sound(F.col("emb"))).select(F.col("chunk_id").alias("id"), F.col("doc_index").alias("doc"), F.col("chunk_w").alias("w"), F.col("emb").alias("v"))


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    return topics.mean_centroids(table(spark, folder, "embeddings"), "embedding", "label")


def theta(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "download_fnspid").select(F.col("row_id").alias("doc"))
    known = vectors(spark, folder).where("doc is not null and w is not null")
    return topics.document_weights(docs, topics.soft_assign(known, centroids(spark, folder)), TOPICS)


class Base:
    """What queries need of texts and passages, each part made once and cut."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.articles = c.articles(spark, folder)

    @cached_property
    def vocab(self) -> DataFrame:
        return cut(text.vocabulary(self.articles, c.VOCABULARY))

    @cached_property
    def counts(self) -> DataFrame:
        return cut(text.term_counts(self.articles, self.vocab))

    @cached_property
    def theta(self) -> DataFrame:
        return cut(theta(self.spark, self.folder))

    @cached_property
    def hard(self) -> DataFrame:
        return topics.hard_topic(_rounded(self.theta)).withColumn("weight", F.lit(1.0))

    def phi(self, how: str = "hard") -> DataFrame:
        members = self.theta.withColumnRenamed("theta", "weight") if how == "soft" else topics.sparsify(_rounded(self.theta)) if how == "sparse" else self.hard
        return topics.ctfidf(self.counts, members, self.vocab, TOPICS, sublinear=how == "sublinear")

    def attention(self, how: str = "soft") -> DataFrame:
        weights = self.theta
        if how == "hard":
            best = self.hard.select("doc", F.col("topic").alias("best"))
            weights = weights.join(best, "doc").select("doc", "topic", F.when(F.col("topic") == F.col("best"), 1.0).otherwise(0.0).alias("theta"))
        totals = text.token_totals(self.articles, self.counts).withColumnRenamed("row_id", "doc")
        return topics.daily_attention(weights, self.articles.select(F.col("row_id").alias("doc"), "date").join(totals, "doc"))

    def tops(self, n: int = 10, how: str = "hard") -> DataFrame:
        return topics.top_terms(self.phi(how), self.vocab, n)


_TABLES = ("download_fnspid", "fit_transformer_topics", "embeddings")
_bases: dict[tuple, Base] = {}


def base_of(spark: SparkSession, folder: str) -> Base:
    """The parts made for a folder in this session, as long as its files stay the same; those of one folder are kept."""
    key = (spark.sparkContext.applicationId, folder, tuple(stamp(table(spark, folder, name)) for name in _TABLES))
    if key not in _bases:
        _bases.clear()
        _bases[key] = Base(spark, folder)
    return _bases[key]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("theta", F.round("theta", 9))


def topic_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids(spark, folder).select("topic", F.posexplode("centroid").alias("place", "x")).select("topic", "place", F.round("x", 6).alias("x"))


def doc_topic_weights(spark: SparkSession, folder: str) -> DataFrame:
    return theta(spark, folder).select("doc", "topic", F.round("theta", 6).alias("theta"))


def hard_topic(spark: SparkSession, folder: str) -> DataFrame:
    return base_of(spark, folder).hard.select("doc", "topic")


def sparsify(spark: SparkSession, folder: str) -> DataFrame:
    return topics.sparsify(_rounded(theta(spark, folder))).select("doc", "topic", F.round("weight", 6).alias("weight"))


def _phi(how: str):  # noqa: ANN202
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return base_of(spark, folder).phi(how).select("topic", "term_id", F.round("p", 8).alias("p"))

    query.__name__ = f"ctfidf_{how}"
    return query


def daily_attention(spark: SparkSession, folder: str) -> DataFrame:
    return base_of(spark, folder).attention().select("date", "topic", F.round("theta", 6).alias("theta"))


def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return base_of(spark, folder).tops().select("topic", "place", "term", F.round("p", 8).alias("p"))


def topic_labels(spark: SparkSession, folder: str) -> DataFrame:
    return topics.labels(base_of(spark, folder).tops(3))


def representative_passages(spark: SparkSession, folder: str) -> DataFrame:
    return topics.representatives(vectors(spark, folder), centroids(spark, folder), 20).select("topic", "place", "id", F.round("cosine", 6).alias("cosine"))


def npmi(spark: SparkSession, folder: str) -> DataFrame:
    base = base_of(spark, folder)
    return quality.npmi(cut(base.tops()), base.counts, base.articles.count()).select("topic", F.round("npmi", 6).alias("npmi"))


def diversity(spark: SparkSession, folder: str) -> DataFrame:
    return quality.diversity(base_of(spark, folder).tops()).select(F.round("diversity", 6).alias("diversity"))


def topic_cosine(spark: SparkSession, folder: str) -> DataFrame:
    base = base_of(spark, folder)
    return quality.cosines(base.phi(), base.phi("soft")).select("a", "b", F.round("cosine", 6).alias("cosine"))


def topic_matching(spark: SparkSession, folder: str) -> DataFrame:
    base = base_of(spark, folder)
    return quality.matching(quality.cosines(base.phi(), base.phi("soft")))


def attention_agreement(spark: SparkSession, folder: str) -> DataFrame:
    base = base_of(spark, folder)
    both = quality.agreement(base.attention(), base.attention("hard"))
    return both.select("topic", "n", *(F.round(x, 6).alias(x) for x in ("max_gap", "mean_gap", "r")))


def contract_check(spark: SparkSession, folder: str) -> DataFrame:
    base = base_of(spark, folder)
    return topics.contract(base.attention(), base.phi())


def sweep_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Coherence of the topics of each arm, and the diversity of their terms."""
    base, n, out = base_of(spark, folder), None, None
    n = base.articles.count()
    for arm in ("hard", "soft", "sparse"):
        tops = cut(base.tops(how=arm))
        scores = quality.npmi(tops, base.counts, n).select(F.lit(arm).alias("arm"), F.round("npmi", 9).alias("npmi"))
        one = quality.summary(scores, "arm", "npmi").crossJoin(quality.diversity(tops))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("arm", "n", *(F.round(x, 6).alias(x) for x in ("mean", "median", "sd", "diversity")))


def comparison_report(spark: SparkSession, folder: str) -> DataFrame:
    base = base_of(spark, folder)
    phi = cut(base.phi()), cut(base.phi("soft"))
    attention = cut(base.attention("hard")), cut(base.attention())
    report = reports.comparison(phi, tuple(topics.top_terms(p, base.vocab) for p in phi), attention)
    return report.select("measure", *(F.round(c, 6).alias(c) for c in ("baseline", "candidate", "mean", "median", "least")))


def topic_model(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the whole fit with sparse weights, in one call."""
    base = base_of(spark, folder)
    totals = text.token_totals(base.articles, base.counts).withColumnRenamed("row_id", "doc")
    docs = cut(base.articles.select(F.col("row_id").alias("doc"), "date").join(totals, "doc"))
    return topics.fit_topics(vectors(spark, folder), docs, base.counts, base.vocab, centroids(spark, folder), "sparse")["labels"]


def kmeans_spherical(spark: SparkSession, folder: str) -> DataFrame:
    return models.kmeans(vectors(spark, folder), len(TOPICS), "cosine")


def kmeans_euclid(spark: SparkSession, folder: str) -> DataFrame:
    return models.kmeans(vectors(spark, folder), len(TOPICS), "euclidean")


def lda_online(spark: SparkSession, folder: str) -> DataFrame:
    return models.lda(base_of(spark, folder).counts, c.VOCABULARY, 8, "online")[1]


def lda_em(spark: SparkSession, folder: str) -> DataFrame:
    """By EM, from counts that are packed as the texts are read."""
    base = base_of(spark, folder)
    return em_lda.fit(text.packed_counts(base.articles, base.vocab), c.VOCABULARY, 8, documents=base.articles.count())[1]


def hashed_passages(spark: SparkSession, folder: str) -> DataFrame:
    return models.encode(text.passages(c.articles(spark, folder)))


QUERIES = {
    f.__name__: f
    for f in (
        topic_centroids, doc_topic_weights, hard_topic, sparsify, _phi("hard"), _phi("soft"), _phi("sublinear"), _phi("sparse"), daily_attention, top_terms, topic_labels, representative_passages,
        npmi, diversity, topic_cosine, topic_matching, attention_agreement, contract_check, sweep_summary, comparison_report, topic_model, kmeans_spherical, kmeans_euclid, lda_online, lda_em, hashed_passages,
    )
}

THETA_SQL = """
places as (select cast(label as int) as topic, i, avg(cast(embedding[i] as double)) as x from embeddings, range(1, 65) r(i) group by 1, 2),
centroids as (select topic, list(x / norm order by i) as c from (select topic, i, x, sqrt(sum(x * x) over (partition by topic)) as norm from places) group by topic),
vectors as (
  select chunk_id as id, doc_index as doc, chunk_w as w, cast(emb as double[]) as v from fit_transformer_topics
  where emb is not null and len(emb) = 64 and len(list_filter(emb, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(emb, lambda x: x <> 0)) > 0),
scored as (select id, doc, w, topic, list_cosine_similarity(v, c) as cosine from vectors, centroids),
shares as (select id, doc, w, topic, exp(cosine / 0.07e0 - m) / sum(exp(cosine / 0.07e0 - m)) over (partition by id) as p from (select *, max(cosine / 0.07e0) over (partition by id) as m from scored)),
sums as (select doc, topic, sum(w * p) as s from shares where doc is not null and w is not null group by doc, topic),
docs as (select row_id as doc from download_fnspid),
theta as (select d.doc, t.topic, coalesce(s.s / sum(s.s) over (partition by d.doc), 1e0 / 10) as theta from docs d cross join (select cast(range as int) as topic from range(10)) t left join sums s on s.doc = d.doc and s.topic = t.topic),
hard as (select doc, topic from theta qualify row_number() over (partition by doc order by round(theta, 9) desc, topic) = 1)
"""
SPARSE_SQL = """
ranked as (select doc, topic, round(theta, 9) as theta, row_number() over (partition by doc order by round(theta, 9) desc, topic) as place from theta),
largest as (select doc, topic, place, case when place <= 2 then pow(theta, 2e0) else 0e0 end as t, round(max(case when place = 1 then theta end) over (partition by doc) - max(case when place = 2 then theta end) over (partition by doc), 12) as margin from ranked),
cutoff as (select round(quantile_cont(cast(margin as double), 0.5), 12) as c from largest where place = 1),
sparse as (select doc, topic, case when margin >= c then t / sum(t) over (partition by doc) * margin else 0e0 end as weight from largest, cutoff)
"""
_BOTH = c.VOCAB_SQL + "," + THETA_SQL


def _phi_sql(how: str, name: str = "phi") -> str:
    members = {"soft": "select doc as row_id, topic, theta as weight from theta", "sparse": "select doc as row_id, topic, weight from sparse"}.get(how, "select doc as row_id, topic, 1e0 as weight from hard")
    g = "1 + ln(tf)" if how == "sublinear" else "tf"
    return f"""
members_{name} as ({members}),
part_{name} as (select topic, term_id, sum(weight * ({g})) as s from counts join members_{name} using (row_id) group by topic, term_id),
dense_{name} as (select t.topic, v.term_id, coalesce(p.s, 0) + 1e0 as tf from (select cast(range as int) as topic from range(10)) t cross join vocab v left join part_{name} p on p.topic = t.topic and p.term_id = v.term_id),
raw_{name} as (select topic, term_id, tf * ln(1 + (select sum(tf) / 10 from dense_{name}) / sum(tf) over (partition by term_id)) as w from dense_{name}),
{name} as (select topic, term_id, w / sum(w) over (partition by topic) as p from raw_{name})
"""


_ATTENTION = """
dated as (select row_id as doc, date, greatest(n_tokens, 1) as w from articles join totals using (row_id)),
attention as (select date, topic, sum(w * theta) / sum(w) as theta from theta join dated using (doc) group by date, topic),
attention_hard as (select date, t.topic, sum(w * case when h.topic = t.topic then 1e0 else 0e0 end) / sum(w) as theta from theta t join hard h using (doc) join dated using (doc) group by date, t.topic)
"""
_TOPS = "tops as (select topic, place, term_id, term, p from (select topic, term_id, p, cast(row_number() over (partition by topic order by round(p, 12) desc, term_id) as int) as place from phi) join vocab using (term_id) where place <= 10)"
_HARD = f"with {_BOTH}, {_phi_sql('hard')}, {_TOPS}"
_TWO = f"with {_BOTH}, {_phi_sql('hard')}, {_phi_sql('soft', 'phi_soft')}"



def _arm_sql(how: str) -> str:
    return f"""{_phi_sql(how, f"phi_{how}")},
tops_{how} as (select topic, term_id from (select topic, term_id, row_number() over (partition by topic order by round(p, 12) desc, term_id) as place from phi_{how}) where place <= 10),
pairs_{how} as (select a.topic, a.term_id as i, b.term_id as j from tops_{how} a join tops_{how} b on a.topic = b.topic and a.term_id < b.term_id),
met_{how} as (select i, j, count(*) as co from (select distinct i, j from pairs_{how}) p join counts x on x.term_id = p.i join counts y on y.term_id = p.j and y.row_id = x.row_id group by i, j),
probs_{how} as (select topic, coalesce(co, 0) / n + 1e-12 as p, coalesce(di.df, 0) / n + 1e-12 as pi, coalesce(dj.df, 0) / n + 1e-12 as pj from pairs_{how} cross join n left join met_{how} using (i, j) left join df di on di.term_id = i left join df dj on dj.term_id = j),
npmi_{how} as (select topic, round(avg(ln(p / (pi * pj)) / -ln(p)), 9) as v from probs_{how} group by topic),
summary_{how} as (select '{how}' as arm, count(*) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, round(stddev_samp(v), 6) as sd, (select round(count(distinct term_id) / count(*)::double, 6) from tops_{how}) as diversity from npmi_{how})"""


ORACLE = {
    "topic_centroids": f"with {THETA_SQL} select topic, cast(i - 1 as int) as place, round(c[i], 6) as x from (select topic, c, unnest(range(1, 65)) as i from centroids)",
    "doc_topic_weights": f"with {THETA_SQL} select doc, topic, round(theta, 6) as theta from theta",
    "hard_topic": f"with {THETA_SQL} select doc, topic from hard",
    "sparsify": f"with {THETA_SQL}, {SPARSE_SQL} select doc, topic, round(weight, 6) as weight from sparse",
    "ctfidf_sparse": f"with {_BOTH}, {SPARSE_SQL}, {_phi_sql('sparse')} select topic, term_id, round(p, 8) as p from phi",
    **{f"ctfidf_{how}": f"with {_BOTH}, {_phi_sql(how)} select topic, term_id, round(p, 8) as p from phi" for how in ("hard", "soft", "sublinear")},
    "daily_attention": f"with {_BOTH}, {_ATTENTION} select date, topic, round(theta, 6) as theta from attention",
    "top_terms": f"{_HARD} select topic, place, term, round(p, 8) as p from tops",
    "topic_labels": f"{_HARD} select topic, string_agg(term, ' / ' order by place) as label from tops where place <= 3 group by topic",
    "representative_passages": f"with {THETA_SQL} select topic, cast(place as int) as place, id, round(cosine, 6) as cosine from (select topic, id, round(cosine, 9) as cosine, row_number() over (partition by topic order by round(cosine, 9) desc, id) as place from scored) where place <= 20",
    "npmi": f"""{_HARD},
n as (select count(*)::double as n from articles),
term_pairs as (select a.topic, a.term_id as i, b.term_id as j from tops a join tops b on a.topic = b.topic and a.term_id < b.term_id),
met as (select i, j, count(*) as co from (select distinct i, j from term_pairs) p join counts x on x.term_id = p.i join counts y on y.term_id = p.j and y.row_id = x.row_id group by i, j),
df as (select term_id, count(*) as df from counts group by term_id),
probs as (select topic, coalesce(co, 0) / n + 1e-12 as p, coalesce(di.df, 0) / n + 1e-12 as pi, coalesce(dj.df, 0) / n + 1e-12 as pj from term_pairs cross join n left join met using (i, j) left join df di on di.term_id = i left join df dj on dj.term_id = j)
select topic, round(avg(ln(p / (pi * pj)) / -ln(p)), 6) as npmi from probs group by topic""",
    "diversity": f"{_HARD} select round(count(distinct term_id) / count(*)::double, 6) as diversity from tops",
    "topic_cosine": f"{_TWO} select a.topic as a, b.topic as b, round(sum(a.p * b.p) / (sqrt(sum(a.p * a.p)) * sqrt(sum(b.p * b.p))), 6) as cosine from phi a join phi_soft b using (term_id) group by 1, 2",
    "attention_agreement": f"with {_BOTH}, {_ATTENTION} select topic, count(*) as n, round(max(abs(a.theta - b.theta)), 6) as max_gap, round(avg(abs(a.theta - b.theta)), 6) as mean_gap, round(corr(a.theta, b.theta), 6) as r from attention a join attention_hard b using (date, topic) group by topic",
    "contract_check": f"""with {_BOTH}, {_ATTENTION}, {_phi_sql('hard')}
select 'theta_negative' as "check", count(*) as broken from attention where theta < -1e-6
union all select 'theta_simplex', count(*) from (select date from attention group by date having abs(sum(theta) - 1) > 1e-4)
union all select 'phi_simplex', count(*) from (select topic from phi group by topic having abs(sum(p) - 1) > 1e-4)""",
    "sweep_summary": f"with {_BOTH}, {SPARSE_SQL}, n as (select count(*)::double as n from articles), df as (select term_id, count(*) as df from counts group by term_id), {', '.join(_arm_sql(how) for how in ('hard', 'soft', 'sparse'))} select * from summary_hard union all select * from summary_soft union all select * from summary_sparse",
}
