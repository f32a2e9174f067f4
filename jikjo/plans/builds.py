"""Builds from end to end: long-text projections, sources weighted by quality, gated rows, evaluation and profiles by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jikjo.functions import lexicon as L
from jikjo.functions import tagger
from jikjo.functions import text as T
from jikjo.operators import chunking, metrics, quality, sampling
from jikjo.plans import evaluation
from jikjo.plans import registry as R
from jikjo.plans.corpus import lambada_items
from jikjo.plans.mining import DOCS, SCORED, docs
from jikjo.plans.registry import SQL, query, table
from jikjo.sources import catalog as C
from jikjo.storage import stored

# --- C3, C7: projections of long texts ---------------------------------------------

_RICH = "(" + " + ".join(f"cast(contains(lower(text), '{i}') as int)" for i in L.INDICATORS) + ") >= 2"
_LIST = "array_to_string(list_filter(document_list, lambda p: p is not null), ' ')"
_LONG = f"""select 'wiki_coref' as kind, row_id as id, {R.strip('text')} as text from raw_text where source_name = 'wiki_ko' and {_RICH}
  union all select 'news_long', article_id, {R.strip("concat(coalesce(site, ''), ' ', coalesce(document, ''))")} from naver_news where length({R.strip("concat(coalesce(site, ''), ' ', coalesce(document, ''))")}) >= 500
  union all select 'news_topic', article_id, {R.strip("concat(coalesce(site, ''), ' ', coalesce(document, ''), ' ', coalesce(" + _LIST + ", ''))")} from naver_news
  union all select 'news_topic_short', article_id, {R.strip("concat(coalesce(site, ''), ' ', coalesce(document, " + _LIST + ", ''))")} from naver_news
  union all select 'qa_long', row_id, {R.strip("concat(coalesce(context, ''), ' ', coalesce(question, ''), ' ', coalesce(answers.text[1], ''))")} from qa_context
  union all select 'pair', item_id, {R.strip("concat(coalesce(text, context), ' ', coalesce(target, answer))")} from lambada where coalesce(text, context, '') <> '' and coalesce(target, answer, '') <> ''"""


def long_texts(spark: SparkSession, d: str) -> DataFrame:
    """kind, id, text: what each kind of source gives as one long text, of 50 characters or more.

    The tables have no titles; an article's site stands for one, its paragraphs for a body.
    """
    blank = F.lit("")
    news, raw, qa, lam = (table(spark, d, n) for n in ("naver_news", "raw_text", "qa_context", "lambada"))
    body = F.array_join(F.filter("document_list", lambda p: p.isNotNull()), " ")

    def of(kind: str, rows: DataFrame, key: str, *parts) -> DataFrame:
        joined = T.strip(F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:]))
        return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), joined.alias("text"))

    site, first = F.coalesce("site", blank), F.coalesce("document", blank)
    a, b = F.coalesce("text", "context"), F.coalesce("target", "answer")
    every = of("wiki_coref", raw.where((F.col("source_name") == "wiki_ko") & quality.indicator_rich(F.col("text"))), "row_id", F.col("text"))
    every = every.union(of("news_long", news, "article_id", site, first).where(F.length("text") >= 500))
    every = every.union(of("news_topic", news, "article_id", site, first, F.coalesce(body, blank)))
    every = every.union(of("news_topic_short", news, "article_id", site, F.coalesce("document", body, blank)))
    every = every.union(qa.select(F.lit("qa_long"), "row_id", C.qa_text()))
    every = every.union(of("pair", lam.where((a != "") & (b != "")), "item_id", a, b))
    return every.where(F.length("text") >= 50)


@query(f"select * from ({_LONG}) where length(text) >= 50")
def c7_long_projections(spark, d):
    """The long text of each kind of source."""
    return long_texts(spark, d)


# --- N3: sources of a domain, down-sampled by quality --------------------------------

#: Rows of a source from which it is down-sampled, and to how many.
DOMAIN_ROWS = 1000


def domain_texts(spark: SparkSession, d: str, length: int = 512, most: int = DOMAIN_ROWS, seed: int = 42) -> DataFrame:
    """kind, id, k, text: chunks (F3) of the texts within the bounds of a length in words (D4); of a kind with over ``most`` as many drawn by quality (I8)."""
    n = F.size(T.words(F.col("text")))
    rows = long_texts(spark, d).distinct().where(n.between(int(0.4 * length), int(1.8 * length)))
    chunks = rows.select("kind", "id", F.posexplode(chunking.loose(T.scan_sentences(F.col("text")), length)).alias("k", "text"))
    row = F.struct("kind", "id", "k", "text")
    scored = quality.vector(chunks.withColumn("row", row), "row", "text").select("row.*", "coref_score")
    scored = stored(scored.withColumn("key", F.concat_ws(":", "kind", "id", "k", F.xxhash64("text"))), "domain-chunks")
    out = None
    for kind, many in sorted((r.kind, r["count"]) for r in scored.groupBy("kind").count().collect()):  # a row for each kind
        mine = scored.where(F.col("kind") == kind)
        mine = sampling.weighted(mine, "key", F.greatest(F.lit(1e-6), F.col("coref_score")), most, seed) if many > most else mine
        out = mine if out is None else out.union(mine)
    return (scored if out is None else out).select("kind", "id", F.col("k").cast("long").alias("k"), "text", "coref_score")


@query()
def n3_domain_texts(spark, d):
    """C7, D1, D4, F3 and I8 in one build, at a length of 128 words."""
    return domain_texts(spark, d, 128)


# --- N6: rows whose decoded head passes a gate -----------------------------------------

#: Words of a row that are analysed, rows that are (I2): the build's own limits.
HEAD_WORDS, ANALYSED = 300, 500
_HEADS = f"(select doc_id, array_to_string({R.words('text')}[1:{HEAD_WORDS}], ' ') as text from (select doc_id, text, row_number() over (order by doc_id) as r, count(*) over () as n from documents where text is not null) where (r - 1) % greatest(1, n // {ANALYSED}) = 0 and (r - 1) // greatest(1, n // {ANALYSED}) < {ANALYSED})"
_GATED = f"""(select doc_id from (select doc_id, count(*) filter (tag = 'NP') as p, count(*) filter (tag in ('NNG', 'NNP', 'NNB') and length(form) > 1) as e, count(*) filter (tag in ('NP', 'NNG', 'NNP', 'NNB', 'VV', 'MAG')) as w
    from {R.tokens(_HEADS, 'doc_id')} group by doc_id) where p / greatest(1, w) > 0.008e0 and least(1.0e0, p / greatest(1, w) * 20 + e / greatest(1, w) * 3 + p / greatest(1, w) * e / greatest(1, w) * 50) > 0.3e0)"""


def gated_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows (I2: strided, bounded) whose decoded head (F16) passes D17; all rows if none does."""
    some = sampling.strided(rows.select(key, text), key, ANALYSED, capped=True)
    heads = some.select(key, F.array_join(F.slice(T.words(F.col(text)), 1, HEAD_WORDS), " ").alias("head"))
    v = quality.vector(heads, key, "head")
    good = stored(v.where((F.col("pronoun_density") > 0.008) & (F.col("coref_score") > 0.3)).select(key), "gated-rows")  # at most ANALYSED
    return rows.join(good, key, "left_semi") if good.limit(1).count() else rows


@query(f"select doc_id, source from documents where text is not null and (doc_id in {_GATED} or not exists (select 1 from {_GATED}))")
def n6_gated_rows(spark, d):
    """I2, F16, G2, D17 and J3, with the fallback to all rows."""
    return gated_rows(docs(spark, d), "doc_id", "text").select("doc_id", "source")


# --- N12: an evaluation from end to end ---------------------------------------------------

_NEW = f"""(select a.model, a.at_1, a.at_5, f.f1, round(a.at_1 * 0.4e0 + a.at_5 * 0.3e0 + f.f1 * 0.3e0, 6) as score from ({SQL['g16_accuracy_at_k']}) a join ({SQL['g18_set_f1']}) f using (model))"""
#: Results of an earlier evaluation: one model is evaluated again, the other stays.
EARLIER = [("frequent", 0.1, 0.2, 0.05, 0.115), ("previous", 0.2, 0.3, 0.1, 0.2)]
_OLD = "(values " + ", ".join(f"('{m}', {a}e0, {b}e0, {c}e0, {s}e0)" for m, a, b, c, s in EARLIER) + ") o(model, at_1, at_5, f1, score)"


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """model, at_1, at_5, f1, score of the predictions of every model."""
    items, predictions = lambada_items(spark, d), evaluation.predictions(spark, d)
    hits = metrics.accuracy(items.select("item_id", "t"), predictions, "item_id", "t", [1, 5]).drop("n")
    nouns = F.array_distinct(F.transform(F.filter("__t", lambda t: t["tag"].isin("NNG", "NNP") & (F.length(t["form"]) >= 2)), lambda t: t["form"]))
    gold = items.select("item_id", tagger.tokens(F.col("s")).alias("__t")).select("item_id", nouns.alias("nouns")).where(F.size("nouns") > 0)
    sets = metrics.set_f1(predictions.select("item_id", "model", F.slice("candidates", 1, 5).alias("c")).join(gold, "item_id"), "c", "nouns", ["model"])
    both = hits.join(sets.select("model", F.round("f1", 6).alias("f1")), "model")
    return both.withColumn("score", F.round(metrics.composite(F.col("at_1"), F.col("at_5"), F.col("f1")), 6))


@query(
    f"""select *, row_number() over (order by score desc, model) as place, score - coalesce(before, 0) as gained from (
  select r.*, o.score as before from (select * from {_OLD} where o.model not in (select model from {_NEW}) union all select * from {_NEW}) r left join (select model, score from {_OLD}) o using (model))"""
)
def n12_evaluated(spark, d):
    """Items, predictions, hits, F1 and composite; upsert into earlier results, what each gained, and its place."""
    old = spark.createDataFrame(EARLIER, "model string, at_1 double, at_5 double, f1 double, score double")
    results = metrics.upsert(old, evaluated(spark, d), "model").join(old.select("model", F.col("score").alias("before")), "model", "left")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "model"))  # a row for each model
    return results.withColumn("place", place.cast("long")).withColumn("gained", F.col("score") - F.coalesce("before", F.lit(0.0)))


# --- G9, G10: profiles in groups of metrics ------------------------------------------------

_METRICS = ("length", "pronoun_count", "pronoun_density", "entity_count", "unique_pronouns", "unique_entities", "pronoun_entity_ratio")
_WIDE = f"""(select coalesce(d.source, 'none') as source, cast(length(d.text) as double) as length, cast(pronoun_count as double) as pronoun_count, p * 100 as pronoun_density, cast(entity_count as double) as entity_count,
  cast(unique_pronouns as double) as unique_pronouns, cast(unique_entities as double) as unique_entities, pronoun_count / greatest(1, entity_count) as pronoun_entity_ratio from {SCORED} join {DOCS} d using (doc_id))"""


def wide(rows: DataFrame, by: str, text: str) -> DataFrame:
    row = F.struct(F.coalesce(by, F.lit("none")).alias("source"), F.length(text).cast("double").alias("length"))
    v = quality.vector(rows.withColumn("row", row), "row", text)
    ratio = F.col("pronoun_count") / F.greatest(F.lit(1), "entity_count")
    counts = [F.col(c).cast("double").alias(c) for c in ("pronoun_count", "entity_count", "unique_pronouns", "unique_entities")]
    return v.select("row.*", *counts, (F.col("pronoun_density") * 100).alias("pronoun_density"), ratio.alias("pronoun_entity_ratio"))


@query(
    " union all ".join(
        f"select source, '{m}' as metric, round(avg({m}), 6) as mean, round(median({m}), 6) as median, round(min({m}), 6) as least, round(max({m}), 6) as most from {_WIDE} group by source" for m in _METRICS
    )
)
def g9_metric_groups(spark, d):
    """Mean, median and range of seven groups of metrics, for each source; one pass over the texts."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in _METRICS])).alias("z")
    x = stored(wide(docs(spark, d), "source", "text"), "metric-groups").select("source", each).select("source", "z.*")
    g = x.groupBy("source", "metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.min("v").alias("least"), F.max("v").alias("most"))
    return g.select("source", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")])


@query(
    f"""select source, n, two_pronouns, three_entities, dense, density_ok, ratio_ok, case when density_ok and ratio_ok then 'good' when density_ok or ratio_ok then 'fair' else 'poor' end as verdict from (
  select source, count(*) as n, round(avg(cast(pronoun_count >= 2 as double)), 6) as two_pronouns, round(avg(cast(entity_count >= 3 as double)), 6) as three_entities, round(avg(cast(pronoun_density >= 1.5e0 as double)), 6) as dense,
    avg(pronoun_density) between 1.5e0 and 3.5e0 as density_ok, avg(pronoun_entity_ratio) between 0.01e0 and 0.15e0 as ratio_ok from {_WIDE} group by source)"""
)
def g10_by_source(spark, d):
    """Shares in range by source, and the verdict of two flags."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    g = wide(docs(spark, d), "source", "text").groupBy("source").agg(
        F.count("*").alias("n"), share(F.col("pronoun_count") >= 2).alias("two_pronouns"), share(F.col("entity_count") >= 3).alias("three_entities"), share(F.col("pronoun_density") >= 1.5).alias("dense"),
        F.avg("pronoun_density").between(1.5, 3.5).alias("density_ok"), F.avg("pronoun_entity_ratio").between(0.01, 0.15).alias("ratio_ok"),
    )
    both = F.col("density_ok").cast("int") + F.col("ratio_ok").cast("int")
    return g.withColumn("verdict", F.when(both == 2, "good").when(both == 1, "fair").otherwise("poor"))


# --- B4: what a build has made -----------------------------------------------------------------


@query("select 'wiki' as source, 64 as target, count(*) as n from documents where text is not null and source = 'wiki_ko' union all select 'other', 64, count(*) from documents where text is not null and coalesce(source, '') <> 'wiki_ko'")
def b4_summary(spark, d):
    """Rows of a build by source and target."""
    kind = F.when(F.col("source") == "wiki_ko", "wiki").otherwise("other")
    made = docs(spark, d).select(kind.alias("source"), F.lit(64).alias("target"))
    return made.groupBy("source", "target").agg(F.count("*").alias("n"))
