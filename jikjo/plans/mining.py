"""Tagging, quality vectors, gates, and mining of repeated entities over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jikjo.functions import lexicon as L
from jikjo.functions import tagger
from jikjo.operators import mining, quality
from jikjo.operators.ordering import prefix_stop
from jikjo.plans import registry as R
from jikjo.plans.registry import query, table

DOCS = "(select doc_id, text, source from documents where text is not null)"
TOK = R.tokens(DOCS, "doc_id")


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


@query(f"select tag, count(*) as n, count(distinct form) as forms from {TOK} group by tag")
def f1_tag_counts(spark, d):
    """words by tag."""
    t = docs(spark, d).select(tagger.tokens(F.col("text")).alias("ts")).select(F.explode("ts").alias("t")).select("t.form", "t.tag")
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("form").alias("forms"))


_ENT = "tag in ('NNG', 'NNP', 'NNB') and length(form) > 1"
VECTOR = f"""(select doc_id, count(*) filter (tag = 'NP') as pronoun_count, count(*) filter ({_ENT}) as entity_count, count(*) filter (tag = 'VV') as verb_count,
    count(*) filter (tag in ('NP', 'NNG', 'NNP', 'VV', 'MAG')) as total_words, count(distinct form) filter (tag = 'NP') as unique_pronouns, count(distinct form) filter ({_ENT}) as unique_entities
  from (select d.doc_id, t.form, t.tag from {DOCS} d left join {TOK} t using (doc_id)) group by doc_id)"""
SCORED = f"""(select *, 0.5e0 * coref_score + 0.3e0 * complexity_score + 0.2e0 * balance_score as quality_score from (
  select *, least(1.0e0, p * 20 + e * 3 + p * e * 50) as coref_score, least(1.0e0, e * 10 + v * 5 + p * 15) as complexity_score, 1.0e0 - abs(p - e * 0.3e0) as balance_score from (
    select *, pronoun_count / greatest(1, total_words) as p, entity_count / greatest(1, total_words) as e, verb_count / greatest(1, total_words) as v from {VECTOR})))"""
_SCORES = ["coref_score", "complexity_score", "balance_score", "quality_score"]


@query(
    f"select doc_id, pronoun_count, entity_count, verb_count, total_words, unique_pronouns, unique_entities, round(p, 6) as pronoun_density, round(e, 6) as entity_density, round(v, 6) as verb_density, "
    + ", ".join(f"round({c}, 6) as {c}" for c in _SCORES) + f" from {SCORED}"
)
def g1_quality_vector(spark, d):
    """Thirteen fields for each document."""
    v = quality.vector(docs(spark, d), "doc_id", "text").drop("name_count")
    return v.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in v.dtypes])


@query(f"select d.source, count(*) as n, count(*) filter (quality_score >= 0.6e0) as passed, round(avg(quality_score), 6) as mean_score, round(100.0e0 * count(*) filter (quality_score >= 0.6e0) / count(*), 6) as pass_percent from {SCORED} s join {DOCS} d using (doc_id) group by d.source")
def g1_quality_by_source(spark, d):
    """The flagship: quality of every document, gated and summed by source."""
    rows = docs(spark, d)
    v = quality.scored(quality.counted(rows, F.col("text"), "source"))
    ok = F.count_if(F.col("quality_score") >= 0.6)
    return v.groupBy("source").agg(
        F.count("*").alias("n"), ok.alias("passed"), F.round(F.avg("quality_score"), 6).alias("mean_score"), F.round(ok * 100.0 / F.count("*"), 6).alias("pass_percent")
    )


WORKER = f"""(select *, pronoun_count / total_words as pd, entity_count / total_words as ed, pronoun_count / greatest(1, entity_count) as ratio from (
  select doc_id, count(*) filter (tag = 'NP') as pronoun_count, count(*) filter ({_ENT}) as entity_count, count(*) filter (tag = 'VV') as verb_count,
    count(*) filter (tag in ('NP', 'NNG', 'NNP', 'VV', 'MAG')) as total_words, count(distinct form) filter (tag = 'NP') as unique_pronouns, count(distinct form) filter ({_ENT}) as unique_entities
  from {R.tokens("(select doc_id, left(text, 1500) as text from documents where length(text) >= 50)", "doc_id")} group by doc_id) where total_words > 0)"""
_COMMON = "pronoun_count >= 2 and entity_count >= 5 and pd * 100 between 1.0e0 and 5.0e0 and ratio between 0.01e0 and 0.15e0"


@query(
    f"""select doc_id, pronoun_count, entity_count, verb_count, total_words, unique_pronouns, unique_entities, round(pd, 6) as pronoun_density, round(ed, 6) as entity_density, round(ratio, 6) as pronoun_entity_ratio,
  {_COMMON} and entity_count >= 8 and unique_pronouns >= 2 as mrc, {_COMMON} and unique_pronouns >= 2 as encyclopedia, {_COMMON} and pd * 100 >= 0.8e0 and ratio >= 0.005e0 as news from {WORKER}"""
)
def g3_worker_vector(spark, d):
    """The reduced vector and the three gates."""
    v = quality.worker_vector(docs(spark, d), "doc_id", "text")
    for p in ("mrc", "encyclopedia", "news"):
        v = v.withColumn(p, quality.gate(p))
    return v.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in v.dtypes])


_PRO = "tag in ('NP', 'NNG') and (" + " or ".join(f"contains(form, '{p}')" for p in L.PRONOUNS_PROFILE) + ")"


@query(
    f"""select doc_id, p as pronoun_count, e as entity_count, round(p * 100.0e0 / n, 6) as pronoun_density, round(e * 100.0e0 / n, 6) as entity_density from (
  select d.doc_id, max(length(d.text)) as n, count(*) filter ({_PRO}) as p, count(*) filter (not ({_PRO}) and tag in ('NP', 'NNP')) as e from {DOCS} d left join {TOK} t using (doc_id) where length(d.text) > 0 group by d.doc_id)"""
)
def g4_character_vector(spark, d):
    """Densities by characters."""
    v = quality.character_vector(docs(spark, d), "doc_id", "text")
    return v.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in v.dtypes])


@query(f"select doc_id, count(*) as words, round(count(*) filter (tag = 'NNP') / count(*), 6) as ratio, count(*) filter (tag = 'NNP') / count(*) between 0.05e0 and 0.2e0 as passes, count(*) filter (tag = 'NP') = 0 as no_pronoun from {TOK} group by doc_id")
def d10_name_ratio(spark, d):
    """The gate on the share of names, and texts without pronouns."""
    t = docs(spark, d).select("doc_id", tagger.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    n = F.size(F.filter("t", lambda x: x["tag"] == "NNP")) / F.size("t")
    return t.select("doc_id", F.size("t").cast("long").alias("words"), F.round(n, 6).alias("ratio"), n.between(0.05, 0.2).alias("passes"), (~F.exists("t", lambda x: x["tag"] == "NP")).alias("no_pronoun"))


@query(
    f"""select p.name, count(*) filter (c >= p.least and a >= p.pd and b >= p.ed) as passed from (
  select pronoun_count as c, p as a, e as b from {SCORED}) cross join (values ('naver', 2, 0.008e0, 0.55e0), ('wiki', 2, 0.01e0, 0.5e0), ('klue', 1, 0e0, 0e0)) p(name, least, pd, ed) group by p.name"""
)
def d14_triple_gates(spark, d):
    """Three thresholds of each profile, from a table of profiles."""
    profiles = (("naver", 2, 0.008, 0.55), ("wiki", 2, 0.01, 0.5), ("klue", 1, 0.0, 0.0))
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("least"), F.lit(a).alias("pd"), F.lit(b).alias("ed")) for n, k, a, b in profiles])).alias("p")
    v = quality.vector(docs(spark, d), "doc_id", "text").select("pronoun_count", "pronoun_density", "entity_density", p)
    ok = (F.col("pronoun_count") >= F.col("p.least")) & (F.col("pronoun_density") >= F.col("p.pd")) & (F.col("entity_density") >= F.col("p.ed"))
    return v.groupBy(F.col("p.name").alias("name")).agg(F.count_if(ok).alias("passed"))


# --- F9 to F14 ---------------------------------------------------------------------

PLACED = R.placed(DOCS, "doc_id")
REPS = f"""(select doc_id, entity, ps, row_number() over (partition by doc_id order by first) - 1 as entity_order from (
  select doc_id, form as entity, list(start order by start) as ps, min(start) as first, count(*) as n from {PLACED}
  where tag = 'NNP' and length(form) >= 2 and form not in ({R.names(L.ENTITY_STOP)}) group by doc_id, form) where n >= 2)"""
EXAMPLES = f"""(select doc_id, entity, entity_order, ps[1] as antecedent_pos, c as coref_pos, c - ps[1] as distance from (select *, unnest(ps[2:4]) as c from {REPS}) where c - ps[1] between 10 and 2000)"""


@query(f"select doc_id, entity, cast(entity_order as int) as entity_order, ps as positions from {REPS}")
def f9_repetitions(spark, d):
    """repeated names of each document with their places."""
    return mining.repetitions(docs(spark, d), "doc_id", "text")


@query(f"select doc_id, entity, antecedent_pos, coref_pos, distance from {EXAMPLES}")
def f10_examples(spark, d):
    """Second to fourth mentions within the distance band."""
    return mining.examples(mining.repetitions(docs(spark, d), "doc_id", "text"), "doc_id").drop("entity_order")


@query(f"select doc_id, entity, coref_pos from (select *, row_number() over (partition by entity order by doc_id, entity_order, coref_pos) as k from {EXAMPLES}) where k <= 20")
def f11_capped(spark, d):
    """At most 20 examples of an entity."""
    e = mining.examples(mining.repetitions(docs(spark, d), "doc_id", "text"), "doc_id")
    return mining.capped(e, "doc_id", 20).select("doc_id", "entity", "coref_pos")


@query(f"select doc_id, entity, left(text, coref_pos) || '[MASK]' || substr(text, coref_pos + length(entity) + 1) as masked from {EXAMPLES} join {DOCS} using (doc_id)")
def e11_masked_examples(spark, d):
    """The later mention masked."""
    e = mining.examples(mining.repetitions(docs(spark, d), "doc_id", "text"), "doc_id")
    return mining.masked(e, docs(spark, d), "doc_id", "text").select("doc_id", "entity", "masked")


@query(f"select doc_id, n from (select doc_id, n, sum(n) over (order by doc_id) - n as before from (select doc_id, count(*) as n from {EXAMPLES} group by doc_id)) where before < 500")
def h4_prefix_stop(spark, d):
    """Documents until 500 examples are reached; the last one may overshoot."""
    n = mining.examples(mining.repetitions(docs(spark, d), "doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    return prefix_stop(n, ["doc_id"], F.col("n"), 500)


_CLEAN = f"(select * from {DOCS} where length(text) >= 100 and doc_id not in (select doc_id from {TOK} where tag = 'NP'))"
_NOUNS = f"""(select doc_id, entity, ps, row_number() over (partition by doc_id order by first) - 1 as o from (
  select doc_id, form as entity, list(start order by start) as ps, min(start) as first, count(*) as n from {R.placed(_CLEAN, "doc_id")} where tag in ('NNP', 'NNG') and length(form) >= 2 group by doc_id, form) where n >= 2)"""


@query(
    f"""select doc_id, source, entity, coref_pos from (select n.doc_id, d.source, entity, ps[2] as coref_pos, row_number() over (partition by d.source order by n.doc_id, o) as k
  from {_NOUNS} n join {DOCS} d using (doc_id) where o < 3) where k <= 800"""
)
def f12_evaluation_set(spark, d):
    """Second mentions of repeated nouns, three of a text, a quota of each source."""
    return mining.evaluation_set(docs(spark, d), "doc_id", "source", "text").select("doc_id", "source", "entity", "coref_pos")


@query(
    f"""select d.doc_id, left(text, p.start) || '[MASK]' || substr(text, p.start + length(p.form) + 1) as masked, p.form as pronoun from {DOCS} d
join (select doc_id, arg_min(form, i) as form, min(start) as start from {PLACED} where tag = 'NP' group by doc_id) p using (doc_id)"""
)
def e2_first_pronoun(spark, d):
    """The first pronoun masked."""
    return mining.first_pronoun(docs(spark, d), "doc_id", "text")


@query()
def f14_pronoun_context(spark, d):
    """a pronoun masked, with the nouns of the sentences around it, two at least."""
    return mining.pronoun_context(docs(spark, d), "doc_id", "text")


@query(
    f"""select count(*) as n, round(avg(distance), 6) as mean, median(distance) as median, min(distance) as least, max(distance) as most,
  count(*) filter (distance < 200) as near, count(*) filter (distance between 200 and 799) as middle, count(*) filter (distance >= 800) as far,
  round(100.0e0 * count(*) filter (distance < 200) / count(*), 6) as near_percent, round(avg(length(entity)), 6) as entity_length from {EXAMPLES}"""
)
def g12_distances(spark, d):
    """Statistics of distances, in buckets."""
    e = mining.examples(mining.repetitions(docs(spark, d), "doc_id", "text"), "doc_id")
    x = F.col("distance")
    return e.agg(
        F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.percentile(x, 0.5).alias("median"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.count_if(x < 200).alias("near"), F.count_if(x.between(200, 799)).alias("middle"), F.count_if(x >= 800).alias("far"),
        F.round(F.count_if(x < 200) * 100.0 / F.count("*"), 6).alias("near_percent"), F.round(F.avg(F.length("entity")), 6).alias("entity_length"),
    )


@query(f"select entity, count(*) as n, round(100.0e0 * count(*) / (select count(*) from {EXAMPLES}), 6) as percent from {EXAMPLES} group by entity order by n desc, entity limit 20")
def i13_top_entities(spark, d):
    """The most frequent entities, ties by name."""
    from jikjo.storage import stored

    c = stored(mining.examples(mining.repetitions(docs(spark, d), "doc_id", "text"), "doc_id").groupBy("entity").agg(F.count("*").alias("n")), "entity-counts")
    whole = c.agg(F.sum("n").alias("whole"))
    top = c.orderBy(F.desc("n"), "entity").limit(20)
    return top.join(F.broadcast(whole)).select("entity", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 6).alias("percent"))
