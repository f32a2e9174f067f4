"""Predictions, votes, results and profiles.

No model runs here: predictions are a table.  The one used is made of the items
themselves, deterministically: of each item's words, "frequent" ranks by count,
"long" by length.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from jikjo.functions import text as T
from jikjo.functions import tagger
from jikjo.operators import metrics, profiles, quality
from jikjo.plans import registry as R
from jikjo.plans.corpus import _LAM, docs, lambada_items
from jikjo.plans.mining import DOCS, SCORED, TOK
from jikjo.plans.registry import query, table

_WORDS = f"(select item_id, w, count(*) as n from (select item_id, unnest({R.words('s')}) as w from {_LAM}) group by all)"
_RANKED = f"""(select item_id, 'frequent' as model, w as token, 1.0e0 / (row_number() over (partition by item_id order by n desc, w)) as score, row_number() over (partition by item_id order by n desc, w) as k from {_WORDS}
  union all select item_id, 'long', w, 1.0e0 / (row_number() over (partition by item_id order by length(w) desc, w)), row_number() over (partition by item_id order by length(w) desc, w) from {_WORDS})"""
_PREDS = f"(select item_id, model, list(token order by k) as candidates from {_RANKED} where k <= 50 group by all)"


def ranked(spark, d):
    w = lambada_items(spark, d).select("item_id", F.explode(T.words(F.col("s"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("n"))
    model = lambda name, *order: w.select("item_id", F.lit(name).alias("model"), "token", F.row_number().over(Window.partitionBy("item_id").orderBy(*order, "token")).alias("k"))
    both = model("frequent", F.desc("n")).union(model("long", F.desc(F.length("token"))))
    return both.withColumn("score", F.lit(1.0) / F.col("k")).where("k <= 50")


def predictions(spark, d):
    """At most 50 of each item and model: a bounded list."""
    r = ranked(spark, d)
    return r.groupBy("item_id", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("candidates"))


def _hit(k: int) -> str:
    return f"coalesce(len(list_filter(candidates[1:{k}], lambda c: c = t or contains(c, t) or contains(t, c))) > 0, false)"


@query(f"select model, count(*) as n, round(avg(cast({_hit(1)} as double)), 6) as at_1, round(avg(cast({_hit(5)} as double)), 6) as at_5 from {_LAM} join {_PREDS} using (item_id) group by model")
def g16_accuracy_at_k(spark, d):
    """Hits at 1 and 5 in one pass, over all items."""
    return metrics.accuracy(lambada_items(spark, d).select("item_id", "t"), predictions(spark, d), "item_id", "t", [1, 5])


_GOLD = f"(select item_id, list(distinct form) as nouns from {R.tokens('(select item_id, s from ' + _LAM + ')', 'item_id', 's')} where tag in ('NNG', 'NNP') and length(form) >= 2 group by item_id)"


@query(
    f"""select model, tp, fp, fn, round(any_hit, 6) as any_hit, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from (
  select *, tp / (tp + fp) as p, tp / (tp + fn) as r from (
    select model, cast(sum(b) as bigint) as tp, cast(sum(len(c) - b) as bigint) as fp, cast(sum(len(nouns) - b) as bigint) as fn, avg(cast(b > 0 as double)) as any_hit from (
      select model, c, nouns, len(list_intersect(c, nouns)) as b from (select model, item_id, candidates[1:5] as c from {_PREDS}) join {_GOLD} using (item_id)) group by model))"""
)
def g18_set_f1(spark, d):
    """Micro F1 of the first five candidates against the item's nouns."""
    toks = lambada_items(spark, d).select("item_id", tagger.tokens(F.col("s")).alias("__t"))
    gold = toks.select("item_id", F.array_distinct(F.transform(F.filter("__t", lambda t: t["tag"].isin("NNG", "NNP") & (F.length(t["form"]) >= 2)), lambda t: t["form"])).alias("nouns")).where(F.size("nouns") > 0)
    rows = predictions(spark, d).select("item_id", "model", F.slice("candidates", 1, 5).alias("c")).join(gold, "item_id")
    out = metrics.set_f1(rows, "c", "nouns", ["model"])
    return out.select("model", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("any_hit", "precision", "recall", "f1")])


@query(
    f"""select item_id, token, round(mean_score, 6) as mean_score, hits, models from (select *, row_number() over (partition by item_id order by mean_score desc, hits desc, token) as k from (
  select item_id, token, avg(score) as mean_score, count(*) as hits, count(distinct model) as models from {_RANKED} where k <= 50 group by all)) where k <= 3"""
)
def g20_votes(spark, d):
    """The tokens that models agree on."""
    return metrics.votes(ranked(spark, d), "item_id", 3).withColumn("mean_score", F.round("mean_score", 6))


@query(
    f"""select item_id, model, candidates from (select item_id, model, list(token order by k)[1:3] as candidates from {_RANKED}
  where k <= 50 and {R.tag("regexp_extract(token, '" + R.W + "')")} in ('NNG', 'NNP') group by all)"""
)
def i10_noun_candidates(spark, d):
    """The first three nouns of fifty candidates."""
    first = F.regexp_extract("token", tagger.WORD, 0)
    r = ranked(spark, d).where(tagger.tag(first).isin("NNG", "NNP"))
    return r.groupBy("item_id", "model").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]), 1, 3).alias("candidates"))


# --- tables of results: one row for each user of the events, as of a checkpoint ------

_RES = "(select user_id, avg(value) filter (event_type = 'view') as real1, avg(value) filter (event_type = 'click') as real5, avg(value) filter (event_type = 'signup') as lambada, max(ts) as at from events where user_id is not null group by user_id)"
_SCORE = f"(select *, coalesce(real1, 0) * 0.4e0 + coalesce(real5, 0) * 0.3e0 + coalesce(lambada, 0) * 0.3e0 as score from {_RES})"


def results(spark, d):
    one = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    r = table(spark, d, "events").where("user_id is not null").groupBy("user_id").agg(one("view").alias("real1"), one("click").alias("real5"), one("signup").alias("lambada"), F.max("ts").alias("at"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return r.withColumn("score", metrics.composite(zero("real1"), zero("real5"), zero("lambada")))


@query(f"select user_id, round(score, 6) as score, printf('%.4f', score) as shown from {_SCORE}")
def g19_composite(spark, d):
    """The composite score, and as printed."""
    return results(spark, d).select("user_id", F.round("score", 6).alias("score"), T.fixed(F.col("score")).alias("shown"))


@query(
    " union all ".join(f"(select '{m}' as metric, user_id, round({m}, 6) as value from {_SCORE} where {m} is not null order by {m} desc, user_id limit 1)" for m in ("score", "real1", "real5"))
)
def g21_best(spark, d):
    """The best row by each metric."""
    return metrics.best_of(results(spark, d), "user_id", ["score", "real1", "real5"]).withColumn("value", F.round("value", 6))


@query(f"select user_id, round(score, 6) as score from {_SCORE} order by score desc, user_id limit 10")
def g25_ranking(spark, d):
    """A top ten."""
    return results(spark, d).orderBy(F.desc("score"), "user_id").limit(10).select("user_id", F.round("score", 6).alias("score"))


_OLD = "(select user_id, avg(value) as score from events where event_type = 'view' and user_id is not null group by user_id)"
_NEW = "(select user_id, avg(value) as score from events where event_type = 'purchase' and user_id is not null group by user_id)"


def old_new(spark, d):
    e = table(spark, d, "events").where("user_id is not null")
    return [e.where(F.col("event_type") == k).groupBy("user_id").agg(F.avg("value").alias("score")) for k in ("view", "purchase")]


@query(f"select user_id, round(score, 6) as score from (select * from {_OLD} where user_id not in (select user_id from {_NEW}) union all select * from {_NEW})")
def j4_upsert(spark, d):
    """New results replace old ones."""
    return metrics.upsert(*old_new(spark, d), "user_id").withColumn("score", F.round("score", 6))


@query(f"select o.user_id, round(o.score, 6) as before, round(n.score, 6) as after, round((n.score - o.score) * 100, 6) as points from {_OLD} o left join {_NEW} n using (user_id)")
def j5_before_after(spark, d):
    """Results beside the earlier ones."""
    o, n = old_new(spark, d)
    j = o.withColumnRenamed("score", "before").join(n.withColumnRenamed("score", "after"), "user_id", "left")
    return j.select("user_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round((F.col("after") - F.col("before")) * 100, 6).alias("points"))


@query("select user_id, event_type, n from (select user_id, event_type, count(*) as n from events where user_id in (select user_id from events where event_type = 'error') group by all)")
def j3_semi(spark, d):
    """Rows whose key another table has."""
    e = table(spark, d, "events")
    return e.join(e.where("event_type = 'error'").select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    """select cast((m.i * 2 + s.i) * 3 + l.i + 1 as int) as job_id, m.v as model, s.v as seed, l.v as train_limit from (values (0, 'base'), (1, 'large')) m(i, v)
  cross join (values (0, 42::bigint), (1, 43)) s(i, v) cross join (values (0, 1000::bigint), (1, 2000), (2, 4000)) l(i, v)"""
)
def j6_grid(spark, d):
    """The grid of a sweep."""
    return metrics.grid(spark, model=["base", "large"], seed=[42, 43], train_limit=[1000, 2000, 4000])


@query(
    """select arg_max(bs, e * 1000 - bs) as bs, arg_max(ga, e * 1000 - bs) as ga, max(e) as effective from (select b.v as bs, g.v as ga, b.v * g.v as e from (values (2::bigint), (4), (8), (16), (32)) b(v) cross join (values (1::bigint), (2), (4), (8)) g(v)) where bs * 4.5e0 <= 80 * 0.8e0"""
)
def j6_batch_plan(spark, d):
    """The largest batch that fits in memory."""
    g = metrics.grid(spark, bs=[2, 4, 8, 16, 32], ga=[1, 2, 4, 8]).where(F.col("bs") * 4.5 <= 64.0).withColumn("e", F.col("bs") * F.col("ga"))
    by = F.col("e") * 1000 - F.col("bs")
    return g.agg(F.max_by("bs", by).alias("bs"), F.max_by("ga", by).alias("ga"), F.max("e").alias("effective"))


@query("select name, unnest(list_sort(list_distinct(list_filter(list_transform(range(1, 7), lambda i: cast(round_even(i * 0.5e0 * per, 0) as bigint)), lambda s: s > 0 and s <= 3 * per)))) as step from (select source as name, cast(ceil(count(*) / 32) as bigint) as per from documents where source is not null group by source)")
def h9_schedule(spark, d):
    """H9: evaluation steps every half epoch of three."""
    per = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.ceil(F.count("*") / 32).alias("per"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.bround(i * 0.5 * F.col("per"), 0).cast("long"))
    return per.select("name", F.explode(F.array_distinct(F.filter(steps, lambda s: (s > 0) & (s <= 3 * F.col("per"))))).alias("step"))


# --- profiles ------------------------------------------------------------------------

_REP = f"(select doc_id, count(*) as reps from (select doc_id, form from {TOK} where tag = 'NNP' and length(form) >= 2 group by doc_id, form having count(*) >= 2) group by doc_id)"
_PRON = f"(select doc_id, count(*) as pronouns from {TOK} where tag in ('NP', 'NNP') and form in ({R.names(profiles.L.PRONOUNS_COUNTED)}) group by doc_id)"
_PROF = f"""(select source, count(*) as total, avg(length(text)) as avg_length, quantile_cont(length(text), 0.5) as median_length, min(length(text)) as min_length, max(length(text)) as max_length,
    avg(cast(reps is not null as double)) * 100 as repeat_ratio, avg(coalesce(pronouns, 0)) as avg_pronouns from {DOCS} left join {_REP} using (doc_id) left join {_PRON} using (doc_id) group by source)"""
_STARS = f"(select *, cast(round_even((least(5.0e0, greatest(1.0e0, avg_length / 100)) + least(5.0e0, greatest(1.0e0, repeat_ratio / 10)) + least(5.0e0, greatest(1.0e0, avg_pronouns * 2))) / 3, 0) as int) as stars from {_PROF})"


@query(
    f"""select source, total, round(avg_length, 6) as avg_length, median_length, cast(min_length as int) as min_length, cast(max_length as int) as max_length, round(repeat_ratio, 6) as repeat_ratio, round(avg_pronouns, 6) as avg_pronouns, stars,
  least(total, case when stars >= 4 then 50000 when stars >= 3 then 20000 when stars >= 2 then 10000 else 5000 end) as recommended, case when stars >= 4 then 'high' when stars >= 3 then 'middle' else 'low' end as tier from {_STARS}"""
)
def g7_source_profile(spark, d):
    """The profile, stars and tier of each source."""
    p = profiles.source_profile(profiles.with_repeats(docs(spark, d).select("source", "text"), "text"), ["source"])
    return p.withColumn("tier", profiles.tier(F.col("stars"))).select(*[F.round(c, 6).alias(c) if c.startswith(("avg", "repeat")) else c for c in [*p.columns, "tier"]])


@query(
    f"""select entity, n from (select form as entity, count(*) as n from (select doc_id, form from {TOK} where tag = 'NNP' and length(form) >= 2 group by doc_id, form having count(*) >= 2) group by form) order by n desc, entity limit 5"""
)
def g7_top_repeated(spark, d):
    """The names that most texts repeat."""
    r = profiles.with_repeats(docs(spark, d).select("text"), "text").select(F.explode("repeated_names").alias("entity"))
    return r.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(5)


@query(
    f"""select count(*) as n, round(avg(p), 6) as mean, round(quantile_cont(p, 0.5e0), 6) as median, round(max(p) - min(p), 6) as range,
  round(avg(cast(p * 100 between 1.5e0 and 3.0e0 as double)), 6) as in_band, round(avg(cast(pronoun_count / greatest(1, entity_count) between 0.01e0 and 0.15e0 as double)), 6) as ratio_in_band,
  round(avg(cast(pronoun_count >= 2 as double)), 6) as two_pronouns, round(avg(cast(entity_count >= 3 as double)), 6) as three_entities from {SCORED}"""
)
def g9_corpus_profile(spark, d):
    """Shares in range over the whole corpus."""
    v = quality.vector(docs(spark, d), "doc_id", "text")
    p, share = F.col("pronoun_density"), lambda c: F.round(F.avg(c.cast("double")), 6)
    return v.agg(
        F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean"), F.round(F.percentile(p, F.lit(0.5)), 6).alias("median"), F.round(F.max(p) - F.min(p), 6).alias("range"),
        share((p * 100).between(1.5, 3.0)).alias("in_band"), share((F.col("pronoun_count") / F.greatest(F.lit(1), "entity_count")).between(0.01, 0.15)).alias("ratio_in_band"),
        share(F.col("pronoun_count") >= 2).alias("two_pronouns"), share(F.col("entity_count") >= 3).alias("three_entities"),
    )


@query(
    f"""select source, n as before_rows, m as after_rows, round(100.0e0 * m / n, 6) as retained_percent, round(b, 6) as before_score, round(a, 6) as after_score, round((a - b) / b * 100, 6) as improved_percent from (
  select source, count(*) as n, count(*) filter (pronoun_count >= 2) as m, avg(coref_score) as b, avg(coref_score) filter (pronoun_count >= 2) as a from {SCORED} join {DOCS} using (doc_id) group by source)"""
)
def g11_before_after(spark, d):
    """What a gate keeps and gains, by source."""
    v = quality.vector(docs(spark, d), "source", "text").select("source", "pronoun_count", "coref_score")
    ok = F.col("pronoun_count") >= 2
    g = v.groupBy("source").agg(F.count("*").alias("before_rows"), F.count_if(ok).alias("after_rows"), F.avg("coref_score").alias("b"), F.avg(F.when(ok, F.col("coref_score"))).alias("a"))
    return g.select(
        "source", "before_rows", "after_rows", F.round(F.col("after_rows") * 100.0 / F.col("before_rows"), 6).alias("retained_percent"), F.round("b", 6).alias("before_score"),
        F.round("a", 6).alias("after_score"), F.round(F.try_divide(F.col("a") - F.col("b"), F.col("b")) * 100, 6).alias("improved_percent"),
    )


@query(f"select q, round(v, 6) as value from (select unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) as q, unnest(quantile_cont(p * 100, [0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0])) as v from {SCORED})")
def g13_percentiles(spark, d):
    """Exact percentiles, interpolated."""
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    p = quality.vector(docs(spark, d), "doc_id", "text").agg(F.percentile(F.col("pronoun_density") * 100, F.array(*[F.lit(q) for q in qs])).alias("v"))
    return p.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("v"))).alias("z")).select(F.col("z.q").alias("q"), F.round("z.v", 6).alias("value"))


@query(f"select round(avg(quality_score), 6) as mean, case when avg(quality_score) > 0.8e0 then 'excellent' when avg(quality_score) > 0.6e0 then 'good' else 'poor' end as rating from (select * from {SCORED} order by doc_id limit 100)")
def g15_head_check(spark, d):
    """A rating by the first hundred rows, which is this report's definition."""
    head = docs(spark, d).orderBy("doc_id").limit(100)
    m = quality.vector(head, "doc_id", "text").agg(F.avg("quality_score").alias("m"))
    return m.select(F.round("m", 6).alias("mean"), F.when(F.col("m") > 0.8, "excellent").when(F.col("m") > 0.6, "good").otherwise("poor").alias("rating"))


@query(f"select source, count(*) as n, round(avg(least(64, len({R.words('text')}))), 6) as avg_tokens from {DOCS} group by source")
def g23_build_stats(spark, d):
    """Rows and mean size of what was built, by source."""
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.lit(64), F.size(T.words(F.col("text"))))), 6).alias("avg_tokens"))
