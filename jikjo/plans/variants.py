"""The other settings of operators: floors, routes, windows, formats, catalogs, batches and heads."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from jikjo.functions import lexicon as L
from jikjo.functions import text as T
from jikjo.operators import quality, sampling
from jikjo.operators import vocabulary as V
from jikjo.operators.ordering import numbered
from jikjo.plans import registry as R
from jikjo.plans.corpus import _E, _LAM, _MASKED, _P, TEXT, docs, lambada_items
from jikjo.plans.mining import DOCS, SCORED
from jikjo.plans.registry import query, table

_N = f"len({R.words('text')})"


@query(f"select doc_id, {_N} >= 0.3e0 * 128 as by_length, {_N} >= 100 as hundred, {_N} >= 50 and length(text) >= 50 as fifty {TEXT}")
def d2_floors(spark, d):
    """The three floors of words."""
    n = F.size(T.words(F.col("text")))
    return docs(spark, d).select("doc_id", (n >= 0.3 * 128).alias("by_length"), (n >= 100).alias("hundred"), ((n >= 50) & (F.length("text") >= 50)).alias("fifty"))


#: Share of the length up to which a text is kept, and up to which it is cut; a longer one is chunked.
ROUTES = {"kept_or_cut": (1.0, 1.5), "kept_to_double": (2.0, 2.0), "always_cut": (1.0, float("inf")), "long": (1.2, 1.2)}


def route(words: Column, length: int, kept: float, cut: float) -> Column:
    return F.when(words <= kept * length, "keep").when(words <= F.lit(cut) * length, "truncate").otherwise("chunk")


@query(
    f"""select doc_id, case when n <= 128 then 'keep' when n <= 192 then 'truncate' else 'chunk' end as kept_or_cut, case when n <= 256 then 'keep' else 'chunk' end as kept_to_double,
  case when n <= 128 then 'keep' else 'truncate' end as always_cut, case when n <= 1.2e0 * 128 then 'keep' else 'chunk' end as long from (select doc_id, {_N} as n {TEXT})"""
)
def d3_routes(spark, d):
    """D3: the four routings by length."""
    n = F.size(T.words(F.col("text")))
    return docs(spark, d).select("doc_id", *[route(n, 128, *bounds).alias(name) for name, bounds in ROUTES.items()])


@query(
    f"""select item_id, seq_len, substr(m, greatest(0, i - 1 - w) + 1, least(length(m), i - 1 + 6 + w) - greatest(0, i - 1 - w)) as clipped
from (select item_id, m, instr(m, '[MASK]') as i from (select item_id, {_MASKED} as m from {_LAM})) cross join (select seq_len, cast(floor(30 * greatest(1.0e0, seq_len / 512)) as int) as w from seq_budgets)"""
)
def e4_scaled_clip(spark, d):
    """A window of characters around the mask that grows with the length, from 512 on."""
    lens = table(spark, d, "seq_budgets").select("seq_len", F.floor(30 * F.greatest(F.lit(1.0), F.col("seq_len") / 512)).cast("int").alias("w"))
    m = lambada_items(spark, d).select("item_id", T.mask_word(F.col("s"), F.col("t"), L.MASK).alias("m")).join(F.broadcast(lens), F.lit(True))  # four lengths
    at = F.instr("m", F.lit(L.MASK))
    begin, end = F.greatest(F.lit(0), at - 1 - F.col("w")), F.least(F.length("m"), at - 1 + len(L.MASK) + F.col("w"))
    return m.select("item_id", "seq_len", F.substring("m", begin + 1, end - begin).alias("clipped"))


@query(
    """select event_id, case when value is null then '-' else printf('%.2e', sqrt(abs(value))) end as sci, case when value is null or value < 0 then '-' when value >= 3600 then printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end as eta
from (select event_id, value * 37 as value, cast(floor(value * 37) as bigint) as s from events)"""
)
def e17_durations(spark, d):
    """Scientific form (of roots, which are no ties: the JVM rounds the decimal form) and durations; a dash where there is none."""
    v = F.col("value") * 37
    s = F.floor(v).cast("long")
    minutes = F.format_string("%02d:%02d", F.expr("__s div 60 % 60"), F.expr("__s % 60"))
    e = table(spark, d, "events").select("event_id", v.alias("v"), s.alias("__s"))
    eta = F.when(F.col("v").isNull() | (F.col("v") < 0), "-").when(F.col("v") >= 3600, F.concat(F.format_string("%02d:", F.expr("__s div 3600")), minutes)).otherwise(minutes)
    return e.select("event_id", F.when(F.col("v").isNull(), "-").otherwise(F.format_string("%.2e", F.sqrt(F.abs("v")))).alias("sci"), eta.alias("eta"))


#: The sources of the two small catalogs.
CATALOGS = {"six": ["wiki_ko", "klue_mrc", "klue_ynat", "korquad", "klue_sts", "klue_nli"], "two": ["wiki_ko", "hplt_korean"]}


@query(
    " union all ".join(f"select '{c}' as catalog, n as place, name, domain, is_streaming from dataset_source join (values {', '.join(f'({k}, {chr(39)}{s}{chr(39)})' for k, s in enumerate(names, 1))}) v(n, name) using (name)" for c, names in CATALOGS.items())
)
def a5_catalogs(spark, d):
    """The catalogs of six and of two sources, in their order."""
    rows = [(c, k, s) for c, names in CATALOGS.items() for k, s in enumerate(names, 1)]
    listed = spark.createDataFrame(rows, "catalog string, place int, name string")
    return F.broadcast(listed).join(table(spark, d, "dataset_source"), "name").select("catalog", "place", "name", "domain", "is_streaming")


@query(
    f"""select batch, count(*) as n, round(0.1e0 + 0.2e0 * least(1.0e0, avg(w) / 64), 6) as mask_chance from (
  select (row_number() over (order by doc_id) - 1) // 32 as batch, {_N} as w {TEXT}) group by batch"""
)
def e20_batch_chance(spark, d):
    """The masking chance of a batch, by its mean length."""
    x = numbered(docs(spark, d).select("doc_id", F.size(T.words(F.col("text"))).alias("w")), ["doc_id"], "r")
    g = x.groupBy(F.expr("(r - 1) div 32").alias("batch")).agg(F.count("*").alias("n"), F.avg("w").alias("w"))
    return g.select("batch", "n", F.round(0.1 + 0.2 * F.least(F.lit(1.0), F.col("w") / 64), 6).alias("mask_chance"))


@query("select doc_id from documents where text is not null order by doc_id limit 100")
def h5_exact_prefix(spark, d):
    """H5: exactly the first hundred rows: a top-n."""
    return docs(spark, d).select("doc_id").orderBy("doc_id").limit(100)


@query("select doc_id from (select doc_id from documents where text is not null order by doc_id limit 300) order by md5('42:' || doc_id), doc_id limit 50")
def i5_sample_of_head(spark, d):
    """A sample without replacement of the first 300 rows only, as its definition says."""
    head = docs(spark, d).select("doc_id").orderBy("doc_id").limit(300)
    return sampling.shuffled_head(head, "doc_id", 50, 42)


@query(
    f"""select s.doc_id, case when total_words > 0 then round(p, 6) else round(sp, 6) end as pronoun_density, case when total_words > 0 then round(e, 6) else round(se, 6) end as entity_density,
  round(case when total_words > 0 then coref_score else least(1.0e0, sp * 20 + se * 3 + sp * se * 50) end, 6) as coref_score, pronoun_count, entity_count, case when total_words > 0 then total_words else n end as total_words
from {SCORED} s join (select doc_id, len(w) as n, case when len(w) > 0 then {_P} else 0 end as sp, case when len(w) > 0 then {_E} else 0 end as se from (select doc_id, {R.words('text')} as w from {DOCS})) x using (doc_id)"""
)
def g2_reduced_vector(spark, d):
    """Six fields; where the tagger has no word to offer, the densities that need none."""
    row = F.struct("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n"))
    rows = docs(spark, d).withColumn("row", row)
    none = F.col("total_words") == 0
    v = quality.vector(rows, "row", "text").select("row.*", "pronoun_density", "entity_density", "coref_score", "pronoun_count", "entity_count", "total_words")
    simple = quality.simple_scores(docs(spark, d).where(~F.col("text").rlike("[가-힣A-Za-z0-9]")), "doc_id", "text")  # few: texts without a word
    both = v.join(simple.select("doc_id", *[F.col(c).alias(f"s_{c}") for c in ("pronoun_density", "entity_density", "coref_score")]), "doc_id", "left")
    fields = [F.round(F.when(none, F.coalesce(f"s_{c}", F.lit(0.0))).otherwise(F.col(c)), 6).alias(c) for c in ("pronoun_density", "entity_density", "coref_score")]
    return both.select("doc_id", *fields, "pronoun_count", "entity_count", F.when(none, F.col("n")).otherwise(F.col("total_words")).alias("total_words"))


_SIMPLE = f"(select distinct source_name as source, row_id, text from raw_text where source_name in ({R.names(CATALOGS['two'])}) and row_id is not null and length(text) >= 50 and {_N} >= 50)"


@query(
    f"""with t as (select *, row_number() over (order by md5('42:' || row_id), row_id) as place from {_SIMPLE}), e as (select place, unnest({R.words('text')}) as w, unnest(range(1, {_N} + 1)) as k from t),
  v as (select w, row_number() over (order by n desc, w) as id from (select w, count(*) as n from e group by w))
select t.place, t.source, t.row_id, list_resize(i.ids, 64, 0) as input_ids from t join (select place, list(cast(id as int) order by k) as ids from e join v using (w) where k <= 64 group by place) i using (place)"""
)
def n4_simple_set(spark, d):
    """Two sources (A7, J9), floors (D1, D2), a seeded shuffle of all rows (I3), always cut (D3), as 64 word ids (F15); no quality step."""
    words = T.words(F.col("text"))
    x = table(spark, d, "raw_text").where(F.col("source_name").isin(CATALOGS["two"]) & F.col("row_id").isNotNull())
    x = x.where((F.length("text") >= 50) & (F.size(words) >= 50)).select(F.col("source_name").alias("source"), "row_id", "text").distinct()
    placed = numbered(x.withColumn("h", sampling.chance_key("row_id", 42)), ["h", "row_id"], "place").drop("h")
    ids = V.encoded(placed, ["place", "source", "row_id"], F.slice(words, 1, 64), V.vocabulary(placed, words))
    return ids.select("place", "source", "row_id", T.padded(F.transform("ids", lambda i: i.cast("int")), 64).alias("input_ids"))


@query(f"select item_id, flatten([[c, c || '!'] for c in ws[1:3]]) as flat, len(ws[1:3]) as nested from (select item_id, {R.words('s')} as ws from {_LAM})")
def e6_flattened(spark, d):
    """Candidates nested by mask as one list."""
    first = F.slice(T.words(F.col("s")), 1, 3)
    nested = F.transform(first, lambda c: F.array(c, F.concat(c, F.lit("!"))))
    return lambada_items(spark, d).select("item_id", T.flattened(nested).alias("flat"), F.size(first).cast("long").alias("nested"))


_TIES = "(select user_id, event_type, count(*) as n from events where user_id is not null group by all)"


@query(f"select event_type, n, users, place from (select event_type, n, count(*) as users, row_number() over (partition by event_type order by count(*) desc, n) as place from {_TIES} group by event_type, n) where place <= 3")
def g5_common_counts(spark, d):
    """The most common counts of each kind, ties by the smaller count."""
    each = table(spark, d, "events").where("user_id is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    sizes = each.groupBy("event_type", "n").agg(F.count("*").alias("users"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("users"), "n"))
    return sizes.withColumn("place", place.cast("long")).where("place <= 3")
