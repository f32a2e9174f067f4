"""Scans, projections, filters, text functions and chunkers over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jikjo.functions import lexicon as L
from jikjo.functions import text as T
from jikjo.operators import chunking, quality
from jikjo.operators import vocabulary as V
from jikjo.operators.ordering import numbered
from jikjo.plans import registry as R
from jikjo.plans.registry import query, table
from jikjo.sources import catalog as C
from jikjo.storage import stored

TEXT = "from documents where text is not null"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


# --- A, J9: scans ------------------------------------------------------------------


@query("select article_id, split, arrived_at from (select *, row_number() over (partition by article_id order by arrived_at, split) as k from naver_news where split = 'train') where k = 1")
def a1_scan_split(spark, d):
    """One split of a table, each key once (the first delivery)."""
    rows = table(spark, d, "naver_news").where("split = 'train'").select("article_id", "split", "arrived_at")
    return C.first_delivery(rows, "article_id", ["arrived_at", "split"])


@query(
    """select source_name, row_id from (
  select source_name, row_id, row_number() over (partition by source_name order by row_id) as k
  from (select distinct source_name, row_id from raw_text where source_name is not null and row_id is not null)) where k <= 50"""
)
def a2_head_by_source(spark, d):
    """The first rows of each source, by key."""
    from jikjo.operators.ordering import heads

    rows = table(spark, d, "raw_text").where("source_name is not null and row_id is not null").select("source_name", "row_id").distinct()
    return heads(rows, ["source_name"], [F.col("row_id")], 50)


@query(
    """select s.name, s.domain, s.is_streaming, count(r.row_id) as n_rows, count(distinct r.row_id) as n_keys
from dataset_source s left join raw_text r on r.source_name = s.name group by all"""
)
def a6_source_catalog(spark, d):
    """The source catalog with what each source holds."""
    s = table(spark, d, "dataset_source")
    held = table(spark, d, "raw_text").groupBy("source_name").agg(F.count("row_id").alias("n_rows"), F.countDistinct("row_id").alias("n_keys"))
    out = s.join(F.broadcast(held), s.name == held.source_name, "left").select("name", "domain", "is_streaming", "n_rows", "n_keys")
    return out.fillna(0, ["n_rows", "n_keys"])


@query("select name, cast(floor(0.4 * seq_len) as bigint) as least_tokens, cast(floor(1.8 * seq_len) as bigint) as most_tokens, seq_len from dataset_source cross join seq_budgets where domain like '%news%'")
def a8_length_bounds(spark, d):
    """Length bounds of a source for each target length."""
    s = table(spark, d, "dataset_source").where("domain like '%news%'").select("name")
    lens = sorted({r.seq_len for r in table(spark, d, "seq_budgets").select("seq_len").collect()})  # target lengths: a parameter table
    return s.select("name", F.explode(F.array(*[F.lit(n) for n in lens])).alias("seq_len")).select("name", F.floor(F.lit(0.4) * F.col("seq_len")).alias("least_tokens"), F.floor(F.lit(1.8) * F.col("seq_len")).alias("most_tokens"), "seq_len")


@query(
    """select source, count(*) as n, cast(sum(length(text)) as bigint) as chars from (
  select source_name as source, text from raw_text union all select coalesce(source_name, 'qa'), context from qa_context
  union all select 'naver', coalesce(document, array_to_string(document_list, ' ')) from naver_news union all select 'translated', trans_text from translated_news)
where text is not null group by source"""
)
def a9_union_sources(spark, d):
    """All sources under one schema."""
    return C.union_sources(spark, d).where("text is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select article_id, split from naver_news where split = 'validation'")
def a10_split_fallback(spark, d):
    """A10: the first split in order of preference that has rows."""
    return C.first_split(table(spark, d, "naver_news"), ["validation", "dev", "test"]).select("article_id", "split")


@query(
    """select cast(props->>'k' as bigint) as k, count(*) as n, count(*) filter (event_type = 'error') as errors
from events where json_valid(props) group by 1"""
)
def a11_json_fields(spark, d):
    """Fields of JSON text; lines that aren't JSON are passed over."""
    e = table(spark, d, "events").withColumn("j", F.expr("try_parse_json(props)")).where("j is not null")
    return e.groupBy(F.expr("try_variant_get(j, '$.k', 'bigint')").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    r"""select source_name, cast(regexp_extract(site, '(\d+)\.example$', 1) as bigint) as number, count(*) as n from raw_text
where regexp_matches(site, '(\d+)\.example$') group by all"""
)
def a15_path_numbers(spark, d):
    """Numbers captured from names, as of checkpoint folders and log lines."""
    r = table(spark, d, "raw_text").where(F.col("site").rlike(r"(\d+)\.example$"))
    return r.groupBy("source_name", F.regexp_extract("site", r"(\d+)\.example$", 1).cast("long").alias("number")).agg(F.count("*").alias("n"))


# --- C: projections ----------------------------------------------------------------


@query(
    f"""select 'qa' as kind, row_id as id, {R.strip("concat(coalesce(context, ''), ' ', coalesce(question, ''), ' ', coalesce(answers.text[1], ''))")} as text from qa_context
union all select 'news', article_id, coalesce(document, array_to_string(list_filter(list_transform(document_list, lambda p: {R.strip('p')}), lambda p: p is not null and p <> ''), ' ')) from naver_news
union all select 'translated', news_id, {R.strip('trans_text')} from translated_news
union all select 'lambada', item_id, coalesce(nullif(text, ''), context) from lambada where coalesce(nullif(text, ''), context) <> ''"""
)
def c_projections(spark, d):
    """The text of each kind of source."""
    qa = table(spark, d, "qa_context").select(F.lit("qa").alias("kind"), F.col("row_id").alias("id"), C.qa_text().alias("text"))
    news = table(spark, d, "naver_news").select(F.lit("news"), "article_id", C.news_text())
    moved = table(spark, d, "translated_news").select(F.lit("translated"), "news_id", T.strip(F.col("trans_text")))
    item = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("context"))
    lam = table(spark, d, "lambada").select(F.lit("lambada"), "item_id", item).where(item != "")
    return qa.union(news).union(moved).union(lam)


@query(
    f"""select item_id, {R.strip("concat(coalesce(text, context), ' ', coalesce(target, answer))")} as pair from lambada
where coalesce(text, context, '') <> '' and coalesce(target, answer, '') <> ''"""
)
def c5_pairs(spark, d):
    """Two fields joined, rows with an empty one dropped."""
    r = table(spark, d, "lambada")
    a, b = F.coalesce("text", "context"), F.coalesce("target", "answer")
    return r.where((a != "") & (b != "")).select("item_id", T.strip(F.concat(a, F.lit(" "), b)).alias("pair"))


# --- D: filters --------------------------------------------------------------------


@query(
    f"""select doc_id, length(text) >= 50 as chars_ok, len({R.words('text')}) >= 100 as words_ok,
  case when len({R.words('text')}) <= 128 then 'keep' when len({R.words('text')}) <= 192 then 'truncate' else 'chunk' end as route,
  length(text) between 800 and 2500 as band_long, length(text) between 300 and 3000 as band_wide {TEXT}"""
)
def d1_length_filters(spark, d):
    """Floors, bands and the route by length."""
    n = F.size(T.words(F.col("text")))
    c = F.length("text")
    return docs(spark, d).select(
        "doc_id", (c >= 50).alias("chars_ok"), (n >= 100).alias("words_ok"),
        F.when(n <= 128, "keep").when(n <= 192, "truncate").otherwise("chunk").alias("route"),
        c.between(800, 2500).alias("band_long"), c.between(300, 3000).alias("band_wide"),
    )


_SPECIAL = " + ".join(R.count_of("text", c) for c in L.SPECIAL_CHARACTERS)
_LISTED = " or ".join(f"starts_with({R.strip('text')}, '{s}')" for s in L.LIST_STARTS)
_FAST = r"length(text) > 0 and %s >= 3 and len(regexp_extract_all(text, '[가-힣]')) / length(text) >= 0.4e0 and len(regexp_extract_all(text, '[^\pL\pN \n\t]')) / length(text) <= 0.3e0" % R.count_any("text", [".", "?", "!"])


@query(
    f"""select doc_id, length(text) between 800 and 3000 and {R.count_any('text', L.PRONOUN_STRINGS_MRC)} >= 3 and length(text) > 0 and ({_SPECIAL}) / length(text) <= 0.05e0 as mrc,
  length(text) between 500 and 1500 and not ({_LISTED}) and {R.count_of('text', '.')} >= 2 and {R.count_any('text', L.PRONOUN_STRINGS_PARAGRAPH)} >= 2
    and length(text) - length(replace(text, chr(10), '')) <= length(text) / 50 as paragraph,
  length(text) >= 1000 and {R.count_any('text', L.PRONOUN_STRINGS_STRICT)} >= 5 as strict,
  coalesce({_FAST}, false) as fast,
  {' + '.join(f"cast(contains(lower(text), '{i}') as int)" for i in L.INDICATORS)} >= 2 as rich {TEXT} and length(text) > 0"""
)
def d6_prefilters(spark, d):
    """The cheap prefilters."""
    x = F.col("text")
    return docs(spark, d).where(F.length("text") > 0).select(
        "doc_id", quality.prefilter_mrc(x).alias("mrc"), quality.prefilter_paragraph(x, 500, 1500).alias("paragraph"),
        quality.prefilter_strict(x).alias("strict"), quality.prefilter_fast(x).alias("fast"), quality.indicator_rich(x).alias("rich"),
    )


@query(
    r"""select doc_id, k, line from (select doc_id, unnest(range(1, len(ls) + 1)) as k, unnest(ls) as line from (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: %s), lambda l: length(l) >= 70 and len(regexp_extract_all(l, '[가-힣]')) >= 0.3e0 * length(l)) as ls from documents where text is not null))"""
    % R.strip(r"regexp_replace(l, '\([^)]*\)', '', 'g')")
)
def d15_clean_lines(spark, d):
    """Lines without brackets, long enough and of the language (by its script)."""
    ls = F.transform(F.split("text", "\n"), lambda x: T.strip(F.regexp_replace(x, r"\([^)]*\)", "")))
    ls = F.filter(ls, lambda x: (F.length(x) >= 70) & (F.regexp_count(x, F.lit("[가-힣]")) >= F.length(x) * 0.3))
    return docs(spark, d).select("doc_id", F.posexplode(ls).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "line")


@query(
    f"""select count(*) as all_rows, count(*) filter (a) as long_enough, count(*) filter (a and b) as with_marks, count(*) filter (a and b and c) as in_script,
  count(*) filter (not a) as failed_length, count(*) filter (a and not b) as failed_marks, count(*) filter (a and b and not c) as failed_script
from (select length(text) >= 100 as a, {R.count_any('text', ['.', '?', '!'])} >= 3 as b, len(regexp_extract_all(text, '[가-힣]')) >= 0.4e0 * length(text) as c {TEXT})"""
)
def d21_cascade(spark, d):
    """Passes and failures of each stage of a cascade, in one scan."""
    x = F.col("text")
    a, b, c = F.length(x) >= 100, T.count_any(x, [".", "?", "!"]) >= 3, F.regexp_count(x, F.lit("[가-힣]")) >= F.length(x) * 0.4
    n = F.count_if
    return docs(spark, d).select(a.alias("a"), b.alias("b"), c.alias("c")).agg(
        F.count("*").alias("all_rows"), n("a").alias("long_enough"), n(F.expr("a and b")).alias("with_marks"), n(F.expr("a and b and c")).alias("in_script"),
        n(F.expr("not a")).alias("failed_length"), n(F.expr("a and not b")).alias("failed_marks"), n(F.expr("a and b and not c")).alias("failed_script"),
    )


# --- E: functions ------------------------------------------------------------------

_LAM = "(select item_id, %s as s, coalesce(target, answer) as t from lambada where coalesce(text, context, '') <> '' and coalesce(target, answer, '') <> '')" % R.strip("coalesce(text, context)")
_MASKED = "case when ends_with(s, t) then left(s, length(s) - length(t)) || '[MASK]' when contains(s, t) then left(s, instr(s, t) - 1) || '[MASK]' || substr(s, instr(s, t) + length(t)) else s || ' [MASK]' end"


def lambada_items(spark, d):
    a, b = F.coalesce("text", "context"), F.coalesce("target", "answer")
    return table(spark, d, "lambada").where((a != "") & (b != "")).select("item_id", T.strip(a).alias("s"), b.alias("t"))


@query(f"select item_id, {_MASKED} as masked, replace(s, t, '[MASK]') as all_masked, case when contains(s, t) then {_MASKED} end as strict_masked from {_LAM}")
def e10_mask_target(spark, d):
    """The three ways to mask a target."""
    m = T.mask_word(F.col("s"), F.col("t"), L.MASK)
    return lambada_items(spark, d).select("item_id", m.alias("masked"), F.replace("s", "t", F.lit(L.MASK)).alias("all_masked"), F.when(F.contains("s", "t"), m).alias("strict_masked"))


@query(
    f"""select item_id, substr(m, greatest(0, i - 1 - 40) + 1, least(length(m), i - 1 + 6 + 40) - greatest(0, i - 1 - 40)) as clipped
from (select item_id, m, instr(m, '[MASK]') as i from (select item_id, {_MASKED} as m from {_LAM}))"""
)
def e4_clip(spark, d):
    """A window of characters around the mask."""
    return lambada_items(spark, d).select("item_id", T.clip_around(T.mask_word(F.col("s"), F.col("t"), L.MASK), L.MASK, 40, 40).alias("clipped"))


_AT = "list_position(list_transform(ws, lambda w: contains(w, '[MASK]')), true)"


@query(
    f"""select item_id, array_to_string(ws[greatest(1, least(mp - 7, len(ws) - 13)) : greatest(1, least(mp - 7, len(ws) - 13)) + 13], ' ') as kept
from (select item_id, ws, {_AT} as mp from (select item_id, {R.words('m')} as ws from (select item_id, {_MASKED} as m from {_LAM}))) where mp is not null"""
)
def e5_truncate(spark, d):
    """E5: a budget of 14 words around the mask, moved inwards at either end."""
    m = lambada_items(spark, d).select("item_id", T.mask_word(F.col("s"), F.col("t"), L.MASK).alias("m"))
    return m.select("item_id", T.truncate_around(F.col("m"), L.MASK, 14).alias("kept"))


@query(
    """select item_id, t as noun, j as josa, t || case j when '을/를' then case when f then '을' else '를' end when '은/는' then case when f then '은' else '는' end
  when '이/가' then case when f then '이' else '가' end else j end as joined
from (select item_id, t, j, ((ord(right(t, 1)) - 44032) % 28 + 28) % 28 <> 0 as f from (select item_id, coalesce(target, answer) as t from lambada where coalesce(target, answer, '') <> '')
  cross join (values ('을/를'), ('은/는'), ('이/가'), ('에서')) v(j))"""
)
def e3_particles(spark, d):
    """The particle that fits the last syllable."""
    x = table(spark, d, "lambada").select("item_id", F.coalesce("target", "answer").alias("noun")).where("noun <> ''")
    x = x.withColumn("josa", F.explode(F.array(*[F.lit(p) for p in ("을/를", "은/는", "이/가", "에서")])))
    return x.withColumn("joined", T.attach_particle(F.col("noun"), F.col("josa")))


@query(
    f"""select doc_id, k, sentence from (select doc_id, unnest(range(1, len(ss) + 1)) as k, unnest(ss) as sentence
  from (select doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).{{10,}}?[.!?]|.+'), lambda s: {R.strip('s')}), lambda s: s <> '') as ss {TEXT}))"""
)
def e7_scan_sentences(spark, d):
    """Sentences by scanning for an end mark."""
    x = docs(spark, d).select("doc_id", F.posexplode(T.scan_sentences(F.col("text"))).alias("k", "sentence"))
    return x.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "sentence")


@query(
    rf"""select doc_id, count(*) as n, cast(sum(length(s)) as bigint) as chars from (
  select doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1))) as s {TEXT}) where s <> '' group by doc_id"""
)
def e8_mark_sentences(spark, d):
    """Sentences by white space after an end mark."""
    x = docs(spark, d).select("doc_id", F.explode(T.mark_sentences(F.col("text"))).alias("s"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


_P = f"len(list_filter(w, lambda x: x in ({R.names(L.PRONOUNS_SIMPLE)}))) / len(w)"
_E = "len(list_filter(w, lambda x: " + " or ".join(f"contains(x, '{p}')" for p in L.PARTICLES_SIMPLE) + ")) / len(w)"


@query(
    f"""select doc_id, round(p, 6) as pronoun_density, round(e, 6) as entity_density, round(least(1.0e0, p * 20 + e * 3 + p * e * 50), 6) as coref_score
from (select doc_id, {_P} as p, {_E} as e from (select doc_id, {R.words('text')} as w {TEXT}) where len(w) > 0)"""
)
def e9_simple_scores(spark, d):
    """Densities without a tagger."""
    s = quality.simple_scores(docs(spark, d), "doc_id", "text")
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("pronoun_density", "entity_density", "coref_score")])


@query(f"select row_id, length(text) as n, length({R.strip('text')}) as stripped, {R.count_of('text', '다.')} as endings, {R.strip(chr(39) + '##' + chr(39) + ' || left(text, 5)')} as marked from raw_text where text is not null")
def e12_strip_count(spark, d):
    """Stripping, counting, length."""
    x = F.col("text")
    r = table(spark, d, "raw_text").where("text is not null")
    return r.select("row_id", F.length(x).cast("long").alias("n"), F.length(T.strip(x)).cast("long").alias("stripped"), T.count_of(x, "다.").alias("endings"), T.strip(F.concat(F.lit("##"), F.left(x, F.lit(5)))).alias("marked"))


@query(
    """select event_id, printf('%.4f', value) as fixed, round_even(value, 0) as even, least(100.0e0, greatest(0.0e0, value)) as clamped,
  repeat('#', cast(floor(least(100.0e0, greatest(0.0e0, value)) / 10) as int)) || repeat('.', 10 - cast(floor(least(100.0e0, greatest(0.0e0, value)) / 10) as int)) as bar from events where value is not null"""
)
def e17_formats(spark, d):
    """Half-even rounding, fixed digits, clamping, bars."""
    c = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value")))
    b = F.floor(c / 10).cast("int")
    return table(spark, d, "events").where("value is not null").select(
        "event_id", T.fixed(F.col("value")).alias("fixed"), F.bround("value", 0).alias("even"), c.alias("clamped"),
        F.concat(F.repeat(F.lit("#"), b), F.repeat(F.lit("."), F.lit(10) - b)).alias("bar"),
    )


_IDS = f"list_transform({R.words('text')}, lambda w: cast(length(w) as int))"


@query(
    f"""select doc_id, list_resize({_IDS}[1:64], 64, 0) as input_ids, list_resize(list_transform({_IDS}[1:64], lambda w: 1), 64, 0) as attention_mask,
  least(64, len({_IDS})) as used, round(0.1e0 + 0.2e0 * least(1.0e0, len({_IDS}) / 64), 6) as mask_chance {TEXT}"""
)
def e19_padded(spark, d):
    """Fixed-length arrays, their mask, the masking chance by length (ids are word lengths here)."""
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    x = docs(spark, d).select("doc_id", ids.alias("ids"))
    return x.select(
        "doc_id", T.padded(F.col("ids"), 64).alias("input_ids"), T.padded(F.transform("ids", lambda w: F.lit(1)), 64).alias("attention_mask"),
        F.least(F.lit(64), F.size("ids")).cast("long").alias("used"), F.round(0.1 + F.lit(0.2) * F.least(F.lit(1.0), F.size("ids") / 64), 6).alias("mask_chance"),
    )


@query(
    f"""select doc_id, len(list_filter(range(1, len({_IDS}) + 1), lambda i: cast('0x' || left(md5('7:' || doc_id || ':' || i), 4) as bigint) < 9830)) as masked, len({_IDS}) as n {TEXT}"""
)
def e21_random_mask(spark, d):
    """A seeded choice of 15 % of the positions."""
    n = F.size(T.words(F.col("text")))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hit = lambda i: F.conv(F.left(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"), F.lit(":"), i.cast("string"))), F.lit(4)), 16, 10).cast("long") < 9830
    return docs(spark, d).select("doc_id", F.size(F.filter(at, hit)).cast("long").alias("masked"), n.cast("long").alias("n"))


# --- F2 to F8: chunkers ------------------------------------------------------------

_SENTS = f"(select doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).{{10,}}?[.!?]|.+'), lambda s: {R.strip('s')}), lambda s: s <> '') as ss {TEXT})"
_PARAS = f"(select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {R.strip('p')}), lambda p: p <> '') as ss {TEXT})"


def _packed(source: str, add: str, end: str) -> str:
    """A fold in SQL: a is the state (done, cur, n), x the next element (cur, its size n, its first 64 words)."""
    element = f"{{'done': cast([] as varchar[]), 'cur': s, 'n': len({R.words('s')}), 'cut': array_to_string({R.words('s')}[1:64], ' ')}}"
    begin = "{'done': cast([] as varchar[]), 'cur': '', 'n': cast(0 as bigint), 'cut': ''}"
    fold = f"select doc_id, list_reduce(list_prepend({begin}, list_transform(ss, lambda s: {element})), lambda a, x: {add}) as a from {source}"
    return f"select doc_id, cast(unnest(range(0, len(cs))) as int) as k, unnest(cs) as chunk from (select doc_id, {end} as cs from ({fold}))"


def _state(done: str, cur: str, n: str) -> str:
    return f"{{'done': {done}, 'cur': {cur}, 'n': {n}, 'cut': ''}}"


_FLUSHED = f"case when a.cur <> '' and a.n > 19.2e0 then list_append(a.done, {R.strip('a.cur')}) else a.done end"
_LOOSE = f"case when a.n >= 38.4e0 then list_append(a.done, {R.strip('a.cur')}) else a.done end"
_MORE = _state("a.done", "a.cur || ' ' || x.cur", "a.n + x.n")
_GREEDY_SQL = _packed(
    _SENTS,
    f"case when x.n > 64 then {_state(f'list_append({_FLUSHED}, x.cut)', chr(39) * 2, '0')} when a.n + x.n > 64 and a.cur <> '' then {_state(_FLUSHED, 'x.cur', 'x.n')} else {_MORE} end",
    _FLUSHED,
)
_LOOSE_SQL = _packed(_SENTS, f"case when a.n + x.n > 64 and a.cur <> '' then {_state(_LOOSE, 'x.cur', 'x.n')} else {_MORE} end", f"case when a.cur <> '' then {_LOOSE} else a.done end")
_FIRST = f"array_to_string({R.words('a.cur')}[1:64], ' ')"
_SEG = f"case when a.n >= 44 then list_append(a.done, {_FIRST}) else a.done end"
_SEGMENT_SQL = _packed(_PARAS, f"case when a.n > 0 and a.n + x.n > 64 then {_state(_SEG, 'x.cur', 'x.n')} when a.n = 0 then {_state('a.done', 'x.cur', 'x.n')} else {_MORE} end", _SEG)
_MERGE_SQL = _packed(
    _PARAS,
    f"case when a.cur = '' then {_state('a.done', 'x.cur', 'x.n')} when length(a.cur) < 300 then {_state('a.done', 'a.cur || chr(10) || chr(10) || x.cur', 'x.n')} "
    f"else {_state('case when length(a.cur) <= 1500 then list_append(a.done, a.cur) else a.done end', 'x.cur', 'x.n')} end",
    "case when length(a.cur) between 300 and 1500 then list_append(a.done, a.cur) else a.done end",
).replace("as chunk from", "as paragraph from")
_SLIDING_SQL = f"""select doc_id, k, array_to_string(every[s + 1 : s + 64], ' ') as chunk from (
  select doc_id, every, cast(unnest(range(0, len(ss))) as int) as k, cast(unnest(starts) as bigint) as s from (
    select doc_id, ss, flatten(list_transform(ss, lambda t: {R.words('t')})) as every, list_transform(range(1, len(ss) + 1), lambda i: coalesce(list_sum(sizes[1 : i - 1]), 0)) as starts
    from (select doc_id, ss, list_transform(ss, lambda t: len({R.words('t')})) as sizes from {_SENTS}))) where least(64, len(every) - s) >= 44"""


@query(f"select doc_id, k, chunk, len({R.words('chunk')}) as n_words from ({_GREEDY_SQL})")
def f2_greedy_chunks(spark, d):
    """F2, D3: sentences packed to 64 words."""
    x = docs(spark, d).select("doc_id", F.posexplode(chunking.greedy(T.scan_sentences(F.col("text")), 64)).alias("k", "chunk"))
    return x.withColumn("n_words", F.size(T.words(F.col("chunk"))).cast("long"))


@query(_LOOSE_SQL)
def f3_loose_chunks(spark, d):
    """the same without cutting a long sentence."""
    return docs(spark, d).select("doc_id", F.posexplode(chunking.loose(T.scan_sentences(F.col("text")), 64)).alias("k", "chunk"))


@query(
    f"""select doc_id, i // 48 as k, array_to_string(w[i + 1 : i + 64], ' ') as chunk
from (select doc_id, w, unnest(range(0, len(w), 48)) as i from (select doc_id, {R.words('text')} as w {TEXT})) where least(64, len(w) - i) >= 44"""
)
def f4_windows(spark, d):
    """overlapping windows of words, short last ones dropped."""
    w = chunking.windows(T.words(F.col("text")), 64, 16)
    return docs(spark, d).select("doc_id", F.posexplode(w).alias("k", "c")).select("doc_id", F.col("k").cast("long").alias("k"), F.array_join("c", " ").alias("chunk"))


@query(_SLIDING_SQL)
def f5_sliding(spark, d):
    """from each sentence on, 64 words of whole sentences."""
    return docs(spark, d).select("doc_id", F.posexplode(chunking.sliding(T.scan_sentences(F.col("text")), 64)).alias("k", "c")).select("doc_id", "k", F.array_join("c", " ").alias("chunk"))


@query(_SEGMENT_SQL)
def f6_segments(spark, d):
    """paragraphs packed whole to 64 words."""
    return docs(spark, d).select("doc_id", F.posexplode(chunking.segments(T.paragraphs(F.col("text")), 64)).alias("k", "chunk"))


@query(_MERGE_SQL)
def f7_merged_paragraphs(spark, d):
    """short paragraphs merged until 300 characters, over 1,500 dropped."""
    return docs(spark, d).select("doc_id", F.posexplode(chunking.merged_paragraphs(T.paragraphs(F.col("text")), 300, 1500)).alias("k", "paragraph"))


@query(
    f"""select doc_id, k, paragraph from (select doc_id, unnest(range(0, len(ps))) as k, unnest(ps) as paragraph from (
  select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {R.strip('p')}), lambda p: p <> '') as ps {TEXT})) where length(paragraph) >= 300"""
)
def f8_paragraphs(spark, d):
    """F8: paragraphs of 300 characters or more, with their place."""
    x = docs(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("k", "paragraph"))
    return x.where(F.length("paragraph") >= 300).select("doc_id", F.col("k").cast("long").alias("k"), "paragraph")


#: D14's least pronouns, pronoun density and entity density of each kind of source.
TRIPLE_GATES = {"naver": (2, 0.008, 0.55), "wiki": (2, 0.01, 0.5), "klue": (1, 0.0, 0.0)}


def _of_kind(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """id, text of the articles for training, the encyclopedia and the contexts of questions."""
    news = table(spark, d, "naver_news").where("split = 'train'").select(F.col("article_id").alias("id"), C.news_text().alias("text"))
    wiki = table(spark, d, "raw_text").where("source_name = 'wiki_ko'").select(F.col("row_id").alias("id"), "text")
    mrc = table(spark, d, "qa_context").where("source_name = 'klue_mrc'").select(F.col("row_id").alias("id"), F.col("context").alias("text"))
    return {k: x.where("id is not null and text is not null").distinct() for k, x in (("naver", news), ("wiki", wiki), ("klue", mrc))}


def _chunks_of(kind: str, target: int):
    """Sentences from each one on (E8, F5), of an encyclopedia its clean lines by paragraph (D15), packed."""
    if kind != "wiki":
        return F.transform(chunking.sliding(T.mark_sentences(F.col("text")), target, 0.25 if kind == "klue" else 0.7), lambda c: F.array_join(c, " "))
    lines = F.transform(T.paragraphs(F.col("text")), lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), _clean_line), _long_line), " "))
    return chunking.segments(F.filter(lines, lambda x: x != ""), target)


def _clean_line(x):
    return T.strip(F.regexp_replace(x, r"\([^)]*\)", ""))


def _long_line(x):
    return (F.length(x) >= 70) & (F.regexp_count(x, F.lit("[가-힣]")) >= F.length(x) * 0.3)


@query()
def n8_two_targets(spark, d):
    """One pass for two target lengths, the chunks of each kind of source (E8, D15, F5, F6) by its triple gate (G1, D14); no quota."""
    found = None
    for kind, rows in _of_kind(spark, d).items():
        both = F.array(*[F.struct(F.lit(n).alias("target"), _chunks_of(kind, n).alias("chunks")) for n in (32, 64)])
        x = rows.select(F.lit(kind).alias("source"), F.explode(both).alias("z")).select("source", "z.target", F.explode("z.chunks").alias("chunk"))
        least, p, e = TRIPLE_GATES[kind]
        v = quality.vector(x.withColumn("row", F.struct("source", "target")), "row", "chunk").withColumnRenamed("name_count", "names")
        good = v.where((F.col("pronoun_count") >= least) & (F.col("pronoun_density") >= p) & (F.col("entity_density") >= e)).select("row.*", "names")
        found = good if found is None else found.union(good)
    return found.groupBy("target", "source").agg(F.count("*").alias("chunks"), F.sum("names").alias("names"))


def _fixed(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """key and exactly ``size`` word ids of each text, 0 where it has fewer words."""
    words = T.words(F.col("text"))
    named = {c: f"key_{c}" for c in key}
    ids = V.encoded(rows.withColumnsRenamed(named), list(named.values()), F.slice(words, 1, size), V.vocabulary(rows, words))
    return ids.select(*[F.col(named[c]).alias(c) for c in key], T.padded(F.transform("ids", lambda i: i.cast("int")), size).alias("input_ids"))


def filtered_texts(spark: SparkSession, d: str) -> DataFrame:
    """source, id, k, text of N7: prefilters (D6, D7, D5), merged paragraphs (F7), worker vector (G3), gate of the profile."""
    kinds = _of_kind(spark, d)
    merged = chunking.merged_paragraphs(T.paragraphs(F.col("text")), 500, 1500)
    parts = {
        "mrc": kinds["klue"].select("id", F.lit(0).alias("k"), "text").where(quality.prefilter_mrc(F.col("text"))),
        "encyclopedia": kinds["wiki"].select("id", F.posexplode(merged).alias("k", "text")).where(quality.prefilter_paragraph(F.col("text"), 500, 1500)),
        "news": kinds["naver"].select("id", F.lit(0).alias("k"), "text").where(F.length("text") >= 800),
    }
    found = None
    for profile, x in parts.items():
        row = F.struct(F.lit(profile).alias("source"), "id", F.col("k").cast("long").alias("k"), "text")
        good = quality.worker_vector(x.withColumn("row", row), "row", "text").where(quality.gate(profile)).select("row.*")
        found = good if found is None else found.union(good)
    return found


@query()
def n7_filtered(spark, d):
    """The texts that pass each source's filters, as 1,536 word ids (F15); all of them: no target stops it."""
    rows = stored(filtered_texts(spark, d).withColumn("version", F.xxhash64("text")), "filtered-texts")
    return _fixed(rows, ["source", "id", "k", "version"], 1536).drop("version")


def training_chunks(spark: SparkSession, d: str, stride: int | None = None, threshold: float = 0.6) -> DataFrame:
    """place, source, id, k, text, quality_score of N5: all sources (C10, J9) in chunks (N2), quality (G1), gate (D12), seeded order.

    ``stride``: about so many chunks are analysed (I2), the others lost; by default all are.
    """
    texts = C.union_sources(spark, d).where(F.length("text") >= 50).distinct()
    x = texts.select("source", "id", F.xxhash64("text").alias("version"), F.posexplode(chunking.routed(F.col("text"), 128)).alias("k", "text"))
    x = x.withColumn("h", F.md5(F.concat_ws(":", F.lit("42"), "source", "id", "version", "k")))
    if stride:
        from jikjo.operators import sampling

        x = sampling.strided(stored(x, "training-chunks"), "h", stride)
    row = F.struct("source", "id", "version", F.col("k").cast("long").alias("k"), "h", "text")
    v = quality.vector(x.withColumn("row", row), "row", "text").where(F.col("quality_score") >= threshold)
    return numbered(v.select("row.*", "quality_score", "pronoun_density", "entity_density"), ["h"], "place").drop("h", "version")


@query()
def n5_training_set(spark, d):
    """Every chunk of all sources that passes the quality gate, in a seeded order, as 128 word ids."""
    rows = stored(training_chunks(spark, d), "training-set")
    return _fixed(rows, ["place", "source", "id", "k"], 128)


@query()
def n5_quality(spark, d):
    """Mean quality of the first hundred rows of the training set, and its tier."""
    m = training_chunks(spark, d).where("place <= 100").agg(*[F.avg(c).alias(c) for c in ("quality_score", "pronoun_density", "entity_density")])
    return m.withColumn("tier", F.when(F.col("quality_score") > 0.8, "high").when(F.col("quality_score") > 0.6, "good").otherwise("low"))


@query(
    f"""select row_number() over (order by md5('42:' || doc_id), doc_id) as place, doc_id, list_resize({_IDS}[1:32], 32, 0) as input_ids
from documents where text is not null and length(text) >= 50 order by md5('42:' || doc_id), doc_id limit 100"""
)
def n1_training_head(spark, d):
    """N4 without tokens: floor, seeded shuffle, head, fixed length, of documents alone. The whole pipeline is n5_training_set."""
    from jikjo.operators import sampling

    head = sampling.shuffled_head(docs(spark, d).where(F.length("text") >= 50).select("doc_id", "text"), "doc_id", 100, 42)
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(sampling.chance_key("doc_id", 42), "doc_id"))  # over the hundred rows of the head
    return head.select(place.cast("long").alias("place"), "doc_id", T.padded(ids, 32).alias("input_ids"))


@query(
    """select name, coalesce(subset, 'all') as subset, coalesce(description, name) as description, coalesce(m.target_share, 0) as target_share, coalesce(m.max_repeats, 1) as max_repeats
from dataset_source s left join mix_targets m on m.source = s.name"""
)
def a14_defaults(spark, d):
    """Descriptors completed from another table, missing fields by default."""
    m = table(spark, d, "mix_targets").withColumnRenamed("source", "name")
    s = table(spark, d, "dataset_source").select("name", "subset", "description").join(F.broadcast(m), "name", "left")
    return s.select(
        "name", F.coalesce("subset", F.lit("all")).alias("subset"), F.coalesce("description", "name").alias("description"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"),
    )


@query()
def n2_routed_chunks(spark, d):
    """Extraction, floors, routing and chunks in one plan, the text of each kind of source."""
    x = C.union_sources(spark, d).where(F.length("text") >= 50).select("source", "id", F.explode(chunking.routed(F.col("text"), 128)).alias("chunk"))
    return x.groupBy("source").agg(F.count("*").alias("chunks"), F.max(F.size(T.words(F.col("chunk")))).alias("most_words"))


@query(
    f"""with vocab as (select w, row_number() over (order by n desc, w) as id from (select w, count(*) as n from (select unnest({R.words('text')}) as w {TEXT}) group by w))
select v.id, v.w, count(distinct t.doc_id) as n_docs from (select doc_id, unnest({R.words('text')}[1:10]) as w {TEXT}) t join vocab v on t.w = v.w group by all"""
)
def f16_vocabulary_ids(spark, d):
    """Word ids by frequency, with the documents that have the word among their first ten: as its SQL says. Whole texts: f16_word_documents, f16_decoded."""
    w = docs(spark, d).select("doc_id", T.words(F.col("text")).alias("w"))
    counts = w.select(F.explode("w").alias("w")).groupBy("w").agg((-F.count("*")).alias("m"))
    vocab = numbered(counts, ["m", "w"], "id").select("w", "id")
    first = w.select("doc_id", F.explode(F.slice("w", 1, 10)).alias("w"))
    return first.join(vocab, "w").groupBy("id", "w").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(
    f"""with each as (select doc_id, unnest({R.words('text')}) as w {TEXT}), vocab as (select w, row_number() over (order by n desc, w) as id from (select w, count(*) as n from each group by w))
select v.id, v.w, count(distinct e.doc_id) as n_docs from each e join vocab v on e.w = v.w group by all"""
)
def f16_word_documents(spark, d):
    """F16: the word of every id, and in how many documents it stands, whatever its place."""
    rows = docs(spark, d)
    each = rows.select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    seen = each.where("doc_id is not null").distinct().groupBy("w").agg(F.count("*").alias("n"))
    out = V.vocabulary(rows, T.words(F.col("text"))).join(seen, "w", "left")
    return out.select("id", "w", F.coalesce("n", F.lit(0).cast("long")).alias("n_docs"))


@query(f"select doc_id, array_to_string({R.words('text')}, ' ') as text from (select distinct doc_id, text {TEXT})")
def f16_decoded(spark, d):
    """Every text as ids of all its words, and these decoded to text."""
    rows = docs(spark, d).select("doc_id", F.xxhash64("text").alias("version"), T.words(F.col("text")).alias("words"))
    key = ["doc_id", "version"]
    vocab = V.vocabulary(rows, F.col("words"))
    ids = stored(V.encoded(rows, key, F.col("words"), vocab), "word-ids")
    return V.decoded(ids, key, F.col("ids"), vocab).select("doc_id", "text")
