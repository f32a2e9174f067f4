"""The queries of this subpackage, pN_..., and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jikjo.llm import contamination, mixing, mojibake, neardup, packing, quality, sampling, sentences, splitting, tokens
from jikjo.storage import stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Where the texts are that problem 1 splits.
LONG = (("raw_text", "row_id", "text"), ("qa_context", "row_id", "context"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """A record that the operator had to cut is oversized; its boundary table has the longest stretch without a pause."""
    found = None
    for name, key, text in LONG:
        cut = splitting.oversized_pieces(table(spark, d, name), key, text, limit=2_000).where("piece_no = 0")
        kinds = F.array(F.lit("oversized"), F.when(F.col("longest_stretch") > 2_000, F.lit("no_boundary")))
        one = cut.select(F.lit(name).alias("rec_table"), "rec_id", F.explode(F.array_compact(kinds)).alias("case_kind"))
        found = one if found is None else found.union(one)
    return found


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for name, key, text in LONG:
        one = splitting.oversized_pieces(table(spark, d, name), key, text).select(F.lit(name).alias("rec_table"), "*")
        found = one if found is None else found.union(one)
    return found


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wiki = table(spark, d, "raw_text").where("source_name = 'wiki_ko'")
    news = table(spark, d, "naver_news").where("split = 'train'")
    return sentences.sentences(wiki, "raw_text", "row_id", "text").union(sentences.sentences(news, "naver_news", "article_id", "document"))


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every raw text and every article; those of a list of paragraphs count their positions in the joined text."""
    news = table(spark, d, "naver_news").withColumn("whole", F.coalesce("document", F.array_join("document_list", "\n")))
    raw = sentences.sentences(table(spark, d, "raw_text"), "raw_text", "row_id", "text")
    return raw.union(sentences.sentences(news, "naver_news", "article_id", "whole"))


#: Where the texts are that problem 3 compares.
COPIED = (("raw_text", "row_id", "text"), ("translated_news", "news_id", "trans_text"))


#: What counts as a near duplicate: runs of five characters in common, of texts that keep 200.
NEAR = {"threshold": 0.6, "width": 5, "least": 200, "words": False}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = [neardup.near_pairs(table(spark, d, name), name, key, text, **NEAR) for name, key, text in COPIED]
    return found[0].union(found[1])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same question for large collections: a class and a number of links for every record."""
    found = [neardup.near_classes(table(spark, d, name), name, key, text, **NEAR) for name, key, text in COPIED]
    return found[0].union(found[1])


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    streams = table(spark, d, "dataset_source").where("is_streaming").select(F.col("name").alias("source_name"))
    rows = table(spark, d, "raw_text").join(streams, "source_name", "left_semi")
    got = sampling.sample(rows, "row_id", k=SAMPLE, earliest=["arrived_at", "piece_no"])
    return got.select("row_id", "source_name", "text")


#: Records in the sample of p4_sample.
SAMPLE = 2_000

P4_SQL = f"""
with streams as (select name from dataset_source where is_streaming),
     picked as (
       select distinct row_id, md5('42:' || cast(row_id as varchar)) as h
       from raw_text where source_name in (select name from streams) and row_id is not null
       order by h limit {SAMPLE})
select distinct r.row_id, r.source_name, r.text
from raw_text r join picked p on r.row_id = p.row_id
where r.source_name in (select name from streams)
"""


def evaluation_items(spark: SparkSession, d: str) -> DataFrame:
    """bench, item_id, text of the items that must not leak."""
    one = table(spark, d, "lambada").select(F.lit("lambada").alias("bench"), "item_id", F.coalesce("text", "context").alias("text"))
    two = table(spark, d, "hellaswag").where("split in ('validation', 'test')").select(F.lit("hellaswag"), "item_id", "paragraph")
    return one.union(two)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_leaks(spark, d).select("bench", "item_id", "row_id")


def p5_leaks(spark: SparkSession, d: str) -> DataFrame:
    index = contamination.build_index(table(spark, d, "raw_text"), "row_id", "text")
    return contamination.leaks(index, evaluation_items(spark, d), share=0.45)


def _typed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    return [
        ("documents", table(spark, d, "documents"), "doc_id", "text"),
        ("raw_text", table(spark, d, "raw_text"), "row_id", "text"),
        ("naver_news", table(spark, d, "naver_news").withColumn("whole", F.coalesce("document", F.array_join("document_list", "\n"))), "article_id", "whole"),
    ]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_statistics(spark, d).where("text_type is not null and prose_share < 0.5").select("rec_table", "rec_id")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(_typed(spark, d)).dropDuplicates(["rec_table", "rec_id"])


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.sizes(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(stored(sized, "pack-sizes"), "doc_id", table(spark, d, "seq_budgets"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p7_pack(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_pack(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.sizes(table(spark, d, "documents"), "doc_id", "text", keep=["source"])
    return mixing.mix(sized, "doc_id", table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id", "case_kind")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_sentences": p2_sentences,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_sample": p4_sample,
    "p5_found": p5_found,
    "p5_leaks": p5_leaks,
    "p6_found": p6_found,
    "p6_statistics": p6_statistics,
    "p7_pack": p7_pack,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_PAUSE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？…।]"
P1_SQL = " union ".join(
    f"""select '{name}' as rec_table, {key} as rec_id, unnest(case when list_max(list_transform(regexp_split_to_array({text}, '{_PAUSE}'), lambda s: length(s))) > 2000
  then ['oversized', 'no_boundary'] else ['oversized'] end) as case_kind from {name} where length({text}) > 2000 and {key} is not null"""
    for name, key, text in LONG
)
#: What NFKC does to the characters that occur beyond NFC: the full-width forms, and a few letters.
_ALNUM = "".join(chr(k) for k in range(0x21, 0x7F) if chr(k).isalnum())
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ALNUM) + "ⓒำ", _ALNUM + "cา"
_KEPT = r"regexp_replace(lower(translate(nfc_normalize({}), '%s', '%s')), '[^\p{{L}}\p{{N}}]', '', 'g')" % _WIDE
_NEAR = f"""kept as materialized ({" union all ".join(f"select '{name}' as rec_table, {key} as id, {_KEPT.format(text)} as k from (select distinct {key}, {text} from {name} where {key} is not null)" for name, key, text in COPIED)}),
  texts as materialized (select rec_table, k, min(id) as rep, list(id) as ids from kept where length(k) >= 200 group by all),
  grams as materialized (select distinct rec_table, rep, hash(substr(k, i, 5)) as g from (select rec_table, rep, k, unnest(range(1, length(k) - 3)) as i from texts)),
  sizes as (select rec_table, rep, count(*) as n from grams group by all),
  common as (select a.rec_table, a.rep as a, b.rep as b, count(*) as m from grams a join grams b on a.rec_table = b.rec_table and a.g = b.g and a.rep < b.rep group by all),
  links as materialized (select m.rec_table, m.a, m.b from common m join sizes x on x.rec_table = m.rec_table and x.rep = m.a join sizes y on y.rec_table = m.rec_table and y.rep = m.b where m.m >= 0.6 * (x.n + y.n - m.m))"""
P3_SQL = f"""with {_NEAR}, each as (select rec_table, rep, unnest(ids) as i from texts), pairs as (select * from links union all select rec_table, rep, rep from texts)
select distinct l.rec_table, least(x.i, y.i) as id_a, greatest(x.i, y.i) as id_b from pairs l
join each x on x.rec_table = l.rec_table and x.rep = l.a join each y on y.rec_table = l.rec_table and y.rep = l.b where x.i <> y.i"""
P3_CLASSES_SQL = f"""with recursive {_NEAR}, ways as (select rec_table, a, b from links union all select rec_table, b, a from links),
  reach as (select rec_table, rep, rep as other from texts union select r.rec_table, r.rep, w.b from reach r join ways w on w.rec_table = r.rec_table and w.a = r.other),
  classes as (select rec_table, rep, min(other) as class_id from reach group by all),
  degree as (select w.rec_table, w.a as rep, sum(len(t.ids)) as n from ways w join texts t on t.rec_table = w.rec_table and t.rep = w.b group by all)
select t.rec_table, unnest(t.ids) as id, c.class_id, cast(len(t.ids) - 1 + coalesce(d.n, 0) as bigint) as n_links from texts t join classes c using (rec_table, rep) left join degree d using (rec_table, rep)
union all select rec_table, unnest(ids), least_id, cast(len(ids) - 1 as bigint) from (select rec_table, list(id) as ids, min(id) as least_id from kept where length(k) between 1 and 199 group by rec_table, k)
union all select rec_table, id, id, 0 from kept where coalesce(k, '') = ''"""
SQL: dict[str, str] = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p3_classes": P3_CLASSES_SQL, "p4_sample": P4_SQL}
