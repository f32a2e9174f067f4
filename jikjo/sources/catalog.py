"""The source catalog's readers: what is the text of each kind of source, and unions of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jikjo.functions import text as T


def qa_text() -> Column:
    """Context, question and first answer; missing parts are empty."""
    answer = F.get(F.col("answers.text"), 0)
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("context"), F.col("question"), answer)]
    return T.strip(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))


def news_text() -> Column:
    """The article as it stands, or its paragraphs stripped and joined; blank ones dropped."""
    listed = F.array_join(F.filter(F.transform("document_list", T.strip), lambda p: p.isNotNull() & (p != "")), " ")
    return F.coalesce("document", listed)


def first_delivery(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key once, by the smallest of the order columns; partial minima before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(key).agg(best.alias("__m")).select(key, *[F.col("__m")[c].alias(c) for c in rest])


def first_split(df: DataFrame, preference: list[str], column: str = "split") -> DataFrame:
    """The rows of the first split that has any; none if no split has."""
    there = {r[0] for r in df.where(F.col(column).isin(preference)).select(column).distinct().collect()}
    return df.where(F.col(column) == next((s for s in preference if s in there), ""))


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """source, id, text of every table of texts."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{d}/{name}.parquet")

    joined = F.coalesce("document", F.array_join("document_list", " "))
    parts = [
        t("raw_text").select(F.col("source_name").alias("source"), F.col("row_id").alias("id"), "text"),
        t("qa_context").select(F.coalesce("source_name", F.lit("qa")).alias("source"), F.col("row_id").alias("id"), F.col("context").alias("text")),
        t("naver_news").select(F.lit("naver").alias("source"), F.col("article_id").alias("id"), joined.alias("text")),
        t("translated_news").select(F.lit("translated").alias("source"), F.col("news_id").alias("id"), F.col("trans_text").alias("text")),
    ]
    return reduce(DataFrame.unionByName, parts)
