"""Quality vectors of documents and their gates, from a tagger's counts: one Arrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jikjo.functions import lexicon as L
from jikjo.functions import text as T
from jikjo.functions.tagger import COUNTS, tokens
from jikjo.functions.tagger import counts as tagger_counts


def _n(test) -> Column:
    return F.size(F.filter("__t", test)).cast("long")


def _is(*tags: str):
    return lambda t: t["tag"].isin(*tags)


def with_tokens(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("__t", tokens(text))


def counted(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The kept columns and the tagger's counts of a text, in an Arrow pass that holds no rows back."""
    rows = df.select(*keep, text.alias("__text"))
    ddl = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = tagger_counts(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *n.flatten()], [*b.schema.names[:-1], *COUNTS])

    return rows.mapInArrow(run, ddl)


def vector(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and 14 fields: counts, densities by meaningful words, and the scores made of them.  A text without words scores 0.2."""
    return scored(counted(df.where(F.col(text).isNotNull()), F.col(text), key))


def scored(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.lit(1), F.col("total_words"))
    d = counts
    for k in ("pronoun", "entity", "verb"):
        d = d.withColumn(f"{k}_density", F.col(f"{k}_count") / words)
    p, e, v = F.col("pronoun_density"), F.col("entity_density"), F.col("verb_density")
    d = d.withColumn("coref_score", F.least(F.lit(1.0), p * 20 + e * 3 + p * e * 50))
    d = d.withColumn("complexity_score", F.least(F.lit(1.0), e * 10 + v * 5 + p * 15))
    d = d.withColumn("balance_score", 1.0 - F.abs(p - e * 0.3))
    return d.withColumn("quality_score", F.col("coref_score") * 0.5 + F.col("complexity_score") * 0.3 + F.col("balance_score") * 0.2)


def worker_vector(df: DataFrame, key: str, text: str, prefix: int = 1500) -> DataFrame:
    """The reduced vector over the first ``prefix`` characters, the profile's own limit; nothing for a text under 50 characters or without words."""
    c = counted(df.where(F.length(text) >= 50), F.left(F.col(text), F.lit(prefix)), key).drop("name_count")
    words = F.greatest(F.lit(1), F.col("total_words"))  # a later filter may be computed before this one
    c = c.where("total_words > 0").withColumn("pronoun_density", F.col("pronoun_count") / words).withColumn("entity_density", F.col("entity_count") / words)
    return c.withColumn("pronoun_entity_ratio", F.col("pronoun_count") / F.greatest(F.lit(1), F.col("entity_count")))


def character_vector(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts and densities per 100 characters; a noun that holds a pronoun string counts as one."""

    def pronoun(t: Column) -> Column:
        hit = F.lit(False)
        for p in L.PRONOUNS_PROFILE:
            hit = hit | F.contains(t["form"], F.lit(p))
        return t["tag"].isin("NP", "NNG") & hit

    n = F.length(text)
    return with_tokens(df.where(n > 0), F.col(text)).select(
        key,
        _n(pronoun).alias("pronoun_count"),
        _n(lambda t: ~pronoun(t) & t["tag"].isin("NP", "NNP")).alias("entity_count"),
        (_n(pronoun) * 100.0 / n).alias("pronoun_density"),
        (_n(lambda t: ~pronoun(t) & t["tag"].isin("NP", "NNP")) * 100.0 / n).alias("entity_density"),
    )


def gate(profile: str) -> Column:
    """The common gate and the profile's own; null fields fail."""
    d, r = F.col("pronoun_density") * 100, F.col("pronoun_entity_ratio")
    ok = (F.col("pronoun_count") >= 2) & (F.col("entity_count") >= 5) & d.between(1.0, 5.0) & r.between(0.01, 0.15)
    own = {
        "mrc": (F.col("entity_count") >= 8) & (F.col("unique_pronouns") >= 2),
        "encyclopedia": F.col("unique_pronouns") >= 2,
        "news": (d >= 0.8) & (r >= 0.005),
    }
    return F.coalesce(ok & own.get(profile, F.lit(True)), F.lit(False))


def simple_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """Densities without a tagger: words in the pronoun list, words that hold a particle; null for blank texts."""
    w = df.select(key, T.words(F.col(text)).alias("__w")).where(F.size("__w") > 0)
    n = F.size("__w")

    def particle(x: Column) -> Column:
        hit = F.lit(False)
        for p in L.PARTICLES_SIMPLE:
            hit = hit | F.contains(x, F.lit(p))
        return hit

    d = w.select(
        key,
        (F.size(F.filter("__w", lambda x: x.isin(L.PRONOUNS_SIMPLE))) / n).alias("pronoun_density"),
        (F.size(F.filter("__w", particle)) / n).alias("entity_density"),
    )
    p, e = F.col("pronoun_density"), F.col("entity_density")
    return d.withColumn("coref_score", F.least(F.lit(1.0), p * 20 + e * 3 + p * e * 50))


def prefilter_mrc(text: Column) -> Column:
    special = sum((T.count_of(text, c) for c in L.SPECIAL_CHARACTERS), F.lit(0))
    return F.length(text).between(800, 3000) & (T.count_any(text, L.PRONOUN_STRINGS_MRC) >= 3) & (special / F.length(text) <= 0.05)


def prefilter_paragraph(text: Column, least: int, most: int) -> Column:
    listed = F.lit(False)
    for s in L.LIST_STARTS:
        listed = listed | F.startswith(T.strip(text), F.lit(s))
    return (
        F.length(text).between(least, most)
        & ~listed
        & (T.count_of(text, ".") >= 2)
        & (T.count_any(text, L.PRONOUN_STRINGS_PARAGRAPH) >= 2)
        & (T.count_of(text, "\n") <= F.length(text) / 50)
    )


def prefilter_strict(text: Column) -> Column:
    return (F.length(text) >= 1000) & (T.count_any(text, L.PRONOUN_STRINGS_STRICT) >= 5)


def prefilter_fast(text: Column) -> Column:
    marks = T.count_any(text, [".", "?", "!"])
    hangul = F.regexp_count(text, F.lit("[가-힣]")) / F.length(text)
    other = F.regexp_count(text, F.lit(r"[^\p{L}\p{N} \n\t]")) / F.length(text)
    return (F.length(text) > 0) & (marks >= 3) & (hangul >= 0.4) & (other <= 0.3)


def indicator_rich(text: Column, least: int = 2) -> Column:
    return sum((F.contains(F.lower(text), F.lit(i)).cast("int") for i in L.INDICATORS), F.lit(0)) >= least
