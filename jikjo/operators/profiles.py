"""Profiles of sources and corpora: one aggregate each, exact percentiles where the profile asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jikjo.functions import lexicon as L
from jikjo.functions.tagger import tokens


def with_repeats(df: DataFrame, text: str) -> DataFrame:
    """Adds length, repeated_names and pronouns (exact words of the counted list)."""
    t = df.withColumn("__t", tokens(F.col(text)))
    names = t.withColumn("__n", F.array_sort(F.transform(F.filter("__t", lambda x: (x["tag"] == "NNP") & (F.length(x["form"]) >= 2)), lambda x: x["form"])))
    again = F.filter(F.zip_with("__n", F.concat(F.slice("__n", 2, F.greatest(F.size("__n"), F.lit(1))), F.array(F.lit(None).cast("string"))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    return names.select(
        *df.columns,
        F.length(text).alias("length"),
        F.array_distinct(again).alias("repeated_names"),
        F.size(F.filter("__t", lambda x: x["tag"].isin("NP", "NNP") & x["form"].isin(L.PRONOUNS_COUNTED))).cast("long").alias("pronouns"),
    )


def source_profile(rows: DataFrame, by: list[str]) -> DataFrame:
    """Lengths, share of texts with a repeated name, mean pronouns, stars (half-even mean of three scores in 1 to 5), advised rows."""
    repeat = F.avg((F.size("repeated_names") > 0).cast("double")) * 100
    p = rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.avg("length").alias("avg_length"), F.percentile("length", F.lit(0.5)).alias("median_length"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"), repeat.alias("repeat_ratio"), F.avg("pronouns").alias("avg_pronouns"),
    )
    score = lambda x: F.least(F.lit(5.0), F.greatest(F.lit(1.0), x))
    stars = F.bround((score(F.col("avg_length") / 100) + score(F.col("repeat_ratio") / 10) + score(F.col("avg_pronouns") * 2)) / 3, 0).cast("int")
    p = p.withColumn("stars", stars)
    most = F.when(F.col("stars") >= 4, 50000).when(F.col("stars") >= 3, 20000).when(F.col("stars") >= 2, 10000).otherwise(5000)
    return p.withColumn("recommended", F.least("total", most.cast("long")))


def tier(stars: Column) -> Column:
    return F.when(stars >= 4, "high").when(stars >= 3, "middle").otherwise("low")
