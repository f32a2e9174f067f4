"""Samples and splits.  Chance comes from md5 of a seed and the key: the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jikjo.operators.ordering import numbered


def chance_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def uniform(key: str, seed: int) -> Column:
    """In (0, 1], from 32 bits."""
    return (F.conv(F.substring(chance_key(key, seed), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967296.0)


def shuffled_head(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first n of a seeded shuffle; with n of any size a top-n, never a full sort for a small n."""
    return df.orderBy(chance_key(key, seed), key).limit(n)


def strided(df: DataFrame, key: str, k: int, capped: bool = False) -> DataFrame:
    """Every s-th row, s = max(1, rows div k); may give nearly 2 k rows unless capped."""
    n = df.count()
    step = max(1, n // max(1, k))
    out = numbered(df, [key], "__row").where((F.col("__row") - 1) % step == 0)
    return (out.where((F.col("__row") - 1) / step < k) if capped else out).drop("__row")


def evenly_spaced(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows 0 .. n - 1 at k even steps, both ends included."""
    n = df.count()
    picks = sorted({int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(min(k, n))}) if n else []
    at = df.sparkSession.createDataFrame([(p + 1,) for p in picks], "__row long")
    return numbered(df, [key], "__row").join(F.broadcast(at), "__row", "left_semi").drop("__row")


def weighted(df: DataFrame, key: str, weight: Column, k: int, seed: int) -> DataFrame:
    """k rows without replacement, chances by weight (exponential keys); rows of no weight never."""
    e = -F.log(uniform(key, seed)) / weight
    return df.where(weight > 0).withColumn("__e", e).orderBy("__e", key).limit(k).drop("__e")


def with_replacement(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k draws, each row as likely in each: draw number and row."""
    n = df.count()
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw"))
    pick = F.floor((uniform("draw", seed) * n)).cast("long")
    return draws.withColumn("__row", F.least(pick + 1, F.lit(n))).join(numbered(df, [key], "__row"), "__row").drop("__row")


def split(key: str, seed: int, tenths: int) -> Column:
    """'eval' for about tenths / 10 of the keys, else 'train'."""
    bucket = F.conv(F.substring(chance_key(key, seed), 1, 8), 16, 10).cast("long") % 10
    return F.when(bucket < tenths, "eval").otherwise("train")
