"""Metrics of ranked predictions, votes, and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hit_at(candidates: Column, gold: Column, k: int) -> Column:
    """Among the first k one equals the gold word, holds it or is held by it; no candidates are a miss."""
    return F.coalesce(F.exists(F.slice(candidates, 1, k), lambda c: (c == gold) | F.contains(c, gold) | F.contains(gold, c)), F.lit(False))


def accuracy(items: DataFrame, predictions: DataFrame, key: str, gold: str, ks: list[int]) -> DataFrame:
    """model, n, hit share at each k over all items: an item without predictions counts as a miss."""
    n = items.count()
    joined = predictions.join(items.select(key, gold), key)
    shares = [F.round(F.count_if(hit_at(F.col("candidates"), F.col(gold), k)) / F.lit(float(max(1, n))), 6).alias(f"at_{k}") for k in ks]
    return joined.groupBy("model").agg(F.lit(n).cast("long").alias("n"), *shares)


def set_f1(rows: DataFrame, predicted: str, gold: str, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of sets, and the share of rows with any hit."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    c = rows.groupBy(*by).agg(
        F.sum(both).alias("tp"), F.sum(F.size(p) - both).alias("fp"), F.sum(F.size(g) - both).alias("fn"), F.avg((both > 0).cast("double")).alias("any_hit")
    )
    one = c.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))
    return one.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def composite(real1: Column, real5: Column, lambada: Column) -> Column:
    return real1 * 0.4 + real5 * 0.3 + lambada * 0.3


def votes(predictions: DataFrame, key: str, k: int) -> DataFrame:
    """Of each item the k tokens with the best mean score over models, then the most votes: exploded predictions in."""
    from jikjo.operators.ordering import heads

    v = predictions.groupBy(key, "token").agg(F.avg("score").alias("mean_score"), F.count("*").alias("hits"), F.countDistinct("model").alias("models"))
    return heads(v, [key], [F.desc("mean_score"), F.desc("hits"), F.col("token")], k)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key they don't replace."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def best_of(results: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """For each metric the row that is best in it; ties go to the smaller key.  One aggregate."""
    picks = [F.max_by(F.struct(F.lit(m).alias("metric"), F.col(key), F.col(m).alias("value")), F.struct(F.col(m), -F.col(key))).alias(m) for m in metrics]
    one = results.agg(*picks)
    return one.select(F.explode(F.array(*[F.col(m) for m in metrics])).alias("b")).where("b is not null").select("b.*")


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values, numbered in their order: parameter lists, exploded from literals."""
    rows = spark.range(1).select(F.lit(0).alias("job_id"))
    for name, values in axes.items():
        step = F.posexplode(F.array(*[F.lit(v) if isinstance(v, str) else F.lit(v).cast("long") for v in values])).alias("__i", name)
        rows = rows.select("*", step).withColumn("job_id", F.col("job_id") * len(values) + F.col("__i")).drop("__i")
    return rows.withColumn("job_id", F.col("job_id") + 1)
