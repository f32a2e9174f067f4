"""Batch twins of the telemetry stream: last values, pairs, averages, rates, over an ordered event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jikjo.operators.ordering import heads
from jikjo.storage import stored


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def last_values(events: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last value of each column that isn't null, by the order: partial aggregates, no sort of a group."""
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    return events.groupBy(*by).agg(*picks, F.count("*").alias("n_events"))


def paired(events: DataFrame, by: str, order: list[str], kind: Column, begin: str, end: str, ts: str) -> DataFrame:
    """Each begin with the end that follows it before another begin; the time between, never negative, in seconds."""
    w = Window.partitionBy(by).orderBy(*order)
    only = events.where(kind.isin(begin, end)).withColumn("__kind", kind)
    nxt = only.withColumn("__next", F.lead("__kind").over(w)).withColumn("ended", F.lead(ts).over(w))
    out = nxt.where((F.col("__kind") == begin)).select(by, F.col(ts).alias("began"), F.when(F.col("__next") == end, F.col("ended")).alias("ended"))
    seconds = _micros(F.col("ended")) - _micros(F.col("began"))
    return out.withColumn("seconds", F.greatest(F.lit(0.0), seconds / 1e6))


def ema(events: DataFrame, by: str, order: list[str], value: str, beta: float = 0.9) -> DataFrame:
    """Exponential moving average at the end of each group, seeded with its first value.

    Written as a weighted sum, so that it is an aggregate and no fold over a gathered
    group: (1 - beta) beta^(N - i) x_i, and beta^(N - 1) for the first.
    """
    w = Window.partitionBy(by)
    rows = events.where(F.col(value).isNotNull()).select(by, value, F.row_number().over(w.orderBy(*order)).alias("i"), F.count("*").over(w).alias("n"))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(beta), F.col("n") - 1)).otherwise((1 - beta) * F.pow(F.lit(beta), F.col("n") - F.col("i")))
    return rows.groupBy(by).agg(F.sum(F.col(value) * weight).alias("ema"), F.max("n").alias("n"))


def trailing_mean(events: DataFrame, by: str, order: list[str], value: str, size: int = 50) -> Column:
    return F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - size, Window.currentRow))


def rate(events: DataFrame, by: str, order: list[str], ts: str, per: int) -> DataFrame:
    """Events a second from the time since the event ``per`` rows before.

    A kind may hold most rows, so no window spans a kind: rows are partitioned by
    ranges of (kind, order), and each partition gets the last ``per`` rows of its kind
    before it, which stand among the last ``per`` of the partitions before.
    """
    spread = stored(events.repartitionByRange(by, *order).withColumn("__p", F.spark_partition_id()), "rated")
    cols = list(dict.fromkeys([by, *order, ts]))
    tails = heads(spread.select(*cols, "__p"), [by, "__p"], [F.col(c).desc() for c in order], per)
    tails = tails.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))  # per rows of each partition
    begins = tails.groupBy(by, "__p").agg(F.min("__r").alias("__m"))
    carried = begins.select(by, "__p", F.explode(F.sequence(F.col("__m") - per, F.col("__m") - 1)).alias("__r")).join(tails.drop("__p"), [by, "__r"])
    rows = spread.withColumn("__own", F.lit(True)).unionByName(carried.drop("__r").withColumn("__own", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(by, "__p").orderBy(*order)
    span = (_micros(F.col(ts)) - _micros(F.lag(ts, per).over(w))) / 1e6
    return rows.withColumn("per_second", F.when(span > 0, per / span)).where("__own").drop("__p", "__own")


def since_reset(events: DataFrame, by: str, order: list[str], reset: Column) -> DataFrame:
    """Events after the last reset of their group, which are all where there was none."""
    last = events.where(reset).groupBy(by).agg(F.max(F.struct(*order)).alias("__r"))
    kept = events.join(last, by, "left").where(F.col("__r").isNull() | (F.struct(*order) > F.col("__r")))
    return kept.drop("__r")
