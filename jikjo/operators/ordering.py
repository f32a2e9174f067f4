"""Global order without a global window: row numbers and running sums over a whole table.

A window without PARTITION BY runs in one task.  Here rows are spread by ranges of
the order key, the partitions' sums (one small row each) are added up, and each
partition counts on from its own offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jikjo.storage import stored


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over this row and all rows before it in the order, which must be unique."""
    spread = stored(df.withColumn("__v", value.cast("long")).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ordered")
    parts = spread.groupBy("__p").agg(F.sum("__v").alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))  # one row for each partition
    here = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spread.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.sum("__v").over(here)).drop("__p", "__v", "__o")


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """``name``: 1, 2, 3, ... in the order."""
    return running_sum(df, order, F.lit(1), name)


def prefix_stop(df: DataFrame, order: list[str], value: Column, most: int) -> DataFrame:
    """Rows until the values before them reach ``most``: the last row may overshoot."""
    return running_sum(df.withColumn("__n", value), order, F.col("__n"), "__r").where(F.col("__r") - F.col("__n") < most).drop("__n", "__r")


def heads(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group.  Spark keeps n of each group before the shuffle, so a hot group costs n rows a task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
