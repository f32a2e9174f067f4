"""Writers: data sets with their statistics beside them, results as JSON and CSV, appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jikjo.functions.text import fixed


def dataset(df: DataFrame, path: str, parts_by: list[str] = (), size: str = "attention_mask", statistics: list[str] = ()) -> DataFrame:
    """Write Parquet, read it back, and put its statistics (rows, mean length, mean of the columns named) in ``path``-quality as JSON."""
    writer = df.write.partitionBy(*parts_by) if parts_by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.parquet(path)
    length = [F.avg(F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x)).alias("avg_length")] if size in back.columns else []
    back.agg(F.count("*").alias("rows"), *length, *[F.avg(c).alias(f"avg_{c}") for c in statistics]).coalesce(1).write.json(f"{path}-quality")
    return back


def ranges(df: DataFrame, path: str, order: str, parts: int) -> None:
    """Contiguous shards in the order of a column."""
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)


def results_json(df: DataFrame, path: str, best: DataFrame) -> None:
    """All results and the best rows as one JSON document: for tables of results, a row for each checkpoint."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("results"))
    tops = best.agg(F.collect_list(F.struct(*best.columns)).alias("best"))
    rows.join(F.broadcast(tops)).select(F.to_json(F.struct("best", "results")).alias("value")).coalesce(1).write.text(path)


def summary(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rows by group as one JSON file: what a build has made."""
    rows.groupBy(*by).agg(F.count("*").alias("rows")).orderBy(*by).coalesce(1).write.json(path)


def sweep(jobs: DataFrame, path: str, failed: str = "rc <> 0") -> None:
    """The jobs of a sweep as JSON lines in the order of their number, and beside them (``path``-summary) how many ran and failed, and their seconds."""
    jobs.orderBy("job_id").coalesce(1).write.json(path)
    jobs.agg(F.count("*").alias("jobs"), F.count_if(F.expr(failed)).alias("failed"), F.sum("seconds").alias("seconds")).coalesce(1).write.json(f"{path}-summary")


def results_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header; doubles with so many digits."""
    shown = [fixed(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).coalesce(1).write.option("header", "true").csv(path)


def append_lines(df: DataFrame, path: str) -> None:
    """JSON lines appended as new files; a reader never meets half a line."""
    df.write.mode("append").json(path)
