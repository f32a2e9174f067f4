"""Readers: every source format, with explicit schemas and a stated policy for what can't be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_table(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """A Parquet table; ValueError if a required column is missing."""
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return df


def shards(spark: SparkSession, pattern: str) -> DataFrame:
    """All shard files that match a glob, with the file and place as an order key."""
    return spark.read.parquet(pattern).select("*", F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of newline-delimited JSON; blank lines are in neither."""
    text = spark.read.text(path).where(F.trim("value") != "")
    read = text.select("value", F.from_json("value", f"{schema}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return read.where("j._corrupt_record is null").select("j.*").drop("_corrupt_record"), read.where("j._corrupt_record is not null").select("value")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document in each file (a configuration, a state), with its file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("j"))
    return whole.select("file", "j.*")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier results, whether the file holds a list of rows or an object with a list under "results"."""
    whole = spark.read.text(path, wholetext=True)
    row = f"array<struct<{schema}>>"
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.results"), row), F.from_json("value", row))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def log_fields(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    """Numbers captured from the lines of a log: one column for each pattern, lines without any passed over."""
    lines = spark.read.text(path)
    cols = [F.regexp_extract("value", p, 1).try_cast("double").alias(n) for n, p in patterns.items()]
    return lines.select(*cols).where(F.coalesce(*patterns).isNotNull())


def folders(spark: SparkSession, base: str, name: str = "checkpoint-(\\d+)", marker: str = "config.json") -> DataFrame:
    """Folders below ``base`` that hold the marker file, with their number, in numeric order; file contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(base).select("path")
    number = F.regexp_extract("path", name + "/" + marker.replace(".", "\\."), 1).try_cast("long")
    return files.select(F.regexp_replace("path", "/" + marker.replace(".", "\\.") + "$", "").alias("folder"), number.alias("number")).where("number is not null").orderBy("number")


def resolved(spark: SparkSession, base: str, length: int, name: str = "", marker: str = "dataset_info.json") -> str | None:
    """The data set below ``base``: the file itself; else the folder's ``name``_``length``_coref_optimized.arrow, the
    folder if it holds the marker, or its first child (by name) that does and has the length in its name; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    below = lambda p, n: spark._jvm.org.apache.hadoop.fs.Path(p, n)
    if not system.exists(at):
        return None
    if not system.getFileStatus(at).isDirectory():
        return base
    exact = below(at, f"{name.replace('/', '_')}_{length}_coref_optimized.arrow")
    if name and system.exists(exact):
        return exact.toString()
    if system.exists(below(at, marker)):
        return base
    children = sorted((s.getPath() for s in system.listStatus(at) if s.isDirectory()), key=lambda p: p.getName())
    return next((p.toString() for p in children if str(length) in p.getName() and system.exists(below(p, marker))), None)


def available(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union by name of the sources that can be read, why the others can't): a source that fails is left out, not the load."""
    out, failed = None, {}
    for name, read in parts.items():
        try:
            df = read()
        except (AnalysisException, PySparkException, ValueError) as e:
            failed[name] = str(e).splitlines()[0]
            continue
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED").csv(path)


def arrow_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Arrow IPC files or streams that match a glob, each read by one task, a record batch at a time."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(pattern).select("path")
    names = spark.createDataFrame([], schema).columns

    def read(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if not path.startswith("file:///") else path)
                with system.open_input_file(at) as f:
                    try:
                        got = pa.ipc.open_file(f)
                        parts = (got.get_batch(i) for i in range(got.num_record_batches))
                    except pa.ArrowInvalid:
                        f.seek(0)
                        parts = iter(pa.ipc.open_stream(f))
                    for part in parts:
                        yield part.select(names)

    return files.repartition("path").mapInArrow(read, schema)
