"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table, never by localCheckpoint: a lost executor
then costs a re-read and not the query.  The folder is the session's
``spark.checkpoint.dir``.  Where that is unset, a session on one machine gets a folder
of its own; on a cluster it is an error, as executors share no local folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="jikjo-")
        _own.append(where[len("file://") :])
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy", **options: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder, and read back.  ``options``: the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    _stored.append(path)
    df.write.options(**options).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the stored tables of this process, once no frame made from them is needed any more; their number."""
    n = len(_stored)
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@atexit.register
def _clean() -> None:
    """At the end of the process: its stored tables, wherever they are, as long as the session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            pass
    for d in _own + [p.removeprefix("file://") for p in _stored if p.startswith("file:")]:
        shutil.rmtree(d, ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each session."""
    if spark.conf.get("jikjo.shipped", None):
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="jikjo-ship-"))
    _own.append(str(base))
    shutil.copytree(root, base / "in" / root.name, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    shutil.make_archive(str(base / root.name), "zip", base / "in", root.name)
    spark.sparkContext.addPyFile(str(base / f"{root.name}.zip"))
    spark.conf.set("jikjo.shipped", "true")
