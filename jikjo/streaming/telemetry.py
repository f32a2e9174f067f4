"""Telemetry as a stream: a tail over files of JSON lines, and stateful last values.

The schema is the union of all sections' fields; a line that isn't JSON, or is blank,
is passed over.  A file is read once, when it is complete: producers drop whole files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jikjo.storage import shared_dir

#: The fields of the bus.
SCHEMA = (
    "ts DOUBLE, section STRING, event STRING, model STRING, trial STRING, step INT, total_steps INT, loss DOUBLE, lr DOUBLE, step_time DOUBLE, top1 DOUBLE, top5 DOUBLE, "
    "samples_per_s DOUBLE, tokens_per_s DOUBLE, hp MAP<STRING,STRING>, dataset_meta MAP<STRING,STRING>, score DOUBLE, seq_len INT, stage STRING, completed INT, total INT, "
    "progress DOUBLE, study_trials_total INT, total_jobs INT, rc INT, util DOUBLE, temp DOUBLE, mem_used DOUBLE, mem_total DOUBLE, power DOUBLE, _corrupt_record STRING"
)
SECTIONS = ("progress", "throughput", "system", "eval_stream", "dataset_progress")
EVENTS = ("trial_begin", "trial_end", "sweep_begin", "sweep_job_begin", "sweep_job_end")


def bus_folder(spark: SparkSession, option: str = "jikjo.bus") -> str:
    """The folder of the bus: the session's setting, blank counting as none, else ``bus`` in the shared folder; made if it isn't there."""
    where = (spark.conf.get(option, "") or "").strip() or f"{shared_dir(spark)}/bus"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return where


def tail(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """New lines of the folder's files, as they arrive."""
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return lines.where("_corrupt_record is null")


def route() -> Column:
    """The handler of an event: its section if that is known, else its event kind."""
    return F.when(F.col("section").isin(*SECTIONS), F.col("section")).when(F.col("event").isin(*EVENTS), F.col("event")).otherwise("other")


def append(spark: SparkSession, folder: str, rows: list[dict], now: float) -> None:
    """One file of JSON lines for a batch; ``ts`` is added where it is missing."""
    df = spark.createDataFrame([{"j": json.dumps({"ts": now} | r)} for r in rows], "j string")
    df.coalesce(1).write.mode("append").text(folder)


STATE = "count long, value double, at long, ema double"
OUT = "key string, n_events long, last_value double, last_at timestamp, ema double"


def fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState, beta: float = 0.9) -> Iterator[pd.DataFrame]:
    """Count, last value by time, and moving average of one key's events, a batch at a time in time order."""
    count, value, at, ema = state.get if state.exists else (0, None, None, None)
    for f in frames:
        f = f.sort_values(["ts", "event_id"], kind="stable")
        for t, v in zip(f["ts"].astype("datetime64[us]").astype("int64"), f["value"]):
            count += 1
            if pd.notna(v):
                ema = v if ema is None or pd.isna(ema) else beta * ema + (1 - beta) * v
                if at is None or pd.isna(at) or t >= at:
                    value, at = v, t
    state.update((count, None if value is None else float(value), None if at is None else int(at), None if ema is None else float(ema)))
    yield pd.DataFrame({"key": [str(key[0])], "n_events": [count], "last_value": [value], "last_at": [pd.NaT if at is None else pd.Timestamp(at, unit="us")], "ema": [ema]})


def last_values(events: DataFrame, key: str) -> DataFrame:
    """The running state of each key, one row for each micro-batch that touched it."""
    return events.select(F.col(key).cast("string").alias("key"), "event_id", "ts", "value").where("key is not null").groupBy("key").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def drained(states: DataFrame, name: str) -> DataFrame:
    """Run a stateful stream over all that is there; the newest state of each key, from a stored table."""
    spark = states.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")
    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    newest = F.max_by(F.struct(*[c for c in out.columns if c not in ("key", "batch")]), F.col("batch"))
    return out.groupBy("key").agg(newest.alias("s")).select("key", "s.*")


def windowed(events: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by window and kind; state older than the watermark is let go."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- the board of a run ------------------------------------------------------------

#: Fields of which the last known value is kept, by section.
KEPT = {
    "progress": ("model", "trial", "step", "total_steps", "loss", "lr", "top1", "top5", "samples_per_s", "tokens_per_s"),
    "throughput": ("samples_per_s", "tokens_per_s"),
    "system": ("util", "temp", "mem_used", "mem_total", "power"),
    "eval_stream": ("score",),
    "dataset_progress": ("stage", "completed", "total", "progress"),
}
BETA = 0.9


class Board:
    """The state of one run, as plain values: what its events said last, and its trials and jobs.

    A section goes before an event kind.  A missing value (null) keeps the one before.
    ``hp`` and ``dataset_meta`` are kept whole; the sequence length is the first of
    ``max_length`` and ``seq_len`` that is a whole number.  A trial or job lasts from its
    latest begin to the next end, never less than nothing; a sweep that begins sets
    the counts of trials and jobs back, but not what has begun and not ended.
    """

    SPANS = {"trial": "trial", "sweep_job": "job"}

    def __init__(self, kept: dict | None = None) -> None:
        self.v: dict = kept or {"events": 0, "last": {}, "open": {}, "counts": self._fresh()}

    @staticmethod
    def _fresh() -> dict:
        return {f"{n}_{c}": 0 for n in ("trial", "job") for c in ("begun", "finished", "timed", "seconds")}

    def take(self, e: dict) -> None:
        self.v["events"] += 1
        section, event = e.get("section"), e.get("event")
        if section in KEPT:
            last = self.v["last"]
            last.update({f: e[f] for f in KEPT[section] if e.get(f) is not None})
            if section in ("progress", "throughput"):
                self._timed(e)
            if section == "progress":
                self._described(e)
            return
        name, _, what = (event or "").rpartition("_")
        if event == "sweep_begin":
            self.v["counts"] = self._fresh()
            self._total("job_total", e.get("total_jobs"))
        elif name in self.SPANS and what == "begin":
            span = self.SPANS[name]
            self.v["open"][span] = e["ts"]
            self.v["counts"][f"{span}_begun"] += 1
            self._total(f"{span}_total", e.get("study_trials_total") if span == "trial" else None)
        elif name in self.SPANS and what == "end":
            span, c = self.SPANS[name], self.v["counts"]
            began = self.v["open"].pop(span, None)
            c[f"{span}_finished"] += 1
            if began is not None:
                c[f"{span}_timed"] += 1
                c[f"{span}_seconds"] += max(0.0, e["ts"] - began)

    def _total(self, name: str, n) -> None:
        if n is not None:
            self.v["counts"][name] = int(n)

    def _timed(self, e: dict) -> None:
        last, t = self.v["last"], e.get("step_time")
        if t is not None:
            last["step_time"] = t
            last["ema"] = t if "ema" not in last else BETA * last["ema"] + (1 - BETA) * t
        if last.get("total_steps") and last.get("ema"):
            last["eta"] = last["ema"] * max(0, int(last["total_steps"]) - int(last.get("step", 0)))

    def _described(self, e: dict) -> None:
        last = self.v["last"]
        for f in ("hp", "dataset_meta"):
            if e.get(f):
                last[f] = dict(e[f])
        for f in ("max_length", "seq_len"):
            if str((e.get("hp") or {}).get(f, "")).isdigit():
                last["seq_len"] = int(e["hp"][f])
                break


BOARD = (
    "key string, n_events long, model string, trial string, step int, total_steps int, loss double, lr double, samples_per_s double, tokens_per_s double, seq_len int, hp map<string,string>, "
    "ema double, eta double, trials_begun long, trials_finished long, trial_seconds double, trials_total int, jobs_begun long, jobs_finished long, job_seconds double, jobs_total int"
)


def _row(key: str, b: Board) -> dict:
    last, c = b.v["last"], b.v["counts"]
    out = {"key": key, "n_events": b.v["events"]}
    out |= {f: last.get(f) for f in ("model", "trial", "step", "total_steps", "loss", "lr", "samples_per_s", "tokens_per_s", "seq_len", "hp", "ema", "eta")}
    for n in ("trial", "job"):
        out |= {f"{n}s_begun": c[f"{n}_begun"], f"{n}s_finished": c[f"{n}_finished"], f"{n}_seconds": float(c[f"{n}_seconds"]), f"{n}s_total": c.get(f"{n}_total")}
    return out


def board_fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A micro-batch's events of one run into its board, by time and then by number."""
    board = Board(json.loads(state.get[0])) if state.exists else Board()
    for f in frames:
        for e in f.sort_values(["ts", "number"], kind="stable").to_dict("records"):
            board.take({k: v for k, v in e.items() if isinstance(v, (dict, list)) or not pd.isna(v)})
    state.update((json.dumps(board.v, default=str),))
    names = [c.split()[0] for c in BOARD.split(", ")]
    yield pd.DataFrame([_row(str(key[0]), board)], columns=names)


def boards(bus: DataFrame, key: str, number: str = "ts") -> DataFrame:
    """The board of every run of a bus stream, one row for each micro-batch that touched it.

    ``bus``: any of the columns of SCHEMA, ``ts`` in seconds; ``number`` orders events of one time.
    """
    known = [c for c in bus.columns if c in {f.split()[0] for f in SCHEMA.split(", ")}]
    rows = bus.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("run"), F.col(number).cast("double").alias("number"), *known)
    return rows.groupBy("run").applyInPandasWithState(board_fold, BOARD, "board string", "update", GroupStateTimeout.NoTimeout)


def shown(states: DataFrame, every: str = "1 second", sink: str = "console"):
    """A started query that shows the newest rows, no more often than ``every`` (a sink that is refreshed, not a record)."""
    write = states.writeStream.outputMode("update").trigger(processingTime=every)
    return (write.format("console").option("truncate", False) if sink == "console" else write.format("memory").queryName(sink)).start()
