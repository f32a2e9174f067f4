import json
import os

import pytest
from pyspark.sql import functions as F

from jikjo.sources import catalog, readers, sinks
from jikjo.streaming import telemetry


def test_json_lines_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n   \nnot json\n{"a": 2, "b": "x"}\n')
    rows, bad = readers.json_lines(spark, str(tmp_path), "a long, b string")
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, None), (2, "x")] and [r.value for r in bad.collect()] == ["not json"]


def test_checkpoint_folders_in_numeric_order(spark, tmp_path):
    for n in (9, 100, 20):
        (tmp_path / f"run/checkpoint-{n}").mkdir(parents=True)
        (tmp_path / f"run/checkpoint-{n}/config.json").write_text(json.dumps({"max_position_embeddings": n}))
    (tmp_path / "run/checkpoint-7").mkdir()
    assert [r.number for r in readers.folders(spark, str(tmp_path)).collect()] == [9, 20, 100]
    got = readers.json_document(spark, f"{tmp_path}/run/*/config.json", "max_position_embeddings int")
    assert sorted(r.max_position_embeddings for r in got.collect()) == [9, 20, 100]


def test_results_in_either_layout(spark, tmp_path):
    rows = [{"name": "a", "score": 1.5}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "object.json").write_text(json.dumps({"summary": 1, "results": rows}))
    for f in ("list", "object"):
        assert [tuple(r) for r in readers.results(spark, f"{tmp_path}/{f}.json", "name string, score double").collect()] == [("a", 1.5)]


def test_log_fields(spark, tmp_path):
    (tmp_path / "log").write_text("start\nloss=0.5 at step 3\nnothing\nacc: 0.25\n")
    got = readers.log_fields(spark, str(tmp_path / "log"), loss=r"loss=([\d.]+)", acc=r"acc: ([\d.]+)").collect()
    assert [tuple(r) for r in got] == [(0.5, None), (None, 0.25)]


def test_dataset_round_trip_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 1, 0], 0.5), (2, [1, 0, 0], 1.5)], "id long, attention_mask array<long>, density double")
    back = sinks.dataset(df, str(tmp_path / "out"), statistics=["density"])
    assert back.count() == 2
    q = spark.read.json(str(tmp_path / "out-quality")).first()
    assert (q.rows, q.avg_length, q.avg_density) == (2, 1.5, 1.0)
    with pytest.raises(ValueError):
        readers.stored_table(spark, str(tmp_path / "out"), ["input_ids"])
    sinks.ranges(df, str(tmp_path / "shards"), "id", 2)
    assert readers.shards(spark, str(tmp_path / "shards")).select("shard").distinct().count() == 2


def test_results_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456), ("b", 1234.5)], "name string, score double")
    sinks.results_csv(df, str(tmp_path / "csv"))
    assert [r.score for r in readers.csv(spark, str(tmp_path / "csv"), "name string, score string").orderBy("name").collect()] == ["0.1235", "1234.5000"]
    sinks.results_json(df, str(tmp_path / "json"), df.limit(1))
    got = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert len(got["results"]) == 2 and len(got["best"]) == 1


def test_projection_of_missing_parts(spark):
    qa = spark.createDataFrame([("본문", None, None), (None, "물음", (None,)), (None, None, ([],)), ("a", "b", (["c", "d"],))], "context string, question string, answers struct<text: array<string>>")
    assert [r.x for r in qa.select(catalog.qa_text().alias("x")).collect()] == ["본문", "물음", "", "a b c"]
    news = spark.createDataFrame([("글", None), (None, [" 하나 ", "", None, "둘"]), (None, None)], "document string, document_list array<string>")
    assert [r.x for r in news.select(catalog.news_text().alias("x")).collect()] == ["글", "하나 둘", None]


def test_first_delivery_and_split_fallback(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None)], "k long, at long, v string")
    assert sorted(map(tuple, catalog.first_delivery(df, "k", ["at"]).collect())) == [(1, 1, "a"), (2, 5, None)]
    s = spark.createDataFrame([(1, "test"), (2, "dev"), (3, "train")], "k long, split string")
    assert [r.k for r in catalog.first_split(s, ["validation", "dev", "test"]).collect()] == [2]
    assert catalog.first_split(s, ["validation"]).count() == 0


def test_tail_routes_and_skips_bad_lines(spark, tmp_path):
    folder = str(tmp_path / "bus")
    telemetry.append(spark, folder, [{"section": "progress", "step": 1}, {"event": "trial_begin", "trial": "3"}], now=5.0)
    telemetry.append(spark, folder, [{"event": "unknown", "ts": 7.0}], now=6.0)
    (tmp_path / "bus" / "x.txt").write_text("half a li")
    q = telemetry.tail(spark, folder).select("ts", telemetry.route().alias("to")).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.ts, r.to) for r in spark.table("tail").collect()) == [(5.0, "progress"), (5.0, "trial_begin"), (7.0, "other")]


def test_stream_state_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(5).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = {r.key: (r.n_events, r.last_value) for r in telemetry.drained(telemetry.last_values(files, "user_id"), "t").collect()}
    from jikjo.operators import telemetry as batch

    want = {str(r.user_id): (r.n_events, r.value) for r in batch.last_values(e.where("user_id is not null"), ["user_id"], ["ts", "event_id"], ["value"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_boards_of_a_bus(spark, tmp_path):
    """Lines over three files: bad ones passed over, fields kept, pairs, resets, sequence length."""
    bus = [
        {"ts": 1.0, "event": "sweep_begin", "total_jobs": 4},
        {"ts": 2.0, "event": "trial_begin", "study_trials_total": 9},
        {"ts": 3.0, "section": "progress", "event": "trial_end", "model": "m", "step": 10, "total_steps": 110, "step_time": 2.0, "loss": 0.5, "hp": {"seq_len": "256", "x": "y"}},
        {"ts": 4.0, "section": "throughput", "step_time": 1.0, "tokens_per_s": 7.0},
        {"ts": 5.5, "event": "trial_end"},
        {"ts": 6.0, "event": "trial_end"},
        {"ts": 7.0, "event": "sweep_job_begin"},
        {"ts": 6.5, "event": "unknown"},
        {"ts": 8.0, "event": "trial_begin"},
        {"ts": 9.0, "section": "progress", "step": 20, "hp": {"max_length": "512", "seq_len": "1"}},
    ]
    for k, part in enumerate((bus[:4], bus[4:7], bus[7:])):
        (tmp_path / f"in{k}.json").write_text("\n".join(json.dumps(x | {"stage": "r"}) for x in part) + "\nnot json\n\n")
        os.utime(tmp_path / f"in{k}.json", (1000 + k, 1000 + k))  # files are taken in this order
    lines = telemetry.tail(spark, str(tmp_path), files_a_batch=1).withColumn("run", F.col("stage"))
    (b,) = telemetry.drained(telemetry.boards(lines, "run"), "b").collect()
    assert (b.n_events, b.model, b.step, b.total_steps, b.loss, b.tokens_per_s, b.seq_len, b.hp) == (10, "m", 20, 110, 0.5, 7.0, 512, {"max_length": "512", "seq_len": "1"})
    assert abs(b.ema - 1.9) < 1e-9 and abs(b.eta - 1.9 * 90) < 1e-9
    assert (b.trials_begun, b.trials_finished, b.trial_seconds, b.trials_total) == (2, 2, 3.5, 9)
    assert (b.jobs_begun, b.jobs_finished, b.jobs_total) == (1, 0, 4)
    reset = telemetry.Board()
    for e in (*bus, {"ts": 10.0, "event": "sweep_begin"}, {"ts": 11.0, "event": "trial_end"}):
        reset.take(e)
    c = reset.v["counts"]
    assert (c["trial_begun"], c["trial_finished"], c["trial_seconds"]) == (0, 1, 3.0) and "job_total" not in c


def test_shown_in_a_memory_sink(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ts": 1.0, "event": "trial_begin", "stage": "r"}\n')
    q = telemetry.shown(telemetry.boards(telemetry.tail(spark, str(tmp_path)), "stage"), "0 seconds", "board_now")
    q.processAllAvailable()
    q.stop()
    assert [r.trials_begun for r in spark.table("board_now").collect()] == [1]


def test_windowed_stream(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = telemetry.windowed(files).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == e.count()


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2, 3], "text": ["x", None, "끝"], "more": [0, 0, 0]})
    with pa.OSFile(str(tmp_path / "one.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    with pa.OSFile(str(tmp_path / "two.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    got = readers.arrow_files(spark, f"{tmp_path}/*.arrow", "a long, text string").collect()
    assert sorted((r.a, r.text or "") for r in got) == sorted([(1, "x"), (2, ""), (3, "끝")] * 2)


def test_stored_tables_are_released(spark):
    from pathlib import Path

    from jikjo import storage

    df = storage.stored(spark.range(5).toDF("a"), "t")
    assert df.count() == 5 and storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = storage._stored[-1].removeprefix("file://")
    assert Path(path).exists()
    assert storage.release(spark) > 0 and not Path(path).exists()


def test_resolved_paths(spark, tmp_path):
    at = str(tmp_path / "base")
    assert readers.resolved(spark, at, 1024) is None
    (tmp_path / "base/run_1024").mkdir(parents=True)
    assert readers.resolved(spark, at, 1024) is None
    (tmp_path / "base/run_1024/dataset_info.json").write_text("{}")
    assert readers.resolved(spark, at, 1024).endswith("/run_1024") and readers.resolved(spark, at, 2048) is None
    (tmp_path / "base/dataset_info.json").write_text("{}")
    assert readers.resolved(spark, at, 2048) == at
    (tmp_path / "base/a_b_2048_coref_optimized.arrow").mkdir()
    assert readers.resolved(spark, at, 2048, "a/b").endswith("a_b_2048_coref_optimized.arrow")
    assert readers.resolved(spark, f"{at}/dataset_info.json", 1) == f"{at}/dataset_info.json"


def test_sources_that_fail_are_left_out(spark, data, tmp_path):
    good = lambda: spark.read.parquet(f"{data}/lambada.parquet").select("item_id")
    lacking = lambda: readers.stored_table(spark, f"{data}/lambada.parquet", ["nothing"])
    df, failed = readers.available(spark, {"a": good, "gone": lambda: spark.read.parquet(str(tmp_path / "gone")), "lacking": lacking, "b": good})
    assert {r.source: r["count"] for r in df.groupBy("source").count().collect()} == {"a": 300, "b": 300} and set(failed) == {"gone", "lacking"}
    assert readers.available(spark, {"gone": lambda: spark.read.parquet(str(tmp_path / "gone"))})[0] is None


def test_summaries(spark, tmp_path):
    sinks.summary(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "source string, target int"), str(tmp_path / "s"), ["source", "target"])
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "s")).select("source", "target", "rows").orderBy("source").collect()] == [("a", 1, 2), ("b", 2, 1)]
    sinks.sweep(spark.createDataFrame([(2, 1, 3.0), (1, 0, 2.0)], "job_id int, rc int, seconds double"), str(tmp_path / "w"))
    assert tuple(spark.read.json(str(tmp_path / "w-summary")).select("jobs", "failed", "seconds").first()) == (2, 1, 5.0)


def test_bus_folder(spark, tmp_path):
    from pathlib import Path

    spark.conf.set("jikjo.bus", "  ")
    assert telemetry.bus_folder(spark).endswith("/bus")
    spark.conf.set("jikjo.bus", f"file://{tmp_path}/x/bus")
    assert telemetry.bus_folder(spark) == f"file://{tmp_path}/x/bus" and Path(tmp_path, "x/bus").is_dir()
    spark.conf.unset("jikjo.bus")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from jikjo import storage

    lacking = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        storage.shared_dir(lacking)
