from collections import Counter

from jikjo.llm import sampling as S


def frame(spark, n, repeat=3):
    rows = [(i, f"t{i}", d) for i in range(n) for d in range(1 + i % repeat)] + [(None, "none", 0)]
    return spark.createDataFrame(rows, "k long, t string, d int")


def test_exact_size_and_smallest_keys(spark):
    import hashlib

    df = frame(spark, 3000)
    got = S.sample(df, "k", 250, seed=9, earliest=["d"]).collect()
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:250]
    assert {r.k for r in got} == set(want) and len(got) == 250 and {r.d for r in got} == {0}


def test_uniform_over_seeds_whatever_the_deliveries(spark):
    df = frame(spark, 60).cache()
    seen = Counter()
    for seed in range(40):
        seen.update(r.k for r in S.sample(df, "k", 15, seed=seed).collect())
    once = sum(seen[k] for k in range(0, 60, 3)) / 20
    thrice = sum(seen[k] for k in range(2, 60, 3)) / 20
    assert abs(once - 10) < 1.8 and abs(thrice - 10) < 1.8


def test_edges(spark):
    df = frame(spark, 20)
    assert S.sample(df, "k", 0).count() == 0
    assert S.sample(df, "k", 20).count() == S.sample(df, "k", 99).count() == 20
    assert S.sample(df.limit(0), "k", 5).count() == 0


def test_pieces_appended_by_a_stream(spark, tmp_path):
    df = frame(spark, 400)
    for part in df.randomSplit([1.0, 1.0, 1.0], 1):
        part.write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "keys")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(lambda b, _: S.append_keys(b, "k", 42, path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    S.append_keys(df, "k", 42, path)  # all of it once more
    top = S.threshold(spark.read.parquet(path), 50)
    got = {r.k for r in df.where(S.random_key("k", 42) < top).select("k").distinct().collect()}
    assert got == {r.k for r in S.sample(df, "k", 50).collect()}
