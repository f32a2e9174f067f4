import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jikjo.llm import contamination as C

R = random.Random(4)
SYL = [chr(0xAC00 + R.randrange(11172)) for _ in range(600)]


def words(n):
    return " ".join("".join(R.choice(SYL) for _ in range(R.randint(2, 5))) for _ in range(n))


ITEMS = [("b", i, words(40)) for i in range(20)]


def rows():
    out, want = [], set()
    for i, (b, k, t) in enumerate(ITEMS):
        w = t.split()
        out.append((i * 10, words(60) + " " + t + ". " + words(30)))
        out.append((i * 10 + 1, words(10) + " " + " ".join(w[8:32]) + words(50)))
        edited = list(w)
        edited[7], edited[25] = "[MASK]", words(1)
        out.append((i * 10 + 2, words(20) + "<b>" + "".join(edited) + "</b>" + words(20)))
        out.append((i * 10 + 3, words(50) + " ".join(w[:8]) + words(50)))  # a short echo
        out.append((i * 10 + 4, words(80)))
        want |= {(b, k, i * 10), (b, k, i * 10 + 1), (b, k, i * 10 + 2)}
    return out, want


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "bench string, item_id int, text string")


def leaks(spark, corpus, rows=ITEMS, share=0.45):
    return C.leaks(C.build_index(corpus, "id", "body"), items(spark, rows), share)


def test_found_and_echoes_left(spark):
    data, want = rows()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in data + data[:3]], "id long, body string, terms string, row_id int")
    got = leaks(spark, df).collect()
    assert {(r.bench, r.item_id, r.row_id) for r in got} == want and len(got) == len(want)
    assert all(r.exact_phrase == (r.row_id % 10 == 0) for r in got)


def test_blocks_of_items_and_shards_change_nothing(spark, monkeypatch):
    data, want = rows()
    df = spark.createDataFrame(data, "id long, body string")
    index = C.build_index(df, "id", "body")
    for chars in (300, 2_000):
        monkeypatch.setattr(C, "BLOCK_CHARS", chars)
        assert {(r.bench, r.item_id, r.row_id) for r in C.leaks(index, items(spark), 0.45).collect()} == want
    monkeypatch.setattr(C, "SHARD_BYTES", 3_000)  # in this process; the workers' shards are cut by their own setting
    parts = list(C._post(iter(df.toArrow().to_batches())))
    assert len(parts) > 10
    block = C.Items.of(ITEMS, 0.45)
    assert {tuple(r.values())[:3] for b in C._search(block, 0.45)(iter(parts)) for r in b.to_pylist()} == want


def test_index_is_read_and_written_by_shards(spark):
    """However many shards a task has, no row and no row group is large."""
    docs = [(k, words(12_000) + (ITEMS[k][2] if k < 20 else "") + words(10)) for k in range(60)]
    index = C.build_index(spark.createDataFrame(docs, "id long, body string").coalesce(1), "id", "body")
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert len(groups) >= 4 and max(g.total_byte_size for g in groups) < 6_000_000
    assert max(len(x.as_py()) for f in files for c in f.read().columns if pa.types.is_binary(c.type) for x in c) < 512_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # tasks begin and end between shards
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches within one
    try:
        got = C.leaks(index, items(spark), 0.45).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.item_id, r.row_id) for r in got if r.exact_phrase} == {(k, k) for k in range(20)}


def test_a_parted_shard_is_an_error():
    (rows,) = C._post(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([ITEMS[0][2]])], ["row_id", "text"])]))
    block = C.Items.of(ITEMS, 0.45)
    assert [r["row_id"] for b in C._search(block, 0.45)(iter([rows.slice(0, 5), rows.slice(5)])) for r in b.to_pylist()] == [1]
    for part in (rows.slice(1), rows.slice(0, rows.num_rows - 1)):
        with pytest.raises(ValueError):
            list(C._search(block, 0.45)(iter([part])))


def test_half_of_short_items(spark):
    """A clean half of items from 12 characters on, at any place, among text made of the same words; each of its hits is also found by brute force."""
    r = random.Random(9)
    for size in (12, 13, 20, 26, 32, 40, 48, 64):
        every = [("b", i, "".join(r.choice(SYL) for _ in range(size))) for i in range(300)]
        docs, want = [], set()
        for b, i, t in every:
            lo = r.randint(0, size - size // 2)
            docs.append((i, words(30) + t[lo : lo + size // 2] + words(r.randint(5, 30))))
            want.add((b, i, i))
        index = C.build_index(spark.createDataFrame(docs, "id long, body string"), "id", "body")
        got = {(x.bench, x.item_id, x.row_id) for x in C.leaks(index, items(spark, every), 0.45).collect()}
        assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 3


def test_equals_brute_force():
    """Candidates lose no match: crowded text, where nearly every term of every item occurs again and again."""
    r = random.Random(3)
    phrases = ["".join(r.choice(SYL) for _ in range(9)) for _ in range(25)]
    every = [("b", i, "".join(r.choice(phrases) for _ in range(12))) for i in range(20)]
    docs = []
    for k in range(400):
        parts = [r.choice(phrases) for _ in range(30)]
        if k % 3 == 0:
            t = every[k % 20][2]
            lo = r.randint(0, 50)
            parts[r.randrange(30)] = t[lo : lo + r.randint(40, 60)]
        docs.append((k, "".join(parts)))
    want = set()
    for k, t in docs:
        for b, i, x in every:
            at = [(p, q) for q in range(len(t) - 5) for p in range(len(x) - 5) if t[q : q + 6] == x[p : p + 6]]
            if at and C.passage(len(x), np.array([p for p, _ in at]), np.array([q for _, q in at]))[0] >= 0.45 * len(x):
                want.add((b, i, k))
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs])], ["row_id", "text"])
    got = [tuple(x.values())[:3] for b in C._search(C.Items.of(every, 0.45), 0.45)(C._post(iter([batch]))) for x in b.to_pylist()]
    assert len(want) > 100 and set(got) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "짧다"), (None, ITEMS[0][2]), (4, ITEMS[0][2] * 300)], "id long, body string")
    more = ITEMS + [("b", 99, "짧은 글"), ("b", 98, ""), ("b", 97, None), ITEMS[0]]
    assert {(r.item_id, r.row_id) for r in leaks(spark, df, more).collect()} == {(0, 4)}
    assert leaks(spark, df.limit(0)).count() == 0
    assert leaks(spark, df, []).count() == 0
