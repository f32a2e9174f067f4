"""Operators against plain models of them, and on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from jikjo.functions import tagger
from jikjo.functions import text as T
from jikjo.operators import chunking, metrics, mining, ordering, quality, sampling, telemetry


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("x,want", [("a. bbbbbbbbbb. c", ["a. bbbbbbbbbb.", "c"]), ("", []), ("   ", []), ("끝", ["끝"]), (None, None)])
def test_scan_sentences(spark, x, want):
    assert one(spark, T.scan_sentences(F.col("t")), t=x) == want


@pytest.mark.parametrize(
    "t,g,want", [("나는 간다", "간다", "나는 [MASK]"), ("간다 나는", "간다", "[MASK] 나는"), ("나는", "간다", "나는 [MASK]"), (" 나는 간다 ", "간다", "나는 [MASK]")]
)
def test_mask_word(spark, t, g, want):
    assert one(spark, T.mask_word(F.col("t"), F.col("g"), "[MASK]"), t=t, g=g) == want


@pytest.mark.parametrize("n,j,want", [("책", "을/를", "책을"), ("나무", "을/를", "나무를"), ("책", "은/는", "책은"), ("나무", "이/가", "나무가"), ("나무", "에", "나무에"), ("", "에", "에")])
def test_particles(spark, n, j, want):
    assert one(spark, T.attach_particle(F.col("n"), F.col("j")), n=n, j=j) == want


def test_strip_takes_all_white_space(spark):
    assert one(spark, T.strip(F.col("t")), t="　\x1c 가 나 \n") == "가 나"


def test_native_and_batch_tagger_agree(spark, data):
    df = spark.read.parquet(f"{data}/raw_text.parquet").where("text is not null").limit(40).select("text")
    for r in df.select(tagger.native_tokens(F.col("text")).alias("a"), tagger.tokens(F.col("text")).alias("b"), "text").collect():
        assert r.a == r.b
        assert all(r.text[s : s + n] == f for f, _, s, n in tagger.tagged(r.text))


def greedy(sents, limit, least=0.3):
    out, cur, n = [], "", 0
    for s in sents:
        k = len(s.split())
        if k > limit:
            if cur and n > limit * least:
                out.append(cur.strip())
            out.append(" ".join(s.split()[:limit]))
            cur, n = "", 0
        elif n + k > limit and cur:
            if n > limit * least:
                out.append(cur.strip())
            cur, n = s, k
        else:
            cur, n = cur + " " + s, n + k
    return out + ([cur.strip()] if cur and n > limit * least else [])


def loose(sents, limit, least=0.6):
    out, cur, n = [], "", 0
    for s in sents:
        k = len(s.split())
        if n + k > limit and cur:
            if n >= limit * least:
                out.append(cur.strip())
            cur, n = s, k
        else:
            cur, n = cur + " " + s, n + k
    return out + ([cur.strip()] if cur and n >= limit * least else [])


def sliding(sents, target, least=0.7):
    out = []
    for i in range(len(sents)):
        w = []
        for s in sents[i:]:
            w += s.split()
            if len(w) >= target:
                break
        if len(w) >= int(least * target):
            out.append(w[:target])
    return out


def segments(parts, target, least=0.7):
    out, cur = [], []
    for p in parts:
        w = p.split()
        if cur and len(cur) + len(w) > target:
            if len(cur) >= int(least * target):
                out.append(" ".join(cur[:target]))
            cur = []
        cur += w
    return out + ([" ".join(cur[:target])] if cur and len(cur) >= int(least * target) else [])


def merged(parts, least, most):
    out, cur = [], ""
    for p in parts:
        if not cur:
            cur = p
        elif len(cur) < least:
            cur += "\n\n" + p
        else:
            out += [cur] if len(cur) <= most else []
            cur = p
    return out + ([cur] if least <= len(cur) <= most else [])


def test_chunkers_equal_plain_loops(spark, data):
    x = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("text")
    extra = spark.createDataFrame([("",), ("가. " * 400,), ("단어 " * 300 + "끝.",), ("한 줄\n\n" * 50,)], "text string")
    s, p = T.scan_sentences(F.col("text")), T.paragraphs(F.col("text"))
    df = x.union(extra).select(
        s.alias("s"), p.alias("p"), chunking.greedy(s, 32).alias("a"), chunking.loose(s, 32).alias("b"), chunking.sliding(s, 32).alias("c"),
        chunking.segments(p, 32).alias("d"), chunking.merged_paragraphs(p, 120, 600).alias("e"), chunking.windows(T.words(F.col("text")), 32, 8).alias("f"),
    )
    for r in df.collect():
        assert r.a == greedy(r.s, 32) and all(len(c.split()) <= 32 for c in r.a)
        assert r.b == loose(r.s, 32)
        assert r.c == sliding(r.s, 32)
        assert r.d == segments(r.p, 32)
        assert r.e == merged(r.p, 120, 600)
        assert all(22 <= len(w) <= 32 for w in r.f)


def test_examples_slice_before_the_distance(spark):
    f = spark.createDataFrame([(1, "가나재단", 0, [0, 50, 100, 150, 200]), (2, "가나재단", 0, [0, 5, 10, 15, 20])], "k long, entity string, entity_order int, positions array<int>")
    got = sorted((r.k, r.distance) for r in mining.examples(f, "k").collect())
    assert got == [(1, 50), (1, 100), (1, 150), (2, 10), (2, 15)]
    many = spark.range(1001).select(F.col("id").alias("k"), F.lit("e").alias("entity"), F.lit(0).alias("entity_order"), F.lit(5).alias("coref_pos"))
    assert sorted(r.k for r in mining.capped(many, "k", 1000).collect()) == list(range(1000))


def test_repetitions_cases(spark):
    rows = [(1, "한강은행은 컸다. 한강은행이 샀다."), (2, "그는 한강은행, 한강은행을 봤다."), (3, None), (4, ""), (5, "한강은행")]
    df = spark.createDataFrame(rows, "k long, t string")
    assert [(r.k, r.positions) for r in mining.repetitions(df, "k", "t").orderBy("k").collect()] == [(1, [0, 10]), (2, [3, 9])]
    assert [r.k for r in mining.repetitions(df, "k", "t", without_pronouns=True).collect()] == [1]


def test_prefix_stop_overshoots(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "k long, n long")
    assert sorted(r.k for r in ordering.prefix_stop(df, ["k"], F.col("n"), 5).collect()) == [1, 2]


def test_numbering_over_partitions(spark):
    r = random.Random(1)
    ids = r.sample(range(10**6), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(7)
    got = {x.k: x.row for x in ordering.numbered(df, ["k"]).collect()}
    assert got == {k: n + 1 for n, k in enumerate(sorted(ids))}


@pytest.mark.parametrize("n,k,rows", [(1999, 1000, 1999), (2000, 1000, 1000), (0, 5, 0), (3, 10, 3)])
def test_strided(spark, n, k, rows):
    assert sampling.strided(spark.range(n).withColumnRenamed("id", "k"), "k", k).count() == rows


def test_evenly_spaced(spark):
    assert sorted(r.k for r in sampling.evenly_spaced(spark.range(10).withColumnRenamed("id", "k"), "k", 4).collect()) == [0, 3, 6, 9]


def test_hit_rule_and_missing_predictions(spark):
    items = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "ab")], "i long, gold string")
    preds = spark.createDataFrame([(1, "m", ["xabx"]), (2, "m", ["q", "a"])], "i long, model string, candidates array<string>")
    r = metrics.accuracy(items, preds, "i", "gold", [1, 2]).first()
    assert (r.n, r.at_1, r.at_2) == (3, round(1 / 3, 6), round(2 / 3, 6))


def test_upsert_and_best(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    new = spark.createDataFrame([(2, 3.0)], "k long, v double")
    both = metrics.upsert(old, new, "k")
    assert sorted(map(tuple, both.collect())) == [(1, 1.0), (2, 3.0)]
    assert [tuple(r) for r in metrics.best_of(both, "k", ["v"]).collect()] == [("v", 2, 3.0)]


def test_quality_of_no_words(spark):
    r = quality.vector(spark.createDataFrame([(1, "!!!")], "k long, t string"), "k", "t").first()
    assert abs(r.quality_score - 0.2) < 1e-12 and r.total_words == 0


def test_ema(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0), ("a", 4, None)], "k string, o long, v double")
    assert abs(telemetry.ema(df, "k", ["o"], "v").first().ema - 1.39) < 1e-12


def test_pairs_take_the_next_end(spark):
    rows = [("a", 0, "b"), ("a", 1, "b"), ("a", 3, "e"), ("a", 4, "e"), ("a", 6, "b")]
    df = spark.createDataFrame(rows, "k string, s long, e string").withColumn("ts", F.timestamp_seconds("s"))
    got = telemetry.paired(df, "k", ["s"], F.col("e"), "b", "e", "ts").orderBy("began").collect()
    assert [r.ended is not None for r in got] == [False, True, False] and got[1].seconds == 2.0


def test_d8_number_format(spark):
    assert one(spark, T.fixed(F.col("v"), 4), v=1234.56785) == "%.4f" % 1234.56785




def test_chunkers_of_a_long_text(spark):
    """Some hundred thousand words: the folds hold numbers only, so it takes seconds."""
    import time

    text = "한 문장이 여기에 있다고 그는 말했다. " * 40_000
    df = spark.createDataFrame([(text,)], "text string")
    s = T.scan_sentences(F.col("text"))
    began = time.time()
    r = df.select(F.size(chunking.greedy(s, 64)).alias("a"), F.size(chunking.loose(s, 64)).alias("b"), F.size(chunking.segments(s, 64)).alias("c")).first()
    assert r.a == r.b == 4000 and r.c == 4000 and time.time() - began < 60
