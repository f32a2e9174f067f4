import random
from collections import defaultdict

import numpy as np

from jikjo.llm import packing as P


def held(sizes, k):
    return [sizes[k == c].astype(float) for c in range(k.max() + 1)]


def test_best_fit_keeps_every_constraint():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 512, 1500)
    for documents, attention in ((6, 0.97), (32, 0.5), (3, 0.7)):
        for s in held(sizes, P.best_fit(sizes, 512, documents=documents, attention=attention)):
            assert s.sum() <= 512 and len(s) <= documents and (len(s) == 1 or (s**2).sum() <= attention * 512**2)
    assert sizes.sum() / (512 * (P.best_fit(sizes, 512).max() + 1)) > 0.97


def test_each_limit_binds():
    """Where one limit alone is tight, it decides how many containers are needed."""
    same = np.full(120, 100)
    assert P.best_fit(same, 1000, documents=32, attention=0.97).max() + 1 == 12  # tokens: ten items
    assert P.best_fit(same, 1000, documents=4, attention=0.97).max() + 1 == 30  # documents: four items
    assert P.best_fit(same, 1000, documents=32, attention=0.05).max() + 1 == 24  # attention: five items of 0.01
    long = np.array([990] * 10 + [8] * 10)
    assert all(len(s) == 1 for s in held(long, P.best_fit(long, 1000, attention=0.97)) if s.max() == 990)  # alone, though tokens are left
    assert P.best_fit(long, 1000, attention=1.0).max() + 1 == 10


def test_containers_report_what_is_left(spark):
    df = spark.createDataFrame([(i, 100 + i % 7) for i in range(300)] + [(900, 2500), (901, 0)], "doc_id long, n_tokens long")
    caps = spark.createDataFrame([(512,), (1000,)], "seq_len int")
    packed = P.pack(df, "doc_id", caps)
    rows = P.containers(packed).collect()
    assert all(r.rest_tokens == r.seq_len - r.tokens >= 0 and r.rest_documents == P.MOST_DOCUMENTS - r.n_documents >= 0 for r in rows)
    assert all(r.rest_attention >= 0 or r.n_documents == 1 for r in rows)
    assert {r.seq_len for r in P.fill(packed).collect()} == {512, 1000}


def test_pack(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([1, 5, 40, 100, 300, 511, 512, 513, 5000]) if i % 3 else r.randint(1, 900)) for i in range(3000)]
    rows = sizes + sizes[:10] + [(9000, 0), (None, 5)]
    df = spark.createDataFrame([(k, n, "x") for k, n in rows], "doc_id long, n_tokens long, shard string").where("doc_id is not null")
    caps = spark.createDataFrame([(512,), (1024,), (512,), (None,)], "seq_len int")
    got = P.pack(df, "doc_id", caps).collect()
    for cap in (512, 1024):
        bins, parts = defaultdict(int), defaultdict(list)
        for x in got:
            if x.seq_len == cap and x.container_id is not None:
                bins[x.container_id] += x.n_tokens
                parts[x.doc_id].append((x.piece_no, x.token_from, x.n_tokens))
        assert max(bins.values()) <= cap
        assert sum(bins.values()) / (cap * len(bins)) > 0.97
        for k, n in sizes:
            p = sorted(parts[k])
            assert sum(x[2] for x in p) == n and [x[1] for x in p] == list(np.cumsum([0] + [x[2] for x in p[:-1]]))
            assert len(p) == 1 or n > cap
    assert {(x.container_id, x.n_tokens) for x in got if x.doc_id == 9000} == {(None, 0)}
    assert {r.seq_len: r.filled > 0.97 for r in P.fill(spark.createDataFrame(got, P.pack(df, "doc_id", caps).schema)).collect()} == {512: True, 1024: True}
    assert P.pack(df.limit(0), "doc_id", caps).count() == 0
