import random
import re

import numpy as np
import pyarrow as pa
import pytest

from jikjo.llm import neardup

WORDS = [f"단어{i}" for i in range(4000)]


def sets(text, width, words):
    if words:
        u = re.findall(r"\w+", text.lower())
        return {tuple(u[i : i + width]) for i in range(len(u) - width + 1)}
    u = re.sub(r"[\W_]", "", text.lower())
    return {u[i : i + width] for i in range(len(u) - width + 1)}


def brute(rows, width, words, threshold, least=0):
    by = {}
    for i, t in rows:
        if i is not None and t:
            by[i] = t
    out, ids = set(), sorted(by)
    s = {i: sets(by[i], width, words) for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and len(re.sub(r"[\W_]", "", by[a])) >= least <= len(re.sub(r"[\W_]", "", by[b])):
                if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
                    out.add((a, b))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        base = [r.choice(WORDS) for _ in range(r.randint(40, 120))]
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df, "x", "k", "t").collect()}
    assert got == brute(rows, 5, True, 0.8)
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df, "x", "k", "t", 0.6, 5, 200, False).collect()}
    assert got == brute(rows, 5, False, 0.6, 200)


def test_dense_group_is_whole(spark, monkeypatch):
    """Many different texts that agree in nearly all shingles: every pair is found though a region holds few rows."""
    monkeypatch.setattr(neardup, "REGION", 8)
    base = [f"w{i}" for i in range(800)]
    rows = [(i, " ".join([f"begin{i}"] + base)) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, t string")
    pairs = {(r.id_a, r.id_b) for r in neardup.near_pairs(df, "x", "k", "t").collect()}
    assert len(pairs) == 90 * 89 // 2
    classes = neardup.near_classes(df, "x", "k", "t").collect()
    assert {r.class_id for r in classes} == {0} and {r.n_links for r in classes} == {89}


def test_hot_prefixes_are_spread(spark, monkeypatch):
    """With bounds so low that every path is taken, the pairs are the same."""
    rows = corpus(5, 20) + [(9000 + i, " ".join([f"w{k}" for k in range(300)] + [f"end{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string")
    monkeypatch.setattr(neardup, "REGION", 8)
    for hot in (5, 30):
        monkeypatch.setattr(neardup, "HOT", hot)
        got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df, "x", "k", "t").collect()}
        assert got == brute(rows, 5, True, 0.8)


def test_classes_are_components(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "k long, t string")
    links = brute(rows, 5, True, 0.8)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.class_id for r in neardup.near_classes(df, "x", "k", "t").collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(150, 151)]
    got = {r.id: r.class_id for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_odd_rows(spark):
    t = " ".join(WORDS[:50])
    rows = [(1, t), (1, t), (2, t), (3, None), (4, ""), (5, "짧다"), (None, t), (6, " ".join(WORDS[60:]) * 20)]
    df = spark.createDataFrame([(k, x, "c", 1) for k, x in rows], "k long, t string, id string, a int")
    assert {(r.id_a, r.id_b) for r in neardup.near_pairs(df, "x", "k", "t").collect()} == {(1, 2)}
    empty = spark.createDataFrame([], "k long, t string")
    assert neardup.near_pairs(empty, "x", "k", "t").count() == 0
    assert neardup.near_classes(empty, "x", "k", "t").count() == 0


def test_group_of_reworked_copies_is_whole(spark):
    """A few hundred texts at similarity 0.62: every true pair that shares a head in any tree is found, and under 1 % share none."""
    r = random.Random(11)
    base = [f"{chr(0xAC00 + i)}" for i in range(1500)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in r.sample(range(0, 1500, 6), 38):
            w[k] = chr(0x4E00 + r.randrange(20_000))
        rows.append((i, "".join(w)))
    want = brute(rows, 5, False, 0.6, 200)
    assert len(want) > 10_000
    h, begin, use = neardup._shingled([t for _, t in rows], 5, 200, False)
    low, word, more = neardup.signatures(h, begin[:-1])
    low = low.reshape(len(rows), neardup.TREES, -1)
    reach = {(a, b) for a, b in want if (low[a] == low[b]).all(1).any() and int((word[a] ^ word[b]) | (more[a] ^ more[b])).bit_count() <= neardup.FAR}
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(x.id_a, x.id_b) for x in neardup.near_pairs(df, "x", "k", "t", 0.6, 5, 200, False).collect()}
    assert reach <= got <= want
    assert len(got) > 0.99 * len(want)


def crowd(n, size=900, seed=5):
    """Variants of one template, of each a stretch of 12 to 20 % replaced, and the similarity of all pairs, from where the stretches are."""
    r = np.random.default_rng(seed)
    base = r.integers(0xAC00, 0xD7A0, size)
    lo = np.empty(n, np.int64)
    hi = np.empty(n, np.int64)
    texts = []
    for i in range(n):
        m = int(size * r.uniform(0.12, 0.20))
        at = int(r.integers(0, size - m))
        x = base.copy()
        x[at : at + m] = r.integers(0x4E00, 0x9FA0, m)
        texts.append("".join(map(chr, x)))
        lo[i], hi[i] = max(0, at - 4), min(size - 4, at + m)
    i, j = np.triu_indices(n, 1)
    lost = (hi - lo)[i] + (hi - lo)[j] - np.maximum(0, np.minimum(hi[i], hi[j]) - np.maximum(lo[i], lo[j]))
    both = size - 4 - lost
    return texts, i, j, both / (2 * (size - 4) - both)


@pytest.mark.parametrize("n", [60, 200, 1000])
def test_recall_in_a_crowd(spark, n):
    texts, i, j, similar = crowd(n)
    want = set(zip(i[similar >= 0.6].tolist(), j[similar >= 0.6].tolist()))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df, "x", "k", "t", 0.6, 5, 200, False).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.001 * len(want)
    if n == 200:
        classes = {r.id: r.n_links for r in neardup.near_classes(df, "x", "k", "t", 0.6, 5, 200, False).collect()}
        assert classes == {k: sum(k in p for p in got) for k in range(n)}


def test_recall_in_a_crowd_of_thousands():
    """As all pairs of a region are compared, what counts is that a pair shares a region: so for a crowd of any size."""
    texts, i, j, similar = crowd(5000, 400)
    some = np.random.default_rng(1).choice(np.flatnonzero(similar >= 0.6), 100_000, False)
    h, begin, _ = neardup._shingled(texts, 5, 200, False)
    low, word, more = neardup.signatures(h, begin[:-1])
    low = low.reshape(len(texts), neardup.TREES, neardup.DEPTH)
    share = (low[i[some]] == low[j[some]]).all(2).any(1) & (np.bitwise_count((word[i[some]] ^ word[j[some]]) | (more[i[some]] ^ more[j[some]])) <= neardup.FAR)
    assert share.mean() >= 0.99


def test_walk_across_batches():
    """A region's pairs don't depend on where batches end, nor on its size; a crowded region is split by one more value."""
    r = random.Random(2)
    shapes = [(1,), (3,), (24,), (10, 14), (10, 15), (25,), (60, 2, 30), (2,), (24, 24, 24), (130, 1, 5), (1,) * 30, (1,)]
    head = np.array([(p << 16) + 7 * k for p, subs in enumerate(shapes) for k, n in enumerate(subs) for _ in range(n)])
    ids = np.array(r.sample(range(100_000), len(head)))
    pairs, dense = set(), []
    for p, subs in enumerate(shapes):
        whole = sum(subs) <= neardup.REGION
        for g in {0} if whole else set(range(len(subs))):
            mine = ids[(head >> 16 == p) if whole else (head == (p << 16) + 7 * g)].tolist()
            if len(mine) > neardup.REGION:
                dense += [((p << 16) + 7 * g, x) for x in mine]
            else:
                pairs |= {(min(a, b), max(a, b)) for n, a in enumerate(mine) for b in mine[n + 1 :]}
    for step in (1, 2, 5, 24, 25, 26, 40, 97, 1000):
        cut = [slice(o, o + step) for o in range(0, len(head), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[c]) for x in (head, ids, 0 * ids, 0 * ids)], ["head", "id", "bits", "more"]) for c in cut]
        out = pa.Table.from_batches(list(neardup._walk(iter(batches)))).to_pylist()
        assert sorted((x["a"], x["b"]) for x in out if x["dense"] is None) == sorted(pairs)
        assert sorted((x["dense"], x["a"]) for x in out if x["dense"] is not None) == sorted(dense)


def test_short_and_blank_records_have_a_class(spark):
    rows = [(1, "짧은 글."), (2, "짧은, 글"), (3, "다른 글"), (4, None), (5, " "), (6, "!!"), (7, "가" * 300), (8, "가" * 300), (4, None)]
    got = {r.id: (r.class_id, r.n_links) for r in neardup.near_classes(spark.createDataFrame(rows, "k long, t string"), "x", "k", "t", 0.6, 5, 200, False).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 1), 8: (7, 1)}


def test_deliveries_that_differ_count_once(spark):
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(1, a), (1, b), (2, a), (3, b), (1, None)]
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(spark.createDataFrame(rows, "k long, t string"), "x", "k", "t").collect()}
    assert got in ({(1, 2)}, {(1, 3)})


def test_classes_of_both_tables(spark, data):
    """p3_classes has every record of both tables once, and the links that p3_found has."""
    from jikjo.llm import queries

    rows = queries.p3_classes(spark, data).collect()
    got = {(r.rec_table, r.id) for r in rows}
    want = {(name, r[0]) for name, key in (("raw_text", "row_id"), ("translated_news", "news_id")) for r in spark.read.parquet(f"{data}/{name}.parquet").select(key).collect()}
    assert got == want and len(rows) == len(got)
    linked = {(r.rec_table, i) for r in queries.p3_found(spark, data).collect() for i in (r.id_a, r.id_b)}
    assert linked <= {(r.rec_table, r.id) for r in rows if r.n_links}
