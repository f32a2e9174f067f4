import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jikjo.llm import splitting as P


def check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(y[0] == x[1] - overlap for x, y in zip(pieces, pieces[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="가나. \n,a!", max_size=600), st.integers(20, 60))
def test_pieces_cover_and_overlap(text, limit):
    check(text, [p[:2] for p in P.plan(text, limit, 7)], limit, 7)


def test_natural_places_are_preferred():
    text = "가나다라 마바사. " * 40
    assert all(k == "sentence" for _, _, k in P.plan(text, 100, 10)[:-1])
    assert all(k == "hard" for _, _, k in P.plan("가" * 500, 100, 10)[:-1])
    assert P.plan("é" * 100, 51, 5)[0][1] % 2 == 0


def texts():
    r = random.Random(3)
    long = "".join(r.choice(["가나다 ", "라마바사.", "\n", "하" * 40, "x, "]) for _ in range(3000))
    return [(1, "짧다."), (2, long), (3, "무" * 5000), (4, None), (5, ""), (2, long), (6, "끝.\n\n" * 900), (None, long)]


def test_records_by_ranges(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, "extra", 1) for k, t in rows], "k long, t string, piece string, n_chars int")
    by = {k: t for k, t in rows if k is not None and t}
    before = None
    for size in (1_000_000, 1, 6_000):
        got = {}
        for r in P.oversized_pieces(df, "k", "t", limit=300, overlap=30, size=size).collect():
            assert r.piece == by[r.rec_id][r.start_pos : r.end_pos] and r.n_chars == len(by[r.rec_id])
            got.setdefault(r.rec_id, []).append((r.piece_no, r.start_pos, r.end_pos, r.longest_stretch, r.cut))
        assert set(got) == {k for k, t in by.items() if len(t) > 300}
        for k, p in got.items():
            p.sort()
            assert [x[0] for x in p] == list(range(len(p)))
            check(by[k], [x[1:3] for x in p], 300, 30)
            stretch = max(map(len, P._PAUSE.split(by[k])))
            assert {x[3] for x in p} == {stretch} and p[-1][4] == "end"
        assert before in (None, got)  # the same pieces whatever the ranges
        before = got


def test_a_text_of_five_million_characters(spark):
    r = random.Random(8)
    text = "".join(r.choice(["가나다 ", "라마바사. ", "\n\n", "하" * 40, "x, ", "나" * 2500]) for _ in range(12_100))
    assert len(text) > 5_000_000
    df = spark.createDataFrame([(1, text)], "k long, t string")
    got = [sorted(tuple(x) for x in P.oversized_pieces(df, "k", "t", size=n).drop("piece").collect()) for n in (10_000, 512_000, 10_000_000)]
    assert got[0] == got[1] == got[2]
    check(text, [x[2:4] for x in got[0]], P.LIMIT, P.OVERLAP)
    assert {x[6] for x in got[0]} == {max(map(len, P._PAUSE.split(text)))}


def test_deliveries_that_differ_are_not_mixed(spark):
    a, b = "가나다. " * 200, "라마바사 " * 300
    rows = P.oversized_pieces(spark.createDataFrame([(1, a), (1, b), (1, a)], "k long, t string"), "k", "t", 300, 30).orderBy("piece_no").collect()
    text = a if rows[0].piece[0] == "가" else b
    assert all(x.piece == text[x.start_pos : x.end_pos] for x in rows)
    check(text, [(x.start_pos, x.end_pos) for x in rows], 300, 30)


def test_files_by_byte_ranges(spark, tmp_path):
    r = random.Random(5)
    text = "".join(r.choice(["가나다 ", "라마바사.", "\n", "하" * 90, "é😀x "]) for _ in range(20000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    before = None
    for size in (1, 10_001, 64 << 20):
        rows = P.split_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "empty.txt")], 300, 30, size=size).collect()
        big = sorted((x.piece_no, x.start_pos, x.end_pos, x.piece) for x in rows if x.path.endswith("big.txt"))
        assert before in (None, big)
        before = big
    assert [b[0] for b in big] == list(range(len(big)))
    assert all(text[a:b] == p for _, a, b, p in big)
    check(text, [b[1:3] for b in big], 300, 30)


def test_empty_table_and_bad_overlap(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert P.oversized_pieces(df, "k", "t").count() == 0
    with pytest.raises(ValueError):
        P.oversized_pieces(df, "k", "t", limit=100, overlap=60)
