import random

from jikjo.llm import mixing as M


def by_quotients(weights, caps, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        free = sorted(n for n in weights if got[n] < caps[n] and weights[n] > 0)
        if not free:
            break
        got[max(free, key=lambda n: (weights[n] / (2 * got[n] + 1), [-ord(c) for c in n]))] += 1
    return got


def test_apportionment_equals_seat_by_seat():
    r = random.Random(8)
    for _ in range(300):
        names = [f"s{i}" for i in range(r.randint(1, 8))]
        w = {n: r.choice([0.0, 0.1, 0.25, r.random()]) for n in names}
        caps = {n: r.choice([0, 3, 1000]) for n in names}
        seats = r.randint(0, 200)
        assert M.apportion(w, caps, seats) == by_quotients(w, caps, seats)


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, r.choices(["a", "b", "c", "d", None], [60, 25, 3, 10, 2])[0], r.randint(1, 400)) for i in range(6000)]
    df = spark.createDataFrame([(k, s, n, "x") for k, s, n in rows + rows[:50]] + [(9999, "a", 0, "x")], "doc_id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("gone", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix(df, "doc_id", targets, total=500_000)
    got, rep = mixture.collect(), {x.source: x for x in report.collect()}
    size = {k: (s, n) for k, s, n in rows}
    assert len({x.doc_id for x in got}) == len(got) and all(size[x.doc_id] == (x.source, x.n_tokens) for x in got)
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(x.copies <= cap[x.source] for x in got)
    total = sum(x.tokens for x in rep.values())
    assert abs(total - 500_000) < 5_000
    assert rep["gone"].tokens == 0 and rep["c"].tokens <= 2 * rep["c"].available_tokens
    assert abs(rep["a"].tokens - rep["b"].tokens) < 5_000
    assert abs(sum(x.actual_share for x in rep.values()) - 1) < 1e-9
    again = M.mix(df, "doc_id", targets, total=500_000)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_many_shards(spark, monkeypatch):
    """Over many shards and groups: quotas are kept, whole passes and seeded blocks, another seed draws others."""
    r = random.Random(3)
    rows = [(i, r.choices(["a", "b", "c"], [60, 30, 10])[0], r.randint(1, 900)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    total = sum(n for _, _, n in rows)
    monkeypatch.setattr(M, "SHARD_TOKENS", total // 23)
    drawn = []
    for seed in (7, 8):
        mixture, report = M.mix(df, "doc_id", targets, total=1_500_000, seed=seed)
        got, rep = mixture.collect(), {x.source: x for x in report.collect()}
        assert len({x.doc_id for x in got}) == len(got)
        for s, cap in (("a", 1), ("b", 3), ("c", 2)):
            assert rep[s].most_copies <= cap
            want = rep[s].quota_blocks * rep[s].block_tokens
            assert abs(rep[s].tokens - want) <= 23 * 1_500 and abs(rep[s].tokens - want) < 0.05 * want
        drawn.append({x.doc_id for x in got if x.source == "a"})
    chance = len(drawn[0]) / sum(s == "a" for _, s, _ in rows)
    assert abs(len(drawn[0] & drawn[1]) / len(drawn[0]) - chance) < 0.1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix(df, "doc_id", targets)
    assert mixture.count() == 0 and [(r.tokens, r.actual_share) for r in report.collect()] == [(0, 0.0)]
