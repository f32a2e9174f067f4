import numpy as np

from jikjo.llm import quality as Q

PROSE = "그는 지난해 도서관을 새로 지었다고 말했다. 우리는 이를 다시 확인했습니다.\n마을을 떠나기 전에 모두 함께 밥을 먹었다.\n"
LIST = "\n".join(f"• 항목 {i}번" for i in range(30))
TABLE = "\n".join(f"| 이름{i} | {i},123 | 4{i}.5 | 77 |" for i in range(20))
JUNK = "\n".join("QmFzZTYwIGl7zIGvdCBZXhI4DEyMzQlNjcOTAKxWbTQrsRfZkqL" + str(i) for i in range(10))


def frame(spark):
    rows = [(i, (PROSE * (1 + i % 5))) for i in range(60)] + [(100 + i, t) for i, t in enumerate([LIST, TABLE, JUNK] * 6)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, PROSE + TABLE * 5), (None, LIST)]
    return spark.createDataFrame([(k, t, "x", 0.5) for k, t in rows], "k long, t string, words string, prose_share double")


def test_types(spark):
    got = {r.rec_id: r for r in Q.text_types([("x", frame(spark), "k", "t")]).collect()}
    assert all(got[i].text_type == "prose" and got[i].prose_share > 0.9 for i in range(60))
    assert all(got[100 + i].prose_share < 0.1 for i in range(18))
    assert [got[100 + i].text_type for i in range(3)] == ["list", "table", "junk"]
    assert got[203].prose_share < 0.5
    assert got[200].text_type is got[201].text_type is got[202].text_type is None and got[201].words == 0
    assert len(got) == 60 + 18 + 4


def test_statistics():
    t = Q.look(Q.split("The cat sat.\nOn a mat, it is"), [3.0, 3.0])
    assert (t.words, t.stop_share) == (8, 0.5) and abs(t.word_length - 21 / 8) < 1e-9 and t.symbol_ratio == 2 / 27 and t.common_share == 5 / 8


def test_thresholds_on_statistics():
    def says(text, bits=3.0):
        (p,) = Q.look([text], [bits]).patterns
        return {name for k, (_, name) in enumerate(Q.FUNCTIONS) if p >> k & 1}

    assert {"ends in punctuation", "common words 1/3"} <= says("The cat sat on the mat and looked at the other one.")
    assert "symbols 2/5" in says("== ** -- ++ // a b") and "digits 3/10, or a name and a value" in says("12,300 4,560 7 88 a b c d")
    assert {"7 bits of surprise", "6 bits of surprise, no common word"} <= says("푸니경 랄두쿠 상비쿠 구저잘 방바알", 7.5)
    assert "words said again and again" in says("sale now " * 8) and "3 words at most in a text whose lines end without marks" in says("a b")


def test_noise_surprises_and_prose_does_not():
    r = np.random.default_rng(4)
    prose = [PROSE.split("\n")[i % 2] for i in range(400)]
    noise = ["".join(chr(c) for c in r.integers(0xAC00, 0xAC00 + 300, 60)) for _ in range(40)]
    rows = prose + noise
    pair, one, _ = Q._pairs(rows)
    counts = np.concatenate([np.bincount(pair, minlength=Q.BUCKETS), np.bincount(one, minlength=Q.BUCKETS)])
    bits = Q.surprises(counts, rows)
    assert bits[:400].max() < bits[400:].min()


def votes_of(r, truth, rates):
    vote = r.random((len(truth), len(Q.LABELS))) < rates[:, truth].T
    return (vote << np.arange(len(Q.LABELS), dtype=np.int64)).sum(1)


def test_em_learns_accuracies_from_agreement():
    """Functions of very different accuracy: what EM learns beats the start values, and by far where votes are scarce."""
    r = np.random.default_rng(1)
    truth = r.choice(4, 20_000, p=[0.6, 0.15, 0.15, 0.1])
    kinds = np.array(Q.LABELS)
    own = kinds[:, None] == np.arange(4)
    good = np.arange(len(kinds)) % 3 == 0
    rates = np.where(own, np.where(good, 0.75, 0.12)[:, None], np.where(good, 0.01, 0.1)[:, None])
    patterns = votes_of(r, truth, rates)
    p, n = np.unique(patterns, return_counts=True)
    right = [(Q.learn(p, n, rounds).argmax(1)[np.searchsorted(p, patterns)] == truth).mean() for rounds in (0, 200)]
    assert right[1] > 0.95 and right[1] > right[0] + 0.02


def test_types_that_hardly_occur_stay(spark):
    """With a thousandth of lines that aren't prose no type is taken over by a kind of prose."""
    rows = [(i, PROSE) for i in range(3000)] + [(5000, LIST), (5001, TABLE)]
    got = {r.rec_id: r.text_type for r in Q.text_types([("x", spark.createDataFrame(rows, "k long, t string"), "k", "t")]).collect()}
    assert got[5000] == "list" and got[5001] == "table" and {got[i] for i in range(3000)} == {"prose"}


def test_empty(spark):
    assert Q.text_types([("x", spark.createDataFrame([], "k long, t string"), "k", "t")]).count() == 0
