import random

import pytest

from jikjo.llm import mojibake as M

R = random.Random(6)
NOUNS = "도서관 정류장 화산 씨앗 과수원 기록표 안개 지표 공연 예산 채권 문서 시장 환율 우물 관세 학급 저수지".split()


def korean():
    return " ".join(f"{R.choice(NOUNS)}을 {R.choice(NOUNS)}에서 {R.choice(['빠르게', '천천히', '다시'])} {R.choice(['조사했다.', '옮겼다.', '세웠다.'])}" for _ in range(6))


def french():
    return " ".join(R.choice(["Le théâtre est fermé.", "L’été dernier, le dépôt a été rénové.", "Où se trouve le traité ?", "À Paris, il a cédé."]) for _ in range(8))


def chinese():
    return "".join(R.choice(["他们从海南村带回船只，", "为什么白云没有去看仓库？", "费用达到三亿，", "古老的灯塔变成了巨大的样子。"]) for _ in range(10))


@pytest.fixture(scope="module")
def weights():
    return M.train([f() for f in (korean, french, chinese) for _ in range(80)])


CHAINS = {c.name: c for c in M.CHAINS}


@pytest.mark.parametrize(
    "name,make",
    [("utf8>cp1252", korean), ("utf8>cp1252", french), ("utf8>latin1", chinese), ("utf8>cp1252>utf8>cp1252", korean), ("cp949>cp1252", korean), ("gbk>cp1252", chinese), ("cp949>gbk", korean)],
)
def test_round_trip(weights, name, make):
    for _ in range(10):
        x = make()
        got = M.repair(weights, CHAINS[name].garble(x))
        assert (got.case, got.text) == ("restorable", x)
        # only a passage of it
        p = len(x) // 2
        y = korean() + "\n" + CHAINS[name].garble(x[p:])
        got = M.repair(weights, y)
        assert got.case == "restorable" and got.text.endswith(x[p:])


def test_clean_marks_beside_a_run(weights):
    x = korean()
    for name in ("utf8>cp1252", "cp949>cp1252"):
        got = M.repair(weights, "“그는 갔다.”" + CHAINS[name].garble(x))
        assert (got.case, got.text) == ("restorable", "“그는 갔다.”" + x)


@pytest.mark.parametrize("name,make", [("utf8>cp949", korean), ("cp949>utf8", korean), ("any>?", korean), ("utf8>ascii", chinese)])
def test_lossy(weights, name, make):
    for _ in range(10):
        assert M.repair(weights, CHAINS[name].garble(make())).case == "lossy"


def test_clean_text_stays(weights):
    for x in [korean(), french(), chinese(), "정말요??? 네, 정말입니다???", "★★★★ ♥♥♥♥ ~~~~~~", "제목은 «Ночной порт»였다.", "한자 표기는 壇君峰이다.", "", " ", "a|b|c " * 50, "x" * 100_000, "?"]:
        assert M.repair(weights, x) is None


def test_the_predicted_chain_is_undone(weights):
    """Over all chains that can be undone: the chain is the one that garbled the text (or its twin in Latin-1), and other chains are hardly needed."""
    parts = strange = right = n = 0
    for name, make in [(c, f) for c in CHAINS for f in (korean, french, chinese)]:
        for _ in range(4):
            x = make()
            y = CHAINS[name].garble(x)
            if y is None or y == x or CHAINS[name].undo(y) != x:
                continue
            got = M.repair(weights, korean() + "\n" + y)
            n += 1
            if got and got.text.endswith(x):
                right += 1
                parts, strange = parts + got.parts, strange + got.fallbacks
    assert n > 60 and right >= 0.95 * n and strange <= 0.05 * parts


def test_runs_of_hangul_or_marks_are_scored(weights):
    """A garbled run without any character that is rare in clean text."""
    x = "他们从海南村带回船只费用达到三亿古老的灯塔变成了巨大的样子" * 2
    y = CHAINS["gbk>cp949"].garble(x)
    assert [i for i, _ in M.suspects(weights, [korean(), y])] == [1]
    assert M.repair(weights, "정말 ㅠㅠ 그랬다 ㅠㅠ") is None


def test_frames(spark):
    rows = [(i, f()) for i, f in enumerate([korean, french, chinese] * 60)]
    bad = [(1000 + i, CHAINS["utf8>cp1252"].garble(korean())) for i in range(5)]
    extra = [(2000, None), (2001, ""), (None, bad[0][1]), bad[0]]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows + bad + extra], "doc_id long, text string, restored string, case_kind int")
    got = M.garbled(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in bad] and {r.case_kind for r in got} == {"restorable"}
    assert M.garbled(df.limit(0), "doc_id", "text").count() == 0
