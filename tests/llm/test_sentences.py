import pytest

from jikjo.llm import sentences as S

CASES = [
    ("첫 문장이다. 둘째 문장이다!", ["첫 문장이다.", "둘째 문장이다!"]),
    ("값은 3.14배다. Dr. 김은 No. 7을 봤다.", ["값은 3.14배다.", "Dr. 김은 No. 7을 봤다."]),
    ("그는 “간다. 온다.”라고 말했다. 끝이다.", ["그는 “간다. 온다.”라고 말했다.", "끝이다."]),
    ("“혼자 선 말이다.” 다음 문장이다.", ["“혼자 선 말이다.”", "다음 문장이다."]),
    ("(앞서 정했다.) 또 정했다.", ["(앞서 정했다.)", "또 정했다."]),
    ("표시 없이 끝났습니다 다음도 끝났습니다", ["표시 없이 끝났습니다", "다음도 끝났습니다"]),
    ("2024. 2. 11. 전망을 말했다. 끝", ["2024. 2. 11. 전망을 말했다.", "끝"]),
    ("他说：“走吧。快走。”然后走了。真的？", ["他说：“走吧。快走。”然后走了。", "真的？"]),
    ("「遅い。急げ。」と言った。終わり…次", ["「遅い。急げ。」と言った。", "終わり…", "次"]),
    ("डॉ. राम आया। वह गया।", ["डॉ. राम आया।", "वह गया।"]),
    ("เขาไปบ้าน เธอมา", ["เขาไปบ้าน", "เธอมา"]),
    ("He paid $1.30 million, e.g. twice. “Why?” asked Mr. Fox. U.S. law", ["He paid $1.30 million, e.g. twice.", "“Why?” asked Mr. Fox.", "U.S. law"]),
    ("Am 3. Mai kam er, z. B. spät. „Ja. Gut“, sagte sie.", ["Am 3. Mai kam er, z. B. spät.", "„Ja. Gut“, sagte sie."]),
    ("줄이\n바뀌면 끝\r\n\r\n  또  ", ["줄이", "바뀌면 끝", "또"]),
    ("파일 a_v1.2.txt를 올렸다.바로 이어졌다.", ["파일 a_v1.2.txt를 올렸다.", "바로 이어졌다."]),
    ("“닫히지 않은 말\n다음 줄.", ["“닫히지 않은 말", "다음 줄."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in S.direct(text)] == want


def test_chunks_compose_to_the_direct_run(spark, data):
    texts = [t for t, _ in CASES] + [" ".join(t for t, _ in CASES) * 3, "가" * 5000, "? " * 4000, " " * 3000 + "끝.", "“" + "말이다. " * 900, "끝." + " " * 300 + "다음 말", ("했다" + " " * 80 + "ㅋㅋ ") * 60, "!?" * 2000, "가나다라마바사아" * 500 + "했다. 끝"]
    texts += [r.text for r in spark.read.parquet(f"{data}/raw_text.parquet").where("text is not null").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for chunk in (150, 1000):
        got = {}
        for r in S.sentences(df, "x", "k", "t", chunk=chunk).collect():
            got.setdefault(r.rec_id, []).append((r.start_pos, r.end_pos))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == S.direct(t), (chunk, i, t[:80])


def test_deliveries_that_differ_are_not_mixed(spark):
    rows = [(1, "하나다. 둘이다. 셋이다."), (1, "넷. 다섯이다. " * 200), (1, "하나다. 둘이다. 셋이다.")]
    got = sorted((r.start_pos, r.end_pos) for r in S.sentences(spark.createDataFrame(rows, "k long, t string"), "x", "k", "t", chunk=100).collect())
    assert got in (S.direct(rows[0][1]), S.direct(rows[1][1]))


def test_a_text_of_a_million_characters(spark):
    text = ("그는 “간다. 온다.”라고 말했다. 값은 3.14배다. (앞서 정했다.) " * 30_000).strip()
    df = spark.createDataFrame([(1, text)], "k long, t string")
    got = [sorted((r.start_pos, r.end_pos) for r in S.sentences(df, "x", "k", "t", chunk=n).collect()) for n in (20_000, 200_000)]
    assert got[0] == got[1] == S.direct(text)


def test_odd_rows(spark):
    rows = [(1, "하나. 둘."), (1, "하나. 둘."), (2, None), (3, "  \n "), (None, "셋."), (4, "")]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "k long, t string, start_pos int, text string")
    got = sorted((r.rec_id, r.start_pos, r.end_pos) for r in S.sentences(df, "x", "k", "t").collect())
    assert got == [(1, 0, 3), (1, 4, 6)]
    assert S.sentences(spark.createDataFrame([], "k long, t string"), "x", "k", "t").count() == 0
