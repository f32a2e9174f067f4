"""The pipelines over the smallest tables: nothing but their gates takes a row away."""

from pyspark.sql import functions as F

from jikjo.functions import text as T
from jikjo.operators import chunking, quality
from jikjo.plans import corpus
from jikjo.sources import catalog as C


def test_training_set_is_of_all_sources(spark, data):
    """As many rows as chunks pass the gate, of every source that has any; each of 128 ids that name its words."""
    chunks = C.union_sources(spark, data).where(F.length("text") >= 50).distinct().select("source", F.posexplode(chunking.routed(F.col("text"), 128)).alias("k", "text"))
    v = quality.vector(chunks.withColumn("row", F.struct("source", "text")), "row", "text").where("quality_score >= 0.6")
    want = {r.s: r["count"] for r in v.groupBy(F.col("row.source").alias("s")).count().collect()}
    rows = corpus.n5_training_set(spark, data).collect()
    got = {s: sum(r.source == s for r in rows) for s in {r.source for r in rows}}
    assert want == got and len(want) > 1
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
    texts = {r.place: r.n for r in corpus.training_chunks(spark, data).select("place", F.size(T.words(F.col("text"))).alias("n")).collect()}
    assert all(len(r.input_ids) == 128 and sum(i > 0 for i in r.input_ids) == min(128, texts[r.place]) for r in rows)


def tables(spark, at, articles, wiki, contexts):
    news = [(i, "train", t, None) for i, t in articles] + [(99, "test", articles[0][1], None)]
    spark.createDataFrame(news, "article_id long, split string, document string, document_list array<string>").write.parquet(f"{at}/naver_news.parquet")
    spark.createDataFrame([(i, "wiki_ko", t) for i, t in wiki], "row_id long, source_name string, text string").write.parquet(f"{at}/raw_text.parquet")
    spark.createDataFrame([(i, "klue_mrc", t) for i, t in contexts], "row_id long, source_name string, context string").write.parquet(f"{at}/qa_context.parquet")


SENTENCE = "학교 도시 시장 나라 회사 은행 경제 정부 사회 문화 역사 그는 기술 산업 과학 교육 환경 건강 음악 영화 여행 음식 신문 방송 선수 경기 대회 결과 그녀는 계획 회의 발표 준비 사업 도서 연구 자료 기관 단체 행사 공연 작품 작가 독자 시민 주민 가족 친구 이웃 마을. "


def test_filtered_texts_of_each_source(spark, tmp_path):
    """A text of each kind that passes its gate is given whole; one without pronouns, a short one and the test split aren't."""
    plain = SENTENCE.replace("그는 ", "").replace("그녀는 ", "")
    long = SENTENCE * 6
    tables(spark, tmp_path, [(1, long), (2, plain * 6), (3, SENTENCE), (4, '123 ' * 300)], [(1, SENTENCE * 4 + "\n\n" + plain * 4), (2, SENTENCE)], [(1, long), (2, plain * 6)])
    got = sorted((r.source, r.id, r.k) for r in corpus.n7_filtered(spark, str(tmp_path)).collect())
    assert got == [("encyclopedia", 1, 0), ("mrc", 1, 0), ("news", 1, 0)]


def test_two_targets_by_triple_gate(spark, tmp_path):
    """No quota; the gate of each kind of source: an encyclopedia's chunk needs two pronouns, a context one."""
    one = SENTENCE.replace("그녀는 ", "")
    tables(spark, tmp_path, [(i, f"{i} " + SENTENCE) for i in range(300)], [(1, one + "\n\n" + SENTENCE)], [(1, one)])
    got = {(r.source, r.target): r.chunks for r in corpus.n8_two_targets(spark, str(tmp_path)).collect()}
    assert got[("naver", 64)] == 300 and got[("wiki", 64)] == 1 and got[("klue", 64)] == 1


def test_routed_chunks_by_source(spark, data):
    """The chunks of every source, against the loop: up to 128 words whole, up to 192 cut, else packed sentences."""
    import re

    from jikjo.functions.text import scan_sentences

    rows = C.union_sources(spark, data).where(F.length("text") >= 50).select("source", "text", scan_sentences(F.col("text")).alias("s")).collect()
    want, most = {}, {}
    for source, text, sentences in rows:
        w = re.findall(r"\S+", text)
        if len(w) <= 192:
            sizes = [min(len(w), 128)]
        else:
            sizes, now = [], 0
            for n in [len(x.split()) for x in sentences]:
                if now and now + n > 128:
                    sizes.append(now)
                    now = 0
                now += n
            sizes = [min(n, 128) for n in [*sizes, now] if n >= 0.3 * 128] or [0]
        want[source] = want.get(source, 0) + len([n for n in sizes if n])
        most[source] = max(most.get(source, 0), *sizes)
    got = {r.source: (r.chunks, r.most_words) for r in corpus.n2_routed_chunks(spark, data).collect()}
    assert set(got) == {s for s in want if want[s]} and all(m <= 128 for _, m in got.values())
    # packing cuts a sentence over the limit apart from its neighbours; elsewhere the counts are the loop's
    assert all(abs(got[s][0] - want[s]) <= 0.1 * want[s] + 1 for s in got)


def test_quality_of_the_training_set(spark, data):
    (m,) = corpus.n5_quality(spark, data).collect()
    rows = corpus.training_chunks(spark, data).where("place <= 100").collect()
    mean = sum(r.quality_score for r in rows) / len(rows)
    assert len(rows) == 100 and abs(m.quality_score - mean) < 1e-9
    assert m.tier == ("high" if mean > 0.8 else "good" if mean > 0.6 else "low")


def test_domain_texts(spark, data):
    """Every chunk of the texts within bounds, and of a kind with more than the limit so many, better ones more often."""
    from jikjo.plans import builds

    every = builds.domain_texts(spark, data, 128, 10**9).collect()
    texts = builds.long_texts(spark, data).distinct().select("kind", "id", F.size(T.words(F.col("text"))).alias("n")).collect()
    bounds = {(r.kind, r.id) for r in texts if 51 <= r.n <= 230}
    assert {(r.kind, r.id) for r in every} <= bounds and len({r.kind for r in every}) >= 4
    some = builds.domain_texts(spark, data, 128, 40).collect()
    for kind in {r.kind for r in every}:
        mine, whole = [r for r in some if r.kind == kind], [r for r in every if r.kind == kind]
        assert len(mine) == min(40, len(whole)) and set(mine) <= set(whole)
        if len(whole) > 120:
            assert sum(r.coref_score for r in mine) / len(mine) >= sum(r.coref_score for r in whole) / len(whole) - 0.02


def test_gated_rows_fall_back_to_all(spark):
    from jikjo.plans import builds

    plain = SENTENCE.replace("그는 ", "").replace("그녀는 ", "")
    df = spark.createDataFrame([(1, SENTENCE), (2, plain), (3, SENTENCE)], "k long, t string")
    assert sorted(r.k for r in builds.gated_rows(df, "k", "t").collect()) == [1, 3]
    assert sorted(r.k for r in builds.gated_rows(df.where("k = 2"), "k", "t").collect()) == [2]
    assert builds.gated_rows(df.where("k > 9"), "k", "t").count() == 0


def test_pronouns_with_the_nouns_around(spark):
    from jikjo.operators import mining

    text = "학교에 도시가 있다. 그는 시장을 봤다. 은행이 나라에 있다. 그녀는 갔다. 끝이다."
    (a, b) = sorted(mining.pronoun_context(spark.createDataFrame([(1, text), (2, "그는 갔다."), (3, None)], "k long, t string"), "k", "t").collect(), key=lambda r: r.coref_pos)
    assert (a.k, a.coref_pos) == (1, text.index("그는")) and a.masked.count("[MASK]") == 1
    assert {"학교", "도시", "시장", "은행", "나라"} <= set(a.context_nouns)
    assert b.coref_pos == text.index("그녀") and "학교" not in b.context_nouns and {"은행", "나라"} <= set(b.context_nouns)
