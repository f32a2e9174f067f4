from pyspark.sql import functions as F

from jikjo.functions import text as T
from jikjo.operators import vocabulary as V
from jikjo.plans import corpus


def fixture(spark, tmp_path):
    late = " ".join(f"w{i % 7}" for i in range(400)) + " last"
    rows = [(1, late), (2, "last  one"), (3, ""), (4, "w1 w1 last"), (4, "w1 w1 last"), (4, "other"), (5, None), (None, "last w1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return late


def test_words_of_whole_texts_count(spark, tmp_path):
    """A word that stands only after the tenth word of a text counts too."""
    fixture(spark, tmp_path)
    got = {r.w: (r.id, r.n_docs) for r in corpus.f16_word_documents(spark, str(tmp_path)).collect()}
    assert got["last"][1] == 3 and got["w6"][1] == 1 and got["w1"] == (1, 2)
    assert sorted(i for i, _ in got.values()) == list(range(1, len(got) + 1))


def test_ids_decode_to_whole_texts(spark, tmp_path):
    late = fixture(spark, tmp_path)
    got = sorted(((r.doc_id or 0), r.text) for r in corpus.f16_decoded(spark, str(tmp_path)).collect())
    assert got == sorted([(0, "last w1"), (1, late), (2, "last one"), (3, ""), (4, "w1 w1 last"), (4, "other")])


def test_padding_is_skipped(spark):
    rows = spark.createDataFrame([(1, "a b a")], "k long, t string")
    vocab = V.vocabulary(rows, T.words(F.col("t")))
    ids = V.encoded(rows, ["k"], T.words(F.col("t")), vocab)
    assert ids.first().ids == [1, 2, 1]
    assert V.decoded(ids, ["k"], T.padded(F.col("ids"), 6), vocab).first().text == "a b a"
