"""Word ids by frequency: texts to ids and back.  The vocabulary may be of any size, so it is joined, never broadcast by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jikjo.operators.ordering import numbered


def vocabulary(rows: DataFrame, words: Column) -> DataFrame:
    """w, id: 1 for the most frequent word; equally frequent ones in the order of the word."""
    counts = rows.select(F.explode(words).alias("w")).groupBy("w").agg((-F.count("*")).alias("m"))
    return numbered(counts, ["m", "w"], "id").select("w", "id")


def _looked_up(rows: DataFrame, key: list[str], items: Column, vocab: DataFrame, of: str, to: str, name: str) -> DataFrame:
    each = rows.select(*key, F.posexplode_outer(items).alias("__k", of)).join(vocab, of, "left")
    placed = F.array_sort(F.collect_set(F.when(F.col("__k").isNotNull(), F.struct("__k", to))))
    return each.groupBy(*key).agg(F.transform(placed, lambda x: x[to]).alias(name))


def encoded(rows: DataFrame, key: list[str], words: Column, vocab: DataFrame) -> DataFrame:
    """key, ids: the id of every word in its place, none for a text without words.  Rows of one key must be copies."""
    return _looked_up(rows, key, words, vocab, "w", "id", "ids")


def decoded(rows: DataFrame, key: list[str], ids: Column, vocab: DataFrame) -> DataFrame:
    """key, text: the words of all ids, by single spaces; ids that the vocabulary lacks (padding) are left out."""
    known = _looked_up(rows, key, ids, vocab, "id", "w", "__w")
    return known.select(*key, F.array_join("__w", " ").alias("text"))
