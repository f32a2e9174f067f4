"""Mining of repeated entities: repetition maps, masked examples, evaluation sets.

Tagging and grouping within a document happen in one Arrow pass over its row: no
shuffle.  Only the cap over all documents needs one, and Spark limits each group
before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jikjo.functions.lexicon import ENTITY_STOP, MASK
from jikjo.functions.tagger import tagged
from jikjo.operators.ordering import heads


def repetitions(df: DataFrame, key: str, text: str, tags: tuple[str, ...] = ("NNP",), stop: list[str] = ENTITY_STOP, without_pronouns: bool = False) -> DataFrame:
    """key, entity, entity_order, positions: words of those tags, two characters or more, that occur at least twice in a text.

    ``positions`` ascend; ``entity_order`` is the order of first occurrence.
    ``without_pronouns``: a text with a pronoun gives nothing.  Null and empty texts
    give nothing.
    """
    kind = dict(df.dtypes)[key]
    never = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names, orders, places = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                tokens = tagged(x or "")
                if without_pronouns and any(t == "NP" for _, t, _, _ in tokens):
                    continue
                found: dict[str, list[int]] = {}
                for f, t, s, n in tokens:
                    if t in tags and n >= 2 and f not in never:
                        found.setdefault(f, []).append(s)
                for o, (f, p) in enumerate((f, p) for f, p in found.items() if len(p) >= 2):
                    at.append(i)
                    names.append(f)
                    orders.append(o)
                    places.append(p)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(orders, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                [key, "entity", "entity_order", "positions"],
            )

    rows = df.select(key, text).where(F.col(text).isNotNull())
    return rows.mapInArrow(run, f"`{key}` {kind}, entity string, entity_order int, positions array<int>")


def examples(found: DataFrame, key: str, least: int = 10, most: int = 2000, spans: int = 3) -> DataFrame:
    """One row for each of the second to fourth occurrence at a distance from the first within bounds."""
    each = found.select(key, "entity", "entity_order", F.col("positions")[0].alias("antecedent_pos"), F.explode(F.slice("positions", 2, spans)).alias("coref_pos"))
    return each.withColumn("distance", F.col("coref_pos") - F.col("antecedent_pos")).where(F.col("distance").between(least, most))


def capped(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """At most ``cap`` examples of one entity: the earliest by key, order in the text, position."""
    return heads(rows, ["entity"], [F.col(key), F.col("entity_order"), F.col("coref_pos")], cap)


def masked(rows: DataFrame, texts: DataFrame, key: str, text: str, mask: str = MASK) -> DataFrame:
    """The text with the later mention masked; joined by key, so no text is moved for a row that has none."""
    both = rows.join(texts.select(key, text), key)
    x, n = F.col(text), F.length("entity")
    return both.withColumn("masked", F.concat(F.substring(x, F.lit(1), F.col("coref_pos")), F.lit(mask), F.substring(x, F.col("coref_pos") + n + 1, F.length(x))))


def evaluation_set(df: DataFrame, key: str, source: str, text: str, per_text: int = 3, quota: int = 800) -> DataFrame:
    """Second occurrences of repeated nouns in texts without pronouns: at most so many of a text, then of a source."""
    tied = df.where(F.length(text) >= 100).select(F.struct(key, source).alias("row"), text)
    found = repetitions(tied, "row", text, ("NNP", "NNG"), [], True)
    picked = found.where(F.col("entity_order") < per_text).select("row.*", "entity", "entity_order", F.col("positions")[1].alias("coref_pos"))
    return heads(picked, [source], [F.col(key), F.col("entity_order")], quota)


def first_pronoun(df: DataFrame, key: str, text: str, mask: str = MASK) -> DataFrame:
    """key, masked, pronoun: the first pronoun of each text masked; texts without one give no row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, words = [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                hit = next(((f, s, n) for f, t, s, n in tagged(x) if t == "NP"), None)
                if hit:
                    at.append(i)
                    words.append(hit[0])
                    out.append(x[: hit[1]] + mask + x[hit[1] + hit[2] :])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(words, pa.string())], [key, "masked", "pronoun"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, masked string, pronoun string")


def pronoun_context(df: DataFrame, key: str, text: str, radius: int = 1, per_text: int = 3, least: int = 2, mask: str = MASK) -> DataFrame:
    """key, coref_pos, masked, context_nouns: pronouns with the nouns of their sentence and ``radius`` sentences on either side.

    At most ``per_text`` of a text, the first ones; a pronoun with fewer than ``least``
    different nouns around it gives no row.
    """
    import re

    kind = dict(df.dtypes)[key]
    cut = re.compile(r"[.!?。！？]\s*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, places, out, nouns = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                ends = [m.end() for m in cut.finditer(x)]
                tokens, given, k, owner = tagged(x), 0, 0, []
                for _, _, s, _ in tokens:
                    while k < len(ends) and ends[k] <= s:
                        k += 1
                    owner.append(k)
                by: dict[int, list[str]] = {}
                for (f, t, _, n), o in zip(tokens, owner):
                    if t in ("NNG", "NNP") and n >= 2:
                        by.setdefault(o, []).append(f)
                for (f, t, s, n), o in zip(tokens, owner):
                    if t != "NP" or given >= per_text:
                        continue
                    around = sorted({w for q in range(o - radius, o + radius + 1) for w in by.get(q, ())})
                    if len(around) >= least:
                        at.append(i)
                        places.append(s)
                        out.append(x[:s] + mask + x[s + n :])
                        nouns.append(around)
                        given += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(out, pa.string()), pa.array(nouns, pa.list_(pa.string()))],
                [key, "coref_pos", "masked", "context_nouns"],
            )

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, coref_pos int, masked string, context_nouns array<string>")
