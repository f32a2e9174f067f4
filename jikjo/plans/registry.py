"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jikjo.functions import lexicon as L
from jikjo.functions import tagger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- pieces of SQL -----------------------------------------------------------------

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = tagger.WORD


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def names(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def stem(w: str) -> str:
    return f"regexp_replace({w}, '{tagger.PARTICLE}', '')"


def tag(w: str) -> str:
    s = stem(w)
    return (
        f"case when {w} in ({names(L.TAGGER_PRONOUNS)}) or {s} in ({names(L.TAGGER_PRONOUNS)}) then 'NP' when regexp_matches({w}, '^[0-9]') then 'SN' "
        f"when {w} in ({names(L.TAGGER_ADVERBS)}) then 'MAG' when regexp_matches({s}, '{tagger.NAME}') then 'NNP' when regexp_matches({w}, '{tagger.VERB}') then 'VV' else 'NNG' end"
    )


def form(w: str) -> str:
    return f"case when {tag(w)} in ('VV', 'SN', 'MAG') or {stem(w)} = '' or {w} in ({names(L.TAGGER_PRONOUNS)}) then {w} else {stem(w)} end"


def tokens(source: str, key: str, text: str = "text", also: str = "") -> str:
    """A relation of key, form, tag of every word."""
    return f"(select {key}{also}, {form('w')} as form, {tag('w')} as tag from (select {key}{also}, unnest(regexp_extract_all({text}, '{W}')) as w from {source}))"


def placed(source: str, key: str, text: str = "text") -> str:
    """The same with the place i of the word and its start."""
    return f"""(select {key}, i, {form('w')} as form, {tag('w')} as tag,
      cast(sum(length(g)) over (partition by {key} order by i) + sum(length(w)) over (partition by {key} order by i) - length(w) as int) as start
    from (select {key}, unnest(ws) as w, unnest(gs) as g, unnest(range(1, len(ws) + 1)) as i
          from (select {key}, regexp_extract_all({text}, '{W}') as ws, regexp_split_to_array({text}, '{W}') as gs from {source})) where w is not null)"""


def count_of(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, '{part}', ''))) // {len(part)})"


def count_any(x: str, parts: list[str]) -> str:
    return "(" + " + ".join(count_of(x, p) for p in parts) + ")"
