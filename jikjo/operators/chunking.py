"""Chunks of texts: every fold is an aggregate() over an array in the JVM.

A fold sees the sizes of the units only.  Its state is where the open chunk begins, how
large it is, and the bounds of the finished ones: numbers, so that no text is copied
from step to step.  The texts of the chunks are slices of the units.

Sizes are in words unless the array holds something else: ``units`` says how a text
is cut into the units that are counted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jikjo.functions import text as T


def _size(x: Column) -> Column:
    return F.size(T.words(x))


def _packed(sizes: Column, step, last) -> Column:
    """Bounds (a, b) of chunks of units a .. b - 1.

    ``step(s, n)`` is the struct that follows state ``s`` (cuts, a, i, n) when unit
    ``s.i`` of size ``n`` comes, ``last(s)`` whether the chunk open at the end is given.
    """
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(none.alias("cuts"), F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("n"))
    return F.aggregate(sizes, start, step, lambda s: F.when(last(s), F.concat(s["cuts"], _cut(s["a"], s["i"]))).otherwise(s["cuts"]))


def _cut(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.alias("a"), b.alias("b")))


def _state(cuts: Column, a: Column, i: Column, n: Column) -> Column:
    return F.struct(cuts.alias("cuts"), a.alias("a"), (i + 1).alias("i"), n.alias("n"))


def _over(units: Column, size, step, last, text) -> Column:
    """The texts of chunks: ``text(units, a, b)`` for each pair of bounds; the units are computed once."""
    return _once(units, lambda u: F.transform(_packed(F.transform(u, size), step, last), lambda c: text(u, c["a"], c["b"])))


def _joined(u: Column, a: Column, b: Column, by: str = " ") -> Column:
    return F.array_join(F.slice(u, a + 1, b - a), by)


def greedy(sentences: Column, limit: int, least: float = 0.3) -> Column:
    """Sentences packed up to ``limit`` words: array<string>.

    A chunk is given if it has over least * limit words.  A longer sentence closes the
    open chunk and is cut to the limit.  Words keep single spaces between sentences.
    """
    floor = F.lit(least * limit)

    def given(s: Column) -> Column:
        return (s["a"] < s["i"]) & (s["n"] > floor)

    def step(s: Column, n: Column) -> Column:
        i = s["i"]
        flushed = F.when(given(s), F.concat(s["cuts"], _cut(s["a"], i))).otherwise(s["cuts"])
        long = _state(F.concat(flushed, _cut(i, i + 1)), i + 1, i, F.lit(0))
        return F.when(n > limit, long).when((s["n"] + n > limit) & (s["a"] < i), _state(flushed, i, i, n)).otherwise(_state(s["cuts"], s["a"], i, s["n"] + n))

    def text(u: Column, a: Column, b: Column) -> Column:
        w = T.words(F.get(u, a))
        return F.when((b - a == 1) & (F.size(w) > limit), F.array_join(F.slice(w, 1, limit), " ")).otherwise(T.strip(_joined(u, a, b)))

    return _over(sentences, _size, step, given, text)


def loose(sentences: Column, limit: int, least: float = 0.6) -> Column:
    """As ``greedy`` but a long sentence isn't cut: a chunk may pass the limit."""
    floor = F.lit(least * limit)

    def given(s: Column) -> Column:
        return (s["a"] < s["i"]) & (s["n"] >= floor)

    def step(s: Column, n: Column) -> Column:
        i = s["i"]
        flushed = F.when(given(s), F.concat(s["cuts"], _cut(s["a"], i))).otherwise(s["cuts"])
        return F.when((s["n"] + n > limit) & (s["a"] < i), _state(flushed, i, i, n)).otherwise(_state(s["cuts"], s["a"], i, s["n"] + n))

    return _over(sentences, _size, step, given, lambda u, a, b: T.strip(_joined(u, a, b)))


def windows(units: Column, size: int, overlap: int, least: float = 0.7) -> Column:
    """Windows of ``size`` units that overlap; a last one under least * size is dropped: array<array>."""
    starts = F.when(F.size(units) > 0, F.sequence(F.lit(0), F.size(units) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.slice(units, i + 1, size)), lambda w: F.size(w) >= int(least * size))


def sliding(sentences: Column, target: int, least: float = 0.7, step: int = 1) -> Column:
    """From each ``step``-th sentence on, whole sentences until ``target`` words: the first ``target`` of them, if least * target are reached."""
    sizes = F.transform(sentences, _size)
    at = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    every = F.flatten(F.transform(sentences, T.words))
    starts = F.when(F.size(sentences) > 0, F.sequence(F.lit(0), F.size(sentences) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    bound = F.struct(at.alias("at"), every.alias("every"), starts.alias("starts"))
    cut = _once(bound, lambda v: F.transform(v["starts"], lambda i: F.slice(v["every"], F.get(v["at"], i) + 1, target)))
    return F.filter(cut, lambda w: F.size(w) >= int(least * target))


def _once(value: Column, f) -> Column:
    """f(value) with the value computed once, however often a lambda within f reads it."""
    return F.transform(F.array(value), f)[0]


def segments(parts: Column, target: int, least: float = 0.7) -> Column:
    """Segments packed whole: a chunk ends before the segment that would pass the target, and is cut to it: array<string>."""
    floor = int(least * target)

    def given(s: Column) -> Column:
        return (s["n"] > 0) & (s["n"] >= floor)

    def step(s: Column, n: Column) -> Column:
        i = s["i"]
        flushed = F.when(given(s), F.concat(s["cuts"], _cut(s["a"], i))).otherwise(s["cuts"])
        more = _state(s["cuts"], F.when(s["n"] == 0, i).otherwise(s["a"]), i, s["n"] + n)
        return F.when((s["n"] > 0) & (s["n"] + n > target), _state(flushed, i, i, n)).otherwise(more)

    return _over(parts, _size, step, given, lambda u, a, b: F.array_join(F.slice(T.words(_joined(u, a, b)), 1, target), " "))


def merged_paragraphs(parts: Column, least: int, most: int, joiner: str = "\n\n") -> Column:
    """Short paragraphs joined to the next until ``least`` characters; those over ``most`` dropped; the last needs both bounds."""

    def step(s: Column, n: Column) -> Column:
        i = s["i"]
        kept = F.when(s["n"] <= most, F.concat(s["cuts"], _cut(s["a"], i))).otherwise(s["cuts"])
        joined = _state(s["cuts"], s["a"], i, s["n"] + len(joiner) + n)
        return F.when(s["n"] == 0, _state(s["cuts"], i, i, n)).when(s["n"] < least, joined).otherwise(_state(kept, i, i, n))

    return _over(parts, F.length, step, lambda s: s["n"].between(least, most), lambda u, a, b: _joined(u, a, b, joiner))


def routed(text: Column, limit: int, truncate: float = 1.5, least: float = 0.3) -> Column:
    """Texts up to the limit as they are, somewhat longer ones cut, much longer ones chunked: array<string>."""
    w = T.words(text)
    return (
        F.when(F.size(w) <= limit, F.array(text))
        .when(F.size(w) <= truncate * limit, F.array(F.array_join(F.slice(w, 1, limit), " ")))
        .otherwise(greedy(T.scan_sentences(text), limit, least))
    )
