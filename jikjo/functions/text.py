"""Text functions as Column expressions: all run inside the JVM, none is a UDF.

A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (trim() knows only U+0020), in a form that Java and RE2 both read.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"
#: A sentence by scanning: up to an end mark, once the piece is longer than 10 characters; the rest.
SCAN_SENTENCE = r"(?s).{10,}?[.!?]|.+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def count_of(x: Column, part: str) -> Column:
    """How often ``part`` occurs, occurrences not overlapping."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def count_any(x: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_of(x, p) for p in parts])


def share_of(x: Column, pattern: str) -> Column:
    """Matches of the pattern by characters of the text; null for an empty text."""
    return F.when(F.length(x) > 0, F.regexp_count(x, F.lit(pattern)) / F.length(x))


def words(x: Column) -> Column:
    """Words between white space; an array, empty for a blank text."""
    return F.filter(F.split(x, rf"{SPACE}+"), lambda w: w != "")


def scan_sentences(x: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(SCAN_SENTENCE), F.lit(0)), strip), lambda s: s != "")


def mark_sentences(x: Column) -> Column:
    """Cut at white space that follows an end mark."""
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")


def paragraphs(x: Column, separator: str = r"\n\n") -> Column:
    return F.filter(F.transform(F.split(x, separator), strip), lambda p: p != "")


def clean_token(x: Column) -> Column:
    return strip(F.replace(x, F.lit("##"), F.lit("")))


def attach_particle(noun: Column, pair: Column) -> Column:
    """The form of a particle pair that fits the noun's last syllable; any other particle as it is."""
    last = F.pmod(F.ascii(F.right(noun, F.lit(1))) - 0xAC00, F.lit(28)) != 0
    fit = (
        F.when(pair == "을/를", F.when(last, "을").otherwise("를"))
        .when(pair == "은/는", F.when(last, "은").otherwise("는"))
        .when(pair == "이/가", F.when(last, "이").otherwise("가"))
        .otherwise(pair)
    )
    return F.concat(noun, F.when(F.length(noun) > 0, fit).otherwise(pair))


def mask_word(x: Column, target: Column, mask: str) -> Column:
    """The target replaced at the text's end, else at its first place, else the mask appended."""
    s = strip(x)
    cut = F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(target)), F.lit(mask))
    at = F.instr(s, target)
    first = F.concat(F.substring(s, F.lit(1), at - 1), F.lit(mask), F.substring(s, at + F.length(target), F.length(s)))
    return F.when(F.endswith(s, target), cut).when(F.contains(s, target), first).otherwise(F.concat(s, F.lit(" " + mask)))


def clip_around(x: Column, mask: str, left: int, right: int) -> Column:
    """So many characters on either side of the mask; the text as it is without one."""
    at = F.instr(x, F.lit(mask))
    begin = F.greatest(F.lit(0), at - 1 - left)
    end = F.least(F.length(x), at - 1 + len(mask) + right)
    return F.when(at > 0, F.substring(x, begin + 1, end - begin)).otherwise(x)


def truncate_around(x: Column, mask: str, size: int) -> Column:
    """``size`` words around the word that holds the mask, half on either side, moved inwards at an end; null without a mask."""
    w = words(x)
    at = F.array_position(F.transform(w, lambda v: F.contains(v, F.lit(mask))), F.lit(True)).cast("int")
    begin = F.greatest(F.lit(1), F.least(at - size // 2, F.size(w) - (size - 1)))
    return F.when(at > 0, F.array_join(F.slice(w, begin, F.lit(size)), " "))


def flattened(nested: Column) -> Column:
    """Predictions as one list, whether they come nested by mask or flat."""
    return F.flatten(nested)


def padded(ids: Column, size: int, pad: int = 0) -> Column:
    """Exactly ``size`` entries: cut, or filled with ``pad``."""
    return F.concat(F.slice(ids, 1, size), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(ids))))


def fixed(x: Column, digits: int = 4) -> Column:
    """So many digits after the point, rounded by the exact binary value (format_string would round its decimal form)."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
