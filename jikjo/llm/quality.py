"""Per-document text statistics, and text types by weak supervision.

The statistics of a line are its words, their mean length, its share of symbols and of
digits, whether it ends in punctuation, its share of common words, and its surprise: the
bits a character costs given the one before, by the counts of all texts.  Thresholds on
them, several for each, and a few shapes (bullets, cells, code) are labelling functions
that vote for one type (prose, list, table, junk) or abstain.  How often each function
votes given the true type isn't set by hand: it is learned by expectation-maximization
from how the functions agree over all lines of all texts (the Dawid-Skene model).  The
sufficient statistic is the count of each vote pattern, so EM runs on a small table.
Each line then has a posterior over types; a text's type shares are those of its
characters, and its statistics are sums over the same lines.

One Arrow pass counts characters and pairs of them (combined in each task); a second
computes votes and statistics and is stored; EM reads the pattern counts; a last, light
pass turns patterns into shares.  There is no shuffle of texts.  Null and blank texts
have no lines: statistics 0, type null, never list, table or junk.  Other columns are
ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jikjo.functions.codepoints import codes, slices
from jikjo.storage import stored

TYPES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)

# --- fixed values ------------------------------------------------------------------
#: Common words by which running text is told: whole words, and Korean word endings (particles and predicate endings).
COMMON = frozenset(
    "the of and to in a that is was for it on as with his he be at by had not are but from or have an they which one were she there their we him been has when who will more no if out so said "
    "der die das und ist den von zu mit auf für im dem nicht ein eine als auch es an er hat aus bei nach wie vor sie wurde weil war "
    "le la les de des et est à en un une que qui du dans pour sur au avec par il elle a été dit près "
    "이 그 저 것 수 등 및 더 또 또한 그리고 그러나 하지만 한편 지난 이를 그는 그녀는 우리는 그들은 위해 때문에 대한 다시 함께 이미 아직 모두 "
    "में का की के को से ने है था और पर यह कर नया".split()
)
_ENDING = re.compile(r"[가-힣](?:을|를|은|는|이|가|의|에|에서|에게|와|과|도|로|으로|고|며|면서|지만|려고|다|요|까|자|라며|라고|한|된|던|인)[.,!?…]*(?=\s|$)")
# -----------------------------------------------------------------------------------

_STOP = re.compile(r"(?<![.!?。！？…।॥])[.!?。！？…।॥]++[\"'”’)」』»）》]*\s*(?:[ㅋㅎㅠㅜ~]+|[\U0001F300-\U0001FAFF])?$")
_PREDICATE = re.compile(r"(?:니다|[어아해예에]요|[했였았었겠한된됐졌]다|는가|인가|이야)(?=[\s.,!?~…]|$)")
_BULLET = re.compile(r"^\s*(?:[-*•·▶▷○●■□◆◇➤►※✓☆–—+>]|\(?[0-9]{1,3}[.)]|\([0-9a-zA-Z가-하]\)|제[0-9]+[항조호]|[a-zA-Z가-하][.)]|[ⅰ-ⅻⅠ-Ⅻ①-⑳])\s+\S")
_LEADER = re.compile(r"(?:(?<!\.)\.{4,}+|(?<!·)·{4,}+|(?<!…)…{2,}+)\s*+\d++\s*$")
_CELLS = re.compile(r"[|\t]")
_CSV = re.compile(r"^[^,\s]{1,20}(?:,[^,\n]{1,40}){3,}$")
_PAIR = re.compile(r"^[^:\s]{1,15}(?: [^:\s]{1,12})?\s*[:=]\s*[^\s:]{1,20}$")
_STAMP = re.compile(r"^\W{0,2}\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|^\d{1,2}:\d{2}\s")
_CODE = re.compile(r"[;{}]\s*$|\w\([^()]{0,80}[\[\]=<>*+][^()]{0,80}\)|=>|</?\w{1,20}[^<>]{0,200}>|^\s*(?:def|for|if|let|return|var|int|class|import|while)\s\w+[_(\[]")
_REPEAT = re.compile(r"([^\s\w.?�·…])\1{4,}|([ㄱ-ㆎ])\2{7,}")
_NOISE = re.compile(r"[가-힣][&@#%^*]+(?=[가-힣])|[가-힣][ㄱ-ㆎ](?![ㄱ-ㆎ\s])|(?<![ㄱ-ㆎ가-힣])[ㄱ-ㆎ][가-힣]|[가-힣][ㄱ-ㆎ](?=\s|$)")
_MENU = re.compile(r"(?:\s[|>·»/]\s|\s{2,}|\s#)")
_NOISE_SIGN = re.compile(r"[ㄱ-ㆎ&@#%^*]")
_CODE_SIGN = re.compile(r"[;{}(=<_\[]")
_MENU_SIGN = re.compile(r"[|>·»/#]")
_TAGS = re.compile(r"(?:^|\s)#\S+")
_OTHER_SCRIPT = re.compile(r"[ぁ-ヿ一-鿿ऀ-ॿ฀-๿Ѐ-ӿ؀-ۿ]")
_GARBLED = re.compile(r"[À-ÿ\x80-\xa0�]|[?�]{2,}|[㐀-鿿][㐀-鿿]|[‚-…‰‹›ŒœŠšŽžŸ]")
_DIGIT = re.compile(r"\d")
_SYMBOL = regex.compile(r"[\p{P}\p{S}]")
_HANGUL = re.compile(r"[가-힣]")
_BREAK = re.compile(r"[\r\n]+")


#: The labelling functions in the order of their bits: the type each votes for, and what it looks at.
FUNCTIONS: list[tuple[int, str]] = [
    # thresholds on statistics
    (PROSE, "ends in punctuation"),
    (PROSE, "common words 1/3"),
    (PROSE, "common words 1/7 of 6 or more"),
    (PROSE, "10 words, few symbols and digits"),
    (PROSE, "24 characters of little surprise, few symbols and digits"),
    (PROSE, "text ends most lines in punctuation, or two lines around do"),
    (LIST, "16 characters at most, no end mark"),
    (LIST, "3 words at most in a text whose lines end without marks"),
    (TABLE, "digits 3/10, or a name and a value"),
    (TABLE, "digits 3/20 and symbols 3/20"),
    (JUNK, "symbols 2/5"),
    (JUNK, "mean word of 25 letters and digits"),
    (JUNK, "7 bits of surprise"),
    (JUNK, "6 bits of surprise, no common word"),
    (JUNK, "words said again and again"),
    # shapes
    (PROSE, "Korean predicate"),
    (PROSE, "another script"),
    (PROSE, "wrong encoding 1/5"),
    (PROSE, "wrong encoding 2/5 of 24 characters, few digits"),
    (PROSE, "goes on from the line before"),
    (PROSE, "letters without a shape"),
    (LIST, "bullet"),
    (LIST, "dots to a number"),
    (LIST, "menu"),
    (TABLE, "cells"),
    (TABLE, "time stamp"),
    (JUNK, "code"),
    (JUNK, "sign repeated"),
    (JUNK, "syllables and signs mixed"),
    (JUNK, "tags"),
]
LABELS = [kind for kind, _ in FUNCTIONS]


@dataclass
class Line:
    """The statistics of one line."""

    text: str
    words: list[str]
    letters: int
    digits: int
    symbols: int
    common: int
    stop: bool
    leader: bool
    predicate: bool

    @classmethod
    def of(cls, s: str) -> Line:
        words = s.split()
        digits = len(_DIGIT.findall(s))
        symbols = len(_SYMBOL.findall(s))
        letters = sum(map(len, words)) - digits - symbols  # with the marks that combine with them
        leader = ("..." in s or "··" in s or "……" in s) and bool(_LEADER.search(s))
        stop = bool(_STOP.search(s)) and not leader
        return cls(s, words, letters, digits, symbols, _function_words(s, words), stop, leader, bool(_PREDICATE.search(s)))


def votes(x: Line, surprise: float, near_prose: bool, before_open: bool, unmarked: bool) -> int:
    """The vote pattern of one line, a bit for each of FUNCTIONS.

    ``near_prose``: a sentence ends within two lines of it, or most lines of the text do;
    ``before_open``: the line before breaks off inside a sentence; ``unmarked``: few lines
    of the text end in a mark.
    """
    s, words, stop = x.text, x.words, x.stop
    n = len(s)
    longest = max(map(len, words), default=0)
    spaced = n - sum(map(len, words)) >= len(words)  # two spaces together somewhere
    # a cheap look for a character that must be there comes before each longer pattern
    foreign = 0 if not _OTHER_SCRIPT.search(s) else len(_OTHER_SCRIPT.findall(s))
    garbled = 0 if not _GARBLED.search(s) else len("".join(_GARBLED.findall(s)))
    noise = bool(_NOISE_SIGN.search(s)) and len(_NOISE.findall(s)) >= 2
    repeat = longest >= 5 and bool(_REPEAT.search(s))
    code = bool(_CODE_SIGN.search(s)) and bool(_CODE.search(s))
    bullet = bool(_BULLET.match(s))
    menu = not stop and (spaced or bool(_MENU_SIGN.search(s))) and len(_MENU.findall(s)) >= 3
    spam = len(words) >= 12 and not stop and len(set(words)) <= 0.6 * len(words) and garbled < 0.2 * n
    odd = foreign >= 0.5 * n or garbled >= 0.2 * n
    long_word = sum(map(len, words)) >= 25 * len(words) and n >= 25 and x.digits >= 2 and x.letters + x.digits >= 0.9 * n and s.isascii()
    reads = x.letters + garbled >= 0.6 * n and (surprise < 7 or garbled >= 0.2 * n) and not (noise or repeat or long_word or menu or spam or code)
    pattern = 0
    for bit, yes in enumerate(
        (
            stop and n >= 12 and x.letters + garbled >= 0.3 * n,
            len(words) >= 4 and x.common >= 0.34 * len(words),
            len(words) >= 6 and x.common >= 0.14 * len(words) and surprise < 6,
            len(words) >= 10 and x.symbols <= 0.1 * n and x.digits <= 0.1 * n and surprise < 6 and not spam,
            n >= 24 and surprise <= 5.5 and (x.symbols <= 0.15 * n or garbled >= 0.2 * n) and x.digits <= 0.1 * n and not (spam or menu or bullet or code),
            near_prose and n >= 8 and x.digits < 0.3 * n and x.letters + garbled >= 0.5 * n,
            n <= 16 and not stop and not garbled,
            len(words) <= 3 and unmarked and not odd and n <= 40,
            x.digits >= 0.3 * n >= 1.8 or bool(_PAIR.match(s)),
            x.digits >= 0.15 * n and x.symbols >= 0.15 * n and n >= 12 and not odd,
            x.symbols >= 0.4 * n and n >= 6 and not odd,
            long_word,
            surprise >= 7 and n >= 12 and garbled < 0.2 * n,
            surprise >= 6 and n >= 12 and not x.common and not odd,
            spam,
            x.predicate,
            foreign >= 0.5 * n and n >= 12,
            garbled >= 0.2 * n and n >= 12,
            garbled >= 0.4 * n and n >= 24 and x.digits <= 0.1 * n,
            before_open and not bullet and x.letters >= 4,
            n >= 24 and x.digits <= 0.15 * n and reads,
            bullet and n <= 60 and not stop,
            x.leader,
            menu,
            len(_CELLS.findall(s)) >= 2 or bool(_CSV.match(s)),
            bool(_STAMP.match(s)),
            code,
            repeat,
            noise,
            "#" in s and len(_TAGS.findall(s)) >= 3,
        )
    ):
        if yes:
            pattern |= 1 << bit
    return pattern


def _function_words(s: str, words: list[str]) -> int:
    if s.isascii() or not _HANGUL.search(s):
        return sum(1 for w in words if w.lower().strip(".,!?“”\"'") in COMMON)
    return len(_ENDING.findall(s))


_UNBROKEN = re.compile(r"[,、，고며서만자은는이가을를의에로]$")


@dataclass
class Text:
    """Vote patterns and characters of a text's lines, and its statistics."""

    patterns: list[int]
    chars: list[int]
    words: int = 0
    word_length: float = 0.0
    symbol_ratio: float = 0.0
    stop_share: float = 0.0
    common_share: float = 0.0


def split(text: str | None) -> list[str]:
    """The lines of a text that aren't blank, without white space around them."""
    return [x.strip() for x in _BREAK.split(text or "") if x and not x.isspace()]


def look(rows: list[str], surprise: list[float]) -> Text:
    """The statistics and the votes of one text, given the surprise of its lines."""
    got = [Line.of(x) for x in rows]
    if not got:
        return Text([], [])
    ends = [x.stop or x.predicate for x in got]
    share = sum(x.stop for x in got) / len(got)
    pattern = []
    for i, x in enumerate(got):
        near = share >= 0.6 or any(ends[max(0, i - 2) : i]) or any(ends[i + 1 : i + 3])
        pattern.append(votes(x, surprise[i], near, i > 0 and bool(_UNBROKEN.search(rows[i - 1])), share <= 0.1))
    chars = [len(x) for x in rows]
    words = sum(len(x.words) for x in got)
    in_words = sum(len(w) for x in got for w in x.words)
    return Text(pattern, chars, words, in_words / max(1, words), sum(x.symbols for x in got) / sum(chars), share, sum(x.common for x in got) / max(1, words))


# --- surprise ----------------------------------------------------------------------

BUCKETS = 1 << 18


def _pairs(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the pairs of neighbouring characters of each line and of their first characters, and the number of pairs of each line."""
    points, at = codes([r.lower() for r in rows])
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pair = ((x[:-1] + points[1:].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int32)
    keep = np.ones(len(pair), bool)
    keep[at[1:-1] - 1] = False
    return pair[keep], (x[:-1] >> np.uint64(46)).astype(np.int32)[keep], np.diff(at) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: how often each bucket of pairs (from 0) and of characters (from BUCKETS) occurs."""
    total = np.zeros(2 * BUCKETS, np.int64)
    for whole in batches:
        for b in slices(whole, 0, 4_000_000):
            rows = [r for x in b.column(0).to_pylist() for r in split(x)]
            if rows:
                pair, one, _ = _pairs(rows)
                total += np.bincount(pair, minlength=2 * BUCKETS) + np.bincount(one + BUCKETS, minlength=2 * BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def surprises(counts: np.ndarray, rows: list[str]) -> np.ndarray:
    """Mean bits of a line's characters, each given the one before; smoothed towards what is little known, which surprises less than what is known not to follow."""
    if not rows:
        return np.zeros(0)
    pair, one, n = _pairs(rows)
    bits = np.log2((counts[BUCKETS:][one] + 50) / (counts[:BUCKETS][pair] + 0.5))
    total = np.concatenate(([0.0], np.cumsum(bits)))
    end = np.cumsum(n)
    return (total[end] - total[end - n]) / np.maximum(n, 1)


# --- expectation-maximization ------------------------------------------------------


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of each pattern (a row for each) over TYPES, by EM on the pattern counts.

    P(function votes | type) starts from votes that are mostly right, and is learned
    with the share of each type; a Beta prior of little weight at the start values keeps
    a type that hardly occurs from being taken by another.  Functions are taken to be
    independent given the type.  ``rounds`` 0: the start values' posterior.
    """
    k = len(LABELS)
    bits = ((patterns[:, None] >> np.arange(k)) & 1).astype(float)
    own = np.array(LABELS)[None, :] == np.arange(4)[:, None]
    start = np.where(own, 0.5, 0.03)
    vote, prior = start, np.array([0.7, 0.1, 0.1, 0.1])
    weight = counts / counts.sum()
    post = np.zeros((len(patterns), 4))
    for n in range(rounds + 1):
        log = np.log(prior) + bits @ np.log(vote).T + (1 - bits) @ np.log(1 - vote).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6 or n == rounds:
            break
        mass = post * weight[:, None]
        total = mass.sum(0)
        prior = (total + 1e-3) / (total + 1e-3).sum()
        vote = (mass.T @ bits + PRIOR * start) / (total[:, None] + PRIOR)
    return post


#: Weight of the prior of a function's votes, as a share of all lines.
PRIOR = 0.05


def _vote(counts: np.ndarray):
    names = ["rec_id", "patterns", "chars", "n", "words", "word_length", "symbol_ratio", "stop_share", "common_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for whole in batches:
            for b in slices(whole, 1, 4_000_000):
                rows = [split(x) for x in b.column(1).to_pylist()]
                bits = surprises(table, [r for x in rows for r in x]).tolist()
                got, at = [], 0
                for x in rows:
                    got.append(look(x, bits[at : at + len(x)]))
                    at += len(x)
                sizes = []
                for t in got:
                    size: dict[int, list[int]] = {}
                    for p, c in zip(t.patterns, t.chars):
                        e = size.setdefault(p, [0, 0])
                        e[0] += c
                        e[1] += 1
                    sizes.append(size)
                cols = [b.column(0), pa.array([list(s) for s in sizes], pa.list_(pa.int64()))]
                cols += [pa.array([[e[k] for e in s.values()] for s in sizes], pa.list_(pa.int32())) for k in (0, 1)]
                cols += [pa.array([t.words for t in got], pa.int64())] + [pa.array([getattr(t, c) for t in got], pa.float64()) for c in names[5:]]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def text_types(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """rec_table, rec_id, the statistics, the share of each type and the type of every record of (table, frame, key, text)."""
    ddl = "rec_id long, patterns array<long>, chars array<int>, n array<int>, words long, word_length double, symbol_ratio double, stop_share double, common_share double"
    texts = [(name, df.select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("text")).where("rec_id is not null")) for name, df, key, text in tables]
    counted = functools.reduce(DataFrame.union, [rows.select("text").mapInArrow(_count, "bucket int, n long") for _, rows in texts])
    known = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * BUCKETS rows
    counts = np.zeros(2 * BUCKETS, np.float32)
    counts[known.bucket.to_numpy(np.int64)] = known.n
    table = texts[0][1].sparkSession.sparkContext.broadcast(counts)
    every = None
    for name, rows in texts:
        one = rows.mapInArrow(_vote(table), ddl).select(F.lit(name).alias("rec_table"), "*")
        every = one if every is None else every.union(one)
    voted = stored(every, "quality-votes")
    counts = voted.select(F.explode(F.arrays_zip("patterns", "n")).alias("z")).groupBy("z.patterns").agg(F.sum("z.n").alias("n"))
    got = counts.collect()  # at most one row for each vote pattern
    patterns = np.array([r[0] for r in got], np.int64)
    order = np.argsort(patterns)
    post = learn(patterns[order], np.array([r[1] for r in got], float)[order]) if len(got) else np.zeros((0, 4))
    known = patterns[order]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            shares = []
            for p, c in zip(b.column(at["patterns"]).to_pylist(), b.column(at["chars"]).to_pylist()):
                if not p:
                    shares.append([0.0] * 4)
                    continue
                v = post[np.searchsorted(known, p)] * np.array(c)[:, None]
                shares.append((v.sum(0) / sum(c)).tolist())
            keep = ["rec_table", "rec_id", "words", "word_length", "symbol_ratio", "stop_share", "common_share"]
            cols = [b.column(at[k]) for k in keep] + [pa.array([s[k] for s in shares], pa.float64()) for k in range(4)]
            kinds = [TYPES[int(np.argmax(s))] if sum(s) else None for s in shares]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kinds, pa.string())], keep + TYPE_COLUMNS)

    out = "rec_table string, rec_id long, words long, word_length double, symbol_ratio double, stop_share double, common_share double, "
    return voted.mapInArrow(share, out + ", ".join(f"{t}_share double" for t in TYPES) + ", text_type string")


TYPE_COLUMNS = [f"{t}_share" for t in TYPES] + ["text_type"]
