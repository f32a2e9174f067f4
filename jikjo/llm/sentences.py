"""Sentence boundaries across languages and scripts, by a finite transducer.

Boundary rules are data: ``MARK_RULES`` say by what stands before and after which marks
end a sentence (abbreviations, decimals, dates, initials), ``FOLLOW_RULES`` what a
closing mark is followed by.  They are compiled into one automaton each, with a bounded
context (``HALO`` characters on either side), and turn a text into events: end marks
that do end a sentence, openings and closings of quotations with what follows them,
line breaks, sentence endings without a mark, other text.  A table over (state, event),
compiled from ``step``, gives the next state and whether a sentence ends.

Documents are cut into chunks of about ``CHUNK`` characters, between events.  Of a
document of one chunk the entry state is known, and it is run at once.  Else each chunk
becomes a function from every entry state to its exit state (with where the sentence
open at its end began), the functions are composed by a parallel prefix scan (log2 of
the chunk count rounds of joins on the chunk number), and then every chunk is run from
its own entry state.  The result doesn't depend on where chunks end.

Positions count code points; [start, end) holds no white space at its ends.  Null
and blank texts give no rows, repeated rows give the same rows once; of texts that
differ under one key the one with the smallest hash is cut.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jikjo.storage import stored

CHUNK, HALO = 2_000, 64

# --- fixed values ------------------------------------------------------------------
#: Quotation marks and brackets: opening, closing.
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "„": "“", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "【": "】"}
#: Words before a full stop that doesn't end a sentence.
ABBREVIATIONS = frozenset(
    "Dr Mr Mrs Ms Prof Sr Jr St No Nos Nr vs Co Ltd Inc Corp Mio Mrd bzw usw ca Nr p pp fig Fig eg ie cf al M Mme Mlle art Art vol Vol ch Tel Abs z B d h u a S".split()
) | {"डॉ", "प्रो", "श्री", "श्रीमती", "सं"}
#: Endings of a Korean predicate that closes a sentence.
KOREAN_ENDINGS = (
    "니다 니까 어요 아요 해요 여요 에요 예요 네요 지요 군요 했다 하다 한다 였다 았다 었다 겠다 된다 됐다 졌다 렸다 냈다 겼다 혔다 났다 왔다 갔다 섰다 꼈다 쳤다 켰다 뒀다 줬다 는가 은가 인가 던가 이야 이다 있다 없다 는다".split()
)
MONTHS = "Jan|Feb|Mär|Mar|Apr|Mai|May|Jun|Jul|Aug|Sep|Okt|Oct|Nov|Dez|Dec"
# -----------------------------------------------------------------------------------

_CLOSERS = "".join(dict.fromkeys(PAIRS.values())).replace("“", "")
_LINE = r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]"
_LEX = re.compile(
    rf"(?P<nl>{_LINE}+)"
    r"|(?P<end>[.!?。！？…।॥｡]+)"
    r"|(?P<open>[“‘「『«„《〈(（\[【])"
    r"|(?P<close>[”’」』»》〉)）\]】])"
    r"|(?P<ascii>[\"'])"
    rf"|(?P<ko>(?<=[가-힣])(?:{'|'.join(KOREAN_ENDINGS)})(?:[~♡♥^]++|[ ]?[ㅋㅎㅠㅜ]{{2,}}+|[ ]?[\U0001F300-\U0001FAFF])*+(?=\s))"
    r"|(?P<th>(?<=[฀-๿])[^\S\n\r]+)"
)
# --- the rules, compiled ----------------------------------------------------------

_S = r"[^\S\n\r\v\f\x1c-\x1e\x85\u2028\u2029]"  # space within a line
_M = "[.!?。！？…।॥｡]"
_ABBREVIATED = "|".join(sorted((w for w in ABBREVIATIONS if w.isascii()), key=lambda w: (-len(w), w)))
_PARTICLE = r"이?라(?:고|는|며|던|면|니)|(?:고|며|은|는|이|가|을|를|에|에서|의|와|과|도|로|으로|란|하고|하며)(?=\s)"

#: What end marks do, the first rule that holds deciding: name, what stands before, the marks, what stands after, the event.
MARK_RULES = [
    ("end of line", "", f"{_M}++", rf"{_S}*+(?:\Z|{_LINE})", "end"),
    ("dots in a sentence", "", rf"(?:\.{_M}++|…{_M}*+)", rf"{_S}+[a-z]", "text"),
    ("other marks", "", rf"(?!\.(?!{_M})){_M}++", "", "end"),
    ("inside an ASCII word or number", r"(?:\A|[\x00-\x7f])", r"\.", r"[\p{L}\p{N}]", "text"),
    ("inside another word or number", r"[\p{N}ऀ-ॿ]", r"\.", r"[\p{L}\p{N}]", "text"),
    ("joined to the next sentence", "", r"\.", r"[\p{L}\p{N}]", "end"),
    ("before another mark", "", r"\.", "[,;:/%-]", "text"),
    ("Devanagari abbreviation", "[ऀ-ॿ]", r"\.", "", "text"),
    ("before a small letter", "", r"\.", f"{_S}+[a-z]", "text"),
    ("end of a date", r"(?:\A|\D)\d{4}\.\s?\d{1,2}(?:\.\s?\d{1,2})?", r"\.", f"(?!{_S}*[A-Z])", "text"),
    ("year of a date", r"(?<!\d)\d{4}", r"\.", r"\s?\d{1,2}\.", "text"),
    ("day of a month", r"(?<!\d)\d{1,2}", r"\.", rf"\s(?:{MONTHS})", "text"),
    ("after a number", r"\d", r"\.", "", "end"),
    ("abbreviation", rf"(?<![^\W\d_])(?:{_ABBREVIATED})", r"\.", "", "text"),
    ("initial", r"(?<![^\W\d_])[A-Z]", r"\.", "", "text"),
    ("letters with stops", r"(?:\A|\W)(?:[A-Za-z]\.)+[A-Za-z]", r"\.", "", "text"),
    ("full stop", "", r"\.", "", "end"),
]
#: What stands after a closing mark: what follows it (further closing marks passed over), the class.
FOLLOW_RULES = [
    (rf"{_S}*+(?:\Z|{_LINE})", "eol"),
    (_PARTICLE, "joined"),
    (r"[가-힣]|\d|[A-Z]|[" + re.escape("".join(PAIRS)) + "]", "apart"),
    (r"\S", "joined"),
    (f"{_S}+[a-zऀ-ॿ,;:]", "joined"),
    (f"{_S}+[A-Z]", "upper"),
    ("", "apart"),
]


def _compiled_rules(parts: list[str]) -> regex.Pattern:
    """One automaton for all rules; the group that matched names the rule."""
    return regex.compile("|".join(f"(?P<r{k}>{p})" for k, p in enumerate(parts)))


_ENDS = _compiled_rules([(f"(?<={before})" if before else "") + marks + (f"(?={after})" if after else "") for _, before, marks, after, _ in MARK_RULES])
_FOLLOWS = _compiled_rules([f"[{re.escape(_CLOSERS)}]*+(?:{after})" if after else "" for after, _ in FOLLOW_RULES])
_MARK_EVENT = {f"r{k}": r[-1] == "end" for k, r in enumerate(MARK_RULES)}
_FOLLOW_CLASS = {f"r{k}": c for k, (_, c) in enumerate(FOLLOW_RULES)}


def _ends(x: str, a: int) -> bool:
    """Whether the marks that begin at x[a] end a sentence."""
    return _MARK_EVENT[_ENDS.match(x, a).lastgroup]


def _follow(x: str, b: int) -> str:
    """What stands after a closing mark that ends at b: a line's end, an uppercase or lowercase word, a word apart, text attached."""
    return _FOLLOW_CLASS[_FOLLOWS.match(x, b).lastgroup]


Symbol = tuple[str, str, str]
_TEXT, _NL, _END, _SOFT = ("text", "", ""), ("nl", "", ""), ("end", "", ""), ("soft", "", "")
#: A state: kind of the open quotation ("" outside one), whether it began the sentence (outside: whether one has begun), whether its text has just ended.
State = tuple[str, bool, bool]
STATES: list[State] = [("", False, False), ("", True, False)] + [(k, s, e) for k in [*PAIRS, '"', "'"] for s in (False, True) for e in (False, True)]
_NUMBER = {s: i for i, s in enumerate(STATES)}


def step(state: State, symbol: Symbol) -> tuple[State, bool]:
    """The transducer: next state, and whether a sentence ends with this event."""
    kind, flag, ended = state
    what, mark, follow = symbol
    outside = ("", False, False)
    if what == "nl":
        return outside, bool(kind) or flag
    if not kind:
        if what == "end":
            return outside, True
        if what == "soft":
            return outside, flag
        if what == "open" or (what == "ascii" and (mark == '"' or follow == "opens")):
            return (mark, not flag, False), False
        if what == "close" and not flag:
            return outside, False  # a stray closing mark belongs to the sentence before
        return ("", True, False), False
    closes = (what in ("open", "close") and mark == PAIRS.get(kind)) or (what == "ascii" and mark == kind and (mark == '"' or follow != "opens"))
    if closes:
        if ended and (follow in ("eol", "upper") or (follow == "apart" and flag)):
            return outside, True
        return ("", True, False), False
    return (kind, flag, what == "end" or (ended and what == "close")), False


@functools.lru_cache(10_000)
def _compiled(symbol: Symbol) -> tuple[np.ndarray, np.ndarray]:
    """One column of the table: next state and output of every state."""
    made = [step(s, symbol) for s in STATES]
    return np.array([_NUMBER[n] for n, _ in made]), np.array([o for _, o in made])


@functools.lru_cache(100_000)
def _moved(state: int, symbol: Symbol) -> tuple[int, bool]:
    n, cut = step(STATES[state], symbol)
    return _NUMBER[n], cut


def events(x: str, lo: int, hi: int) -> Iterator[tuple[Symbol, int, int]]:
    """Events that begin in x[lo:hi]: symbol, where a sentence that begins with it starts, where one that ends with it ends."""
    at = lo
    for m in _LEX.finditer(x, lo):
        a, b = m.span()
        if a >= hi:
            break
        if a > at and (gap := x[at:a]) and not gap.isspace():
            yield _TEXT, at + len(gap) - len(gap.lstrip()), at + len(gap.rstrip())
        what = m.lastgroup
        at = b
        if what == "nl":
            yield _NL, a, a
        elif what == "end":
            if _ends(x, a):
                e = b
                while e < len(x) and x[e] in _CLOSERS:
                    e += 1
                yield _END, a, e
            else:
                yield _TEXT, a, b
        elif what == "open":
            yield ("open", m[0], _follow(x, b) if m[0] == "“" else ""), a, b
        elif what == "close":
            yield ("close", m[0], _follow(x, b)), a, b
        elif what == "ascii":
            opens = (a == 0 or x[a - 1].isspace() or x[a - 1] in PAIRS) and b < len(x) and not x[b].isspace()
            yield ("ascii", m[0], "opens" if opens else _follow(x, b)), a, b
        elif what == "ko":
            yield _TEXT, a, b
            yield _SOFT, b, b
        else:
            yield _SOFT, a, a
    if at < hi and (gap := x[at:hi]) and not gap.isspace():
        yield _TEXT, at + len(gap) - len(gap.lstrip()), at + len(gap.rstrip())


def run(x: str, lo: int = 0, hi: int | None = None, state: int = 0, start: int = -1, seen: int = 0, last: bool = True, base: int = 0) -> list[tuple[int, int]]:
    """Sentences that end in x[lo:hi], entered in ``state`` with an open sentence that began at ``start``.

    ``seen``: end of the last visible text before; ``base`` is added to positions in x.
    """
    hi = len(x) if hi is None else hi
    out = []
    for symbol, a, b in events(x, lo, hi):
        if state == 0 and symbol[0] not in ("nl", "soft"):
            start = a + base
        after, cut = _moved(state, symbol)
        if symbol[0] not in ("nl", "soft"):
            seen = b + base
        if cut:
            if seen > start >= 0:
                out.append((start, seen))
            start = -1
        state = after
    if last and state != 0 and seen > start >= 0:
        out.append((start, seen))
    return out


def function(x: str, lo: int, hi: int, begins: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """The chunk as a function of its entry state (of the first one alone, if the text begins with it): exit state, start of the sentence then open (-1: it came in), end of visible text (-1: none)."""
    state = np.zeros(1, np.int64) if begins else np.arange(len(STATES))
    start = np.full(len(state), -1, np.int64)
    seen = -1
    for symbol, a, b in events(x, lo, hi):
        if symbol[0] not in ("nl", "soft"):
            start = np.where(state == 0, a, start)
            seen = b
        state = _compiled(symbol)[0][state]
    return state, start, seen


def _safe(x: str, h: int) -> bool:
    """Whether no event of x reaches over the border before x[h]."""
    a, b = x[h - 1], x[h]
    if a == " ":  # a space may belong to what follows an ending, and to more space
        return not b.isspace() and b not in "ㅋㅎㅠㅜ" and b < "\U0001f300"
    if not (a.isalnum() and b.isalnum()):
        return False
    # an ending has three syllables at most, and white space or a sign after it
    return not "가" <= a <= "힣" or not "가" <= b <= "힣" or (len(x) > h + 3 and all("가" <= c <= "힣" for c in x[h + 1 : h + 4]))


def cuts(x: str, chunk: int) -> list[tuple[int, int]]:
    """Chunks of at least that length whose borders lie in no event; a stretch without such a border stays whole."""
    out, lo = [], 0
    while lo < len(x):
        hi = lo + chunk
        while hi < len(x) and not _safe(x, hi):
            hi += 1
        hi = min(hi, len(x))
        out.append((lo, hi))
        lo = hi
    return out


def _seen(x: str, hi: int) -> int:
    """Where the part that is read ends: the halo, and on to the next visible character, as that tells what an end mark is."""
    hi = min(len(x), hi + HALO)
    while hi < len(x) and x[hi - 1].isspace():
        hi += 1
    return hi


def direct(text: str | None) -> list[tuple[int, int]]:
    return run(text) if text else []


# --- DataFrames --------------------------------------------------------------------


def sentences(df: DataFrame, table: str, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """rec_table, rec_id, start_pos, end_pos: one row for each sentence of each record."""
    rows = df.select(F.col(key).cast("long").alias("rec_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("rec_id is not null and text is not null")
    longer = F.length("text") > chunk
    short = rows.where(~longer).mapInArrow(_short, "rec_id long, h long, start_pos long, end_pos long")
    found = short.union(_long(rows.where(longer), chunk))
    # a record's sentences are those of one of its texts, each once; the window's partitioning serves both
    one = found.withColumn("one", F.min("h").over(Window.partitionBy("rec_id"))).where("h = one").dropDuplicates(["rec_id", "start_pos"])
    return one.select(F.lit(table).alias("rec_table"), "rec_id", "start_pos", "end_pos")


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hs, a, e = [], [], [], []
        for i, h, x in zip(*(c.to_pylist() for c in b.columns)):
            for p, q in direct(x):
                ids.append(i)
                hs.append(h)
                a.append(p)
                e.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, hs, a, e)], ["rec_id", "h", "start_pos", "end_pos"])


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """The chunked way: functions, prefix scan, runs from the entry states."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, h, x in zip(f.rec_id, f.h, f.text):
                for n, (lo, hi) in enumerate(cuts(x, chunk)):
                    begin = max(0, lo - HALO)
                    out.append((i, h, n, begin, lo - begin, hi - begin, hi == len(x), x[begin : _seen(x, hi)]))
            yield pd.DataFrame(out, columns=["rec_id", "h", "n", "base", "lo", "hi", "last", "part"])

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [function(x, lo, hi, n == 0) for x, lo, hi, n in zip(f.part, f.lo, f.hi, f.n)]
            yield pd.DataFrame(
                {
                    "rec_id": f.rec_id,
                    "h": f.h,
                    "n": f.n,
                    "to": [m[0].tolist() for m in made],
                    "start": [np.where(m[1] >= 0, m[1] + b, -1).tolist() for m, b in zip(made, f.base)],
                    "seen": [m[2] + b if m[2] >= 0 else -1 for m, b in zip(made, f.base)],
                }
            )

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                state = 0 if r.n == 0 else int(r.to[0])
                start = -1 if r.n == 0 else int(r.start[0])
                got = run(r.part, r.lo, r.hi, state, start, 0 if r.n == 0 else int(r.seen), r.last, r.base)
                out += [(r.rec_id, r.h, a, b) for a, b in got]
            yield pd.DataFrame(out, columns=["rec_id", "h", "start_pos", "end_pos"])

    parts = rows.mapInPandas(cut, "rec_id long, h long, n long, base long, lo long, hi long, last boolean, part string")
    parts = stored(parts.repartition("rec_id", "h", "n").dropDuplicates(["rec_id", "h", "n"]), "sentence-chunks")
    scan = stored(parts.mapInPandas(functions, "rec_id long, h long, n long, to array<long>, start array<long>, seen long"), "sentence-functions")
    most = parts.agg(F.max("n")).first()[0] or 0
    stride = 1
    while stride <= most:  # after each round a row is the composition of its last 2 * stride chunks
        one = scan.select("rec_id", "h", (F.col("n") + stride).alias("n"), F.col("to").alias("t0"), F.col("start").alias("s0"), F.col("seen").alias("v0"))
        both = scan.join(one, ["rec_id", "h", "n"], "left")
        then = F.transform("t0", lambda s: F.get("to", s.cast("int")))
        begun = F.transform(F.arrays_zip("t0", "s0"), lambda z: F.when(F.get("start", z["t0"].cast("int")) >= 0, F.get("start", z["t0"].cast("int"))).otherwise(z["s0"]))
        known = F.col("t0").isNotNull()
        scan = stored(
            both.select(
                "rec_id",
                "h",
                "n",
                F.when(known, then).otherwise(F.col("to")).alias("to"),
                F.when(known, begun).otherwise(F.col("start")).alias("start"),
                F.greatest("seen", F.coalesce("v0", F.lit(-1))).alias("seen"),
            ),
            "sentence-scan",
        )
        stride *= 2
    entry = scan.select("rec_id", "h", (F.col("n") + 1).alias("n"), "to", "start", "seen")
    return parts.join(entry, ["rec_id", "h", "n"], "left").mapInPandas(emit, "rec_id long, h long, start_pos long, end_pos long")
