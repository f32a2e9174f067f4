"""Text decoded with the wrong encoding: which chain of encodings garbled it, and the original.

A multinomial classifier over hashed byte bigrams tells the chain of every unit of
a text (a word, or 24 characters of a long one).  It is trained on records of the
data itself that are garbled synthetically by every chain, so each label is exact.
A class is a chain and the script that it garbled, or clean text of a script: French
read as Windows-1252 has little in common with Korean read so.  The best path over a
text's units gives runs of one chain.

A run is undone by the inverse of the chain predicted for it.  Only where that isn't
strictly decodable, or doesn't read better to the classifier than before, the other
chains of UTF-8 and those that the run is evidence for follow in the order of their likelihood; ``fallbacks`` counts the parts of a
record for which that was needed.  Rounds go on until nothing changes, as one chain may
stand on top of another.  A chain that can't be undone has no such proof: replaced
marks count as evidence once for each different unit.

The training sample is ``TRAIN`` rows, chosen by a hash of the key: a documented
bound.  Every row is scored, in whole length: a text in which no unit is likelier under
any chain than clean by ``HINT`` is clean.

Null and blank texts are clean; rows with a null key are passed over; repeated rows
give one result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jikjo.functions.codepoints import slices

TRAIN, TRAIN_CHARS = 1_500, 300
BUCKETS = 1 << 14
UNIT = 24
#: Log odds that a run must make up for to be entered, and that it must bring in all.
ENTER, MARGIN = 18.0, 20.0
#: The same for UTF-8 read otherwise: that it decodes strictly is nearly a proof.
ENTER_UTF8, MARGIN_UTF8 = 16.0, 9.0
#: Log odds of a unit for its text to be looked at further.
HINT = 5.0
#: Without such a proof each different unit counts once, and all at most so much for each different character beyond ASCII; a unit of question marks so much.
CAP_CHAR, CAP_MARKS = 4.0, 8.0


# --- encodings -------------------------------------------------------------------


@functools.lru_cache(1)
def _sloppy() -> tuple[str, dict[int, int]]:
    """Windows-1252 with Latin-1 where it has no character: decode table and its inverse (C1 controls included)."""
    table = "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(256))
    back = {b: b for b in range(256)} | {ord(c): b for b, c in enumerate(table)}
    return table, back


def _to_bytes(x: str, enc: str) -> bytes:
    if enc == "cp1252":
        back = _sloppy()[1]
        try:
            return bytes(back[ord(c)] for c in x)
        except KeyError:
            raise UnicodeEncodeError("cp1252", x, 0, 1, "no such byte") from None
    return x.encode(enc)


def _to_text(b: bytes, enc: str, errors: str) -> str:
    return b.decode("latin-1").translate(_cp1252_map()) if enc == "cp1252" else b.decode(enc, errors)


@functools.lru_cache(1)
def _cp1252_map() -> dict[int, str]:
    return {b: c for b, c in enumerate(_sloppy()[0]) if ord(c) != b}


#: Quotation marks, dashes and the like of clean text that Windows-1252 has as well, so that they can stand beside a garbled run.
_MARKS = "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u2022\xb7\xab\xbb"


def _strict(b: bytes, enc: str, chars: str) -> str:
    """Strictly decoded, but for marks that don't belong to the garbled bytes: with ``chars``, one for each byte, such a mark stays."""
    out, i = [], 0
    while True:
        try:
            return "".join(out) + b[i:].decode(enc)
        except UnicodeDecodeError as e:
            j = i + e.start
            if not chars or chars[j] not in _MARKS:
                raise
            out += [b[i:j].decode(enc), chars[j]]
            i = j + 1


class Chain:
    """Encode and decode steps, in the order in which they garbled the text."""

    def __init__(self, name: str, steps: list[tuple[str, str]]) -> None:
        self.name, self.steps = name, steps

    def garble(self, x: str) -> str | None:
        """The garbled text, or None if the first encoding lacks more than a few of its letters beyond ASCII."""
        for right, wrong in self.steps:
            if right == "ascii":
                x = x.encode("ascii", "replace").decode() if wrong == "?" else "".join(c if c < "\x80" else "�" * len(c.encode()) for c in x)
                continue
            b = x.encode(right, "ignore")
            if len(x.encode(right, "replace")) - len(b) > 0.03 * sum(c > "\x7f" for c in x):
                return None
            x = _to_text(b, wrong, "replace")
        return x

    def undo(self, x: str) -> str | None:
        """The original, or None where some step isn't strictly decodable."""
        try:
            for right, wrong in reversed(self.steps):
                if right == "ascii":
                    return None
                x = _strict(_to_bytes(x, wrong), right, x if len(_to_bytes(x, wrong)) == len(x) else "")
        except UnicodeError:
            return None
        return x


#: Fixed values: (encoding of the text, encoding it was read as), step by step.
CHAINS: list[Chain] = [
    Chain("utf8>cp1252", [("utf-8", "cp1252")]),
    Chain("utf8>cp1252>utf8>cp1252", [("utf-8", "cp1252"), ("utf-8", "cp1252")]),
    Chain("utf8>latin1", [("utf-8", "latin-1")]),
    Chain("utf8>latin1>utf8>latin1", [("utf-8", "latin-1"), ("utf-8", "latin-1")]),
    Chain("cp949>cp1252", [("cp949", "cp1252")]),
    Chain("gbk>cp1252", [("gbk", "cp1252")]),
    Chain("cp932>cp1252", [("cp932", "cp1252")]),
    Chain("cp932>latin1", [("cp932", "latin-1")]),
    Chain("cp949>gbk", [("cp949", "gbk")]),
    Chain("gbk>cp949", [("gbk", "cp949")]),
    Chain("cp932>cp949", [("cp932", "cp949")]),
    Chain("cp932>gbk", [("cp932", "gbk")]),
    Chain("cp949>cp932", [("cp949", "cp932")]),
    Chain("utf8>cp949", [("utf-8", "cp949")]),
    Chain("utf8>gbk", [("utf-8", "gbk")]),
    Chain("utf8>cp932", [("utf-8", "cp932")]),
    Chain("cp949>utf8", [("cp949", "utf-8")]),
    Chain("gbk>utf8", [("gbk", "utf-8")]),
    Chain("cp932>utf8", [("cp932", "utf-8")]),
    Chain("cp949>utf8>cp949", [("cp949", "utf-8"), ("utf-8", "cp949")]),
    Chain("utf8>ascii", [("ascii", "�")]),
    Chain("any>?", [("ascii", "?")]),
]

_BY_NAME = {c.name: c for c in CHAINS}


def _families() -> tuple[np.ndarray, list[list[int]]]:
    """Chains that differ only in Latin-1 for Windows-1252, which most garbled words don't tell apart: the family of each chain, and the chains of each."""
    keys = [tuple((a, "cp1252" if b == "latin-1" else b) for a, b in c.steps) for c in CHAINS]
    names = list(dict.fromkeys(keys))
    return np.array([names.index(k) for k in keys]), [[i for i, k in enumerate(keys) if k == n] for n in names]


FAMILY, MEMBERS = _families()
#: What it costs to enter a family's run; clean text (0) is entered freely.
_COST = np.array([0.0] + [ENTER_UTF8 if CHAINS[m[0]].steps[0][0] == "utf-8" else ENTER for m in MEMBERS], np.float32)

#: For the choice of clean training samples only: characters that hint at a chain.
_TRACE = re.compile(
    "[^\x00-\x7f –-…　-〿぀-ヿ가-힣！-～฀-๿ऀ-ॿ]|\\?\\?|â€"
)


# --- the classifier --------------------------------------------------------------


_UNIT = re.compile(r"[^ \t\r\n　]{1,%d}" % UNIT)


def units(x: str) -> list[tuple[int, int]]:
    """(start, end) of each word, a long one in parts of UNIT characters; white space belongs to no unit."""
    return [m.span() for m in _UNIT.finditer(x)]


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte bigrams of all texts (a space before and after each) and where each text's begin."""
    data = [b" " + t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    sizes = np.array([len(d) for d in data])
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    pair = (((raw[:-1] << np.uint32(8)) | raw[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    keep = np.ones(len(pair), bool)
    keep[begin[1:] - 1] = False
    return pair[keep], begin - np.arange(len(begin))


@dataclass
class Model:
    """Log probability of each bucket by class, classes in the order of their chain; where each chain's begin (0: clean text)."""

    weights: np.ndarray
    first: np.ndarray

    def scores(self, parts: list[str]) -> np.ndarray:
        """Log likelihood of each part as clean text (column 0) and under each chain, by the best of their classes."""
        out = np.empty((len(parts), len(self.first)), np.float32)
        for o in range(0, len(parts), 2_000):
            k, begin = bigrams(parts[o : o + 2_000])
            out[o : o + 2_000] = np.maximum.reduceat(np.add.reduceat(self.weights[k], begin, axis=0), self.first, axis=1)
        return out


#: Scripts by the letters that are most frequent beside ASCII; a text without such letters counts as latin.
_SCRIPTS = {"hangul": "[가-힣]", "kana": "[぀-ヿ]", "han": "[㐀-鿿]", "latin": "[À-ɏ]", "other": "[Ͱ-῿]"}


def _script(x: str) -> str:
    n = {name: len(re.findall(p, x)) for name, p in _SCRIPTS.items()}
    if n["kana"] * 5 > n["han"] > 0:
        return "kana"
    best = max(n, key=n.__getitem__)
    return best if n[best] else "latin"


def train(samples: list[str]) -> Model:
    """Bucket counts of each class: of its own script's samples, and lightly of all scripts."""
    by: dict[str, list[str]] = {}
    for s in samples:
        if s and not _suspicious(s):
            by.setdefault(_script(s), []).append(s)
    by = by or {"latin": []}
    columns, first = [], []
    for c in range(len(CHAINS) + 1):
        counts = []
        for script, clean in sorted(by.items()):
            made = clean if c == 0 else [g for s in clean if not s.isascii() and (g := CHAINS[c - 1].garble(s)) and g != s]
            pieces = [m[a:b] for m in made for a, b in units(m)]
            if c and CHAINS[c - 1].steps[0][1] == "?":
                pieces = [p for p in pieces if "?" in p]
            elif c and script != "latin":  # ASCII words are no sign of a chain, but where garbled words stand among them
                pieces = [p for p in pieces if not p.isascii()]
            if pieces:
                counts.append(np.bincount(bigrams(pieces)[0], minlength=BUCKETS).astype(float))
        whole = sum(counts, np.zeros(BUCKETS))
        first.append(len(columns))
        for n in counts or [whole]:
            n = n + 0.02 + 300 * whole / max(1.0, whole.sum())
            columns.append(np.log(n / n.sum()))
    return Model(np.ascontiguousarray(np.array(columns, np.float32).T), np.array(first))


def _suspicious(x: str) -> bool:
    """A sample that may itself be garbled: it holds traces that decode strictly, or lost characters."""
    if "�" in x or re.search("[\x80-\x9f\ue000-\uf8ff]|(?<!\\w)\\?\\?", x):
        return True
    for part in re.split(r"[ \n]+", x):
        if _TRACE.search(part):
            for c in [*CHAINS[:4], _BY_NAME["gbk>cp949"]]:
                y = c.undo(part)
                if y is not None and y != part and len(y) < len(part):
                    return True
    if len(re.findall("[一-鿿]", x)) > 4:  # Hanzi that are all Hangul when read as cp949
        y = _BY_NAME["cp949>gbk"].undo("".join(re.findall("[一-鿿]", x)))
        if y is not None and re.fullmatch("[가-힣]+", y):
            return True
    return len(re.findall("[¡-ÿ]", x)) > 0.3 * len(x)


def suspects(model: Model, texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """The texts of a batch that hold a unit which some chain explains better than clean text, and the likelihoods of their units.

    Each different unit is scored once.
    """
    every = [_UNIT.findall(x) for x in texts]
    number: dict[str, int] = {}
    for u in every:
        for w in u:
            number.setdefault(w, len(number))
    if not number:
        return []
    ll = model.scores(list(number))
    hot = (ll[:, 1:] - ll[:, :1]).max(1) >= HINT
    out = []
    for i, u in enumerate(every):
        at = np.fromiter(map(number.__getitem__, u), np.int64, len(u))
        if hot[at].any():
            out.append((i, ll[at]))
    return out


def _proved(chain: Chain) -> bool:
    """That it decodes strictly is nearly a proof: only of UTF-8."""
    return chain.steps[0][0] == "utf-8"


@dataclass
class Run:
    """A garbled run of a text, its chain, and the chains that may take its place, by their likelihood: those of UTF-8, whose decoding is a proof, and those there is evidence for."""

    start: int
    end: int
    chain: Chain
    ranked: list[Chain]
    weak: bool  # ``chain`` isn't the predicted one, which there is too little evidence for


def runs(model: Model, x: str, ll: np.ndarray | None = None) -> list[Run]:
    """The garbled runs of a text: the best path of families over its units, and for each family of the text its likeliest chain."""
    at = units(x)
    if not at:
        return []
    if ll is None:
        ll = model.scores([x[a:b] for a, b in at])
    each = ll[:, 1:] - ll[:, :1]
    if each.max(initial=0.0) < HINT:
        return []
    odds = np.stack([np.zeros(len(at), np.float32)] + [each[:, m].max(1) for m in MEMBERS], 1)
    path = np.zeros(len(at), int)
    for lo, hi in _stretches(odds):
        path[lo:hi] = _best_path(odds[lo:hi])
    exact = {int(f): _member(x, at, path == f, MEMBERS[f - 1], each) for f in np.unique(path) if f}
    out, i, n = [], 0, len(at)
    while i < n:
        j = i
        while j < n and path[j] == path[i]:
            j += 1
        if path[i]:
            chain, weak = CHAINS[exact[int(path[i])]], False
            mine, whole = odds[i:j, path[i]], each[i:j].sum(0)
            if _proved(chain):
                enough = mine.sum() >= MARGIN_UTF8
            else:
                once = {x[a:b]: float(o) for (a, b), o in zip(at[i:j], mine)}
                marks = chain.steps[0][1] == "?"
                seen = {c for u in once for c in u if c > "\x7f"}
                most = np.inf if marks or "�" in seen else CAP_CHAR * len(seen)
                gain = sum(min(o, CAP_MARKS) if marks else o for o in once.values())
                enough, weak = gain >= MARGIN, gain >= MARGIN > most
            order = [int(k) for k in np.argsort(-whole, kind="stable")]
            if weak:  # too few different characters for a chain without proof: only one with proof may take its place
                order = [k for k in order if _proved(CHAINS[k])]
                chain = CHAINS[order[0]]
            if enough:
                able = [CHAINS[k] for k in order if _proved(CHAINS[k]) or whole[k] >= MARGIN]
                out.append(Run(at[i][0], at[j - 1][1], chain, able, weak))
        i = j
    return out


def _stretches(odds: np.ndarray) -> list[tuple[int, int]]:
    """Where the best path may leave clean text.  It crosses no stretch that loses more than it costs to enter again, and gains at least what it costs once."""
    top = odds[:, 1:].max(1)
    some = np.flatnonzero(top > 0)
    if not len(some):
        return []
    total = np.cumsum(np.minimum(top, 0))
    cut = np.flatnonzero(np.diff(total[some]) < -ENTER) + 1
    parts = np.split(some, cut)
    return [(int(p[0]), int(p[-1]) + 1) for p in parts if top[p].sum() > ENTER_UTF8]


def _best_path(odds: np.ndarray) -> np.ndarray:
    n, m = odds.shape
    best, back = odds[0] - _COST, np.zeros((n, m), np.int8)
    same = np.arange(m)
    for i in range(1, n):
        top = int(best.argmax())
        least = best[top] - _COST
        back[i] = np.where(best >= least, same, top)
        best = np.maximum(best, least) + odds[i]
    path, c = np.zeros(n, int), int(best.argmax())
    for i in range(n - 1, -1, -1):
        path[i] = c
        c = int(back[i, c])
    return path


def _member(x: str, at: list[tuple[int, int]], mine: np.ndarray, members: list[int], each: np.ndarray) -> int:
    """The chain of a family by which the units came about: the likeliest of those that can have produced most of their characters."""
    if len(members) == 1:
        return members[0]
    text = "".join(x[a:b] for (a, b), m in zip(at, mine) if m)
    return min(members, key=lambda k: (sum(not _has(c, CHAINS[k].steps[-1][1]) for c in text), -float(each[mine, k].sum())))


def _grown(x: str, a: int, b: int, chain: Chain) -> tuple[int, int]:
    """The run with the neighbouring characters, also across a space, that the chain's last encoding may have produced as well."""
    wrong = chain.steps[-1][1]
    if wrong in ("?", "�"):
        return a, b

    def mine(c: str) -> bool:
        return c > "\x7f" and not "가" <= c <= "힣" and _has(c, wrong)

    while a > 0 and (mine(x[a - 1]) or (x[a - 1] == " " and a > 1 and mine(x[a - 2]))):
        a -= 1
    while b < len(x) and (mine(x[b]) or (x[b] == " " and b + 1 < len(x) and mine(x[b + 1]))):
        b += 1
    return a, b


@dataclass
class Repair:
    """What was found in a garbled text.  ``restorable``: every run decoded strictly.

    ``lossy``: some run's characters are gone; runs that do decode are restored all
    the same, the others stay as they are.
    """

    case: str
    chains: list[str]
    text: str
    parts: int
    fallbacks: int


def repair(model: Model, x: str, ll: np.ndarray | None = None) -> Repair | None:
    """None for a clean text.  ``ll``: the likelihoods of its units, if they are known."""
    text, names, lossy, done, parts, fallbacks = x, [], False, False, 0, 0
    seen = {x}
    while True:  # a chain may have been applied on top of another
        out, last = [], 0
        for r in runs(model, text, ll):
            wide = _grown(text, r.start, r.end, r.chain)
            for a, b in dict.fromkeys([(max(last, wide[0]), wide[1]), (max(last, r.start), r.end)]):
                s = text[a:b]
                if gone := _gone(r.chain, s):
                    break
                y, used, strange = _undone(model, r, s)
                if used and not strange:
                    break
            if gone:
                names.append(r.chain.name)
                lossy, y = True, s
            elif not used:
                continue
            else:
                names += used
                parts += len(used)
                fallbacks += strange
            out += [text[last:a], y]
            last = b
            done = True
        text, ll = "".join(out) + text[last:], None
        if text in seen:
            break
        seen.add(text)
    if not done or (text == x and not lossy):
        return None
    return Repair("lossy" if lossy or "�" in x else "restorable", list(dict.fromkeys(names)), text, parts, fallbacks)


def _reads(model: Model, before: str, after: str) -> bool:
    """The restored text is likelier to be clean than the garbled one was."""
    a, b = model.scores([before, after])[:, 0]
    return bool(b > a) and not re.search("[\x80-\x9f\ue000-\uf8ff�]", after)


def _gone(chain: Chain, s: str) -> bool:
    """Characters of this run are replaced by marks and can't come back."""
    return chain.steps[0][1] == "?" or "�" in s or "占쏙옙" in s


_EDGES = _MARKS + "".join(map(chr, range(128)))


def _undone(model: Model, r: Run, s: str) -> tuple[str, list[str], int]:
    """(text, chains undone, for how many parts it wasn't the predicted one) of one run.

    A passage may begin or end inside a word: the run is cut where a character isn't
    one that the last encoding could have produced, and each part is undone by itself.
    """
    out, used, strange = [], [], 0
    for part in _parts(s, r.chain.steps[-1][1]):
        got = None if part.isascii() else _inverse(model, r.chain, part)
        if got is None and not part.isascii():
            for other in r.ranked:
                if other is not r.chain and (got := _inverse(model, other, part)) is not None:
                    used.append(other.name)
                    strange += 1
                    break
        elif got is not None:
            used.append(r.chain.name)
            strange += r.weak
        out.append(part if got is None else got)
    return "".join(out), used, strange


def _inverse(model: Model, chain: Chain, part: str) -> str | None:
    """``part`` before the chain, if it decodes strictly and reads better so; clean marks at its edges may be none of its bytes."""
    a, b = len(part) - len(part.lstrip(_EDGES)), len(part.rstrip(_EDGES))
    if a >= b:
        return None  # marks alone
    for lo, hi in dict.fromkeys([(0, len(part)), (a, b)]):
        inner = part[lo:hi]
        y = chain.undo(inner) if inner else None
        if y is not None and y != inner and _reads(model, inner, y):
            return part[:lo] + y + part[hi:]
    return None


def _parts(s: str, wrong: str) -> list[str]:
    """The text cut into stretches of characters that the encoding has and stretches of others."""
    if wrong in ("?", "�"):
        return [s]
    out: list[str] = []
    before = None
    for c in s:
        now = c <= "\x7f" or _has(c, wrong)
        if now != before:
            out.append("")
        out[-1] += c
        before = now
    return out


@functools.lru_cache(100_000)
def _has(c: str, enc: str) -> bool:
    try:
        return bool(_to_bytes(c, enc))
    except UnicodeError:
        return False


def classifier(df: DataFrame, key: str, text: str, rows: int = TRAIN) -> Model:
    """Trained on at most ``rows`` records, chosen by a hash of their key."""
    there = df.select(F.col(key).alias("k"), F.substring(text, 1, TRAIN_CHARS).alias("t")).where("k is not null and length(trim(t)) > 0")
    # a threshold on the hash first: a top-n alone would send n rows of every partition to the driver
    n = there.count()
    if n > 2 * rows:
        there = there.where(F.pmod(F.xxhash64("k"), F.lit(n)) < 2 * rows)
    return train(sorted({r.t for r in there.orderBy(F.xxhash64("k"), "k").limit(rows).collect()}))


def garbled(df: DataFrame, key: str, text: str, rows: int = TRAIN) -> DataFrame:
    """key, case_kind, chains and restored text of every garbled record; how many parts were undone, and how many by another chain than predicted."""
    model = df.sparkSession.sparkContext.broadcast(classifier(df, key, text, rows))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in slices(whole, 1):
                texts = b.column(1).to_pylist()
                got = [(i, r) for i, ll in suspects(m, texts) if (r := repair(m, texts[i], ll))]
                found = [r for _, r in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([i for i, _ in got], pa.int64())),
                        pa.array([r.case for r in found], pa.string()),
                        pa.array([r.chains for r in found], pa.list_(pa.string())),
                        pa.array([r.text.encode("utf-8", "replace").decode() for r in found], pa.string()),
                        pa.array([r.parts for r in found], pa.int32()),
                        pa.array([r.fallbacks for r in found], pa.int32()),
                    ],
                    [key, "case_kind", "chains", "restored", "parts", "fallbacks"],
                )

    rows_ = df.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows_.mapInArrow(run, f"{key} {kind}, case_kind string, chains array<string>, restored string, parts int, fallbacks int").dropDuplicates([key])
