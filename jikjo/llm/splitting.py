"""Splitting oversized items at natural boundaries.

An item longer than ``limit`` characters becomes ordered pieces of at most
``limit``; each begins exactly ``overlap`` characters before the one before it
ends, so nothing is lost.  A piece ends at the last place of the strongest kind in
reach: end of a paragraph, of a line, of a sentence, of a clause, of a word.  Only
where the reach holds none of them is it cut at the limit (not inside a combined
character).

An item may be far larger than a task's memory, and there is one way for items of
every length.  Ranges of it are worked on apart, each with a halo on either side:

1. boundaries: after every grid point of the item (each ``GRID`` limits long) the first
   good place to cut is an *anchor*; the ranges on both sides find the same, in their
   halo.  Anchors cut the item into cells that are planned without regard to each
   other.  A row of the boundary table has a cell's place, its length, its number of
   pieces and its outermost pauses.
2. stitching: prefix sums over an item's rows of that table (numbers only) give each
   cell's offset in characters, its first piece's number, and the longest stretch
   without a pause, across cells too.
3. emission: each cell is read again, and its pieces are given by offset.

The grid belongs to the item, so its pieces don't depend on how many cells a range
holds.  Files are read by byte range and never whole (their grid is in bytes); the
texts of a column come whole with their row, and their ranges are cut from it.

Null and blank texts: a null gives no row, an empty or blank text one piece as it
is.  Repeated rows of a key give their pieces once; should their texts differ, those of
the text with the smallest hash.  Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jikjo.storage import stored

LIMIT, OVERLAP = 2_000, 200
#: Grid of an item in limits (a byte counts a quarter of a character), and cells in a range.
GRID, CELLS = 4, 64
#: What a reader pauses at (an end of sentence or white space), and the kinds of places to cut, strongest first.
PAUSE = r"[\s.!?。！？…।]"
KINDS = [
    re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*"),
    re.compile(r"[\n\r\v\f\x85\u2028\u2029]+"),
    re.compile(r"(?:(?<![.!?])[.!?]++[\"'”’)」』»]*(?=\s)|[。！？…।]+[\"'”’)」』»]*)\s*"),
    re.compile(r"[,;:、，；]\s*"),
    re.compile(r"\s+"),
]
_PAUSE = re.compile(PAUSE)


def _whole(x: str, e: int) -> int:
    """``e``, or the last place before it that isn't inside a combined character."""
    for k in range(e, max(0, e - 32), -1):
        if k >= len(x) or not (unicodedata.combining(x[k]) or x[k] in "\u200d\ufe0f" or x[k - 1] == "\u200d" or "\U0001F3FB" <= x[k] <= "\U0001F3FF"):
            return k
    return e


def plan(x: str, limit: int = LIMIT, overlap: int = OVERLAP, begin: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut) of the pieces of x[begin:]; the last one's kind is "end"."""
    out: list[tuple[int, int, str]] = []
    if len(x) - begin <= limit:
        return [(begin, len(x), "end")]
    places = [[m.end() for m in k.finditer(x, begin)] for k in KINDS]
    s = begin
    while len(x) - s > limit:
        end, kind = 0, ""
        for least in (max(overlap, limit // 2), overlap):  # a weaker place in the second half goes before a strong one in the first
            for name, at in zip(NAMES, places):
                k = bisect_right(at, s + limit) - 1
                if k >= 0 and at[k] > s + least:
                    end, kind = at[k], name
                    break
            if end:
                break
        if not end:
            end, kind = max(_whole(x, s + limit), s + overlap + 1), "hard"
        out.append((s, end, kind))
        s = end - overlap
    out.append((s, len(x), "end"))
    return out


NAMES = ("paragraph", "line", "sentence", "clause", "word")


def anchor(x: str, at: int, reach: int) -> tuple[int, str]:
    """The first good place to cut in x[at:at + reach] and its kind; both ranges that meet there find the same."""
    for name, kind in zip(NAMES, KINDS):
        if m := kind.search(x, at, min(len(x), at + reach)):
            return m.end(), name
    return _whole(x, at), "hard"


def pauses(x: str, lo: int, hi: int) -> tuple[int, int, int]:
    """Of x[lo:hi], relative to lo: first and last pause (-1: none), and the longest stretch between two of them."""
    first = last = -1
    most = 0
    for m in _PAUSE.finditer(x, lo, hi):
        k = m.start() - lo
        if first < 0:
            first = k
        else:
            most = max(most, k - last - 1)
        last = k
    return first, last, most


def cells(part: str, marks: list[int], first: bool, final: bool, limit: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of its end) of the cells of a range, whose grid points stand at ``marks`` in the part that was read."""
    cuts = [(marks[0], "") if first else anchor(part, marks[0], limit)] + [anchor(part, m, limit) for m in marks[1:-1]]
    cuts.append((len(part), "end") if final else anchor(part, marks[-1], limit))
    return [(a, b, kind) for (a, _), (b, kind) in zip(cuts, cuts[1:])]


def _bound(part: str, marks: list[int], k: int, first: bool, final: bool, limit: int, overlap: int) -> list[tuple]:
    """Rows of the boundary table."""
    out = []
    for j, (a, b, _) in enumerate(cells(part, marks, first, final, limit)):
        out.append((k + j, b - a, len(plan(part[:b], limit, overlap, a if first and not j else a - overlap)), *pauses(part, a, b)))
    return out


def _pieces(part: str, marks: list[int], k: int, first: bool, final: bool, limit: int, overlap: int) -> list[tuple]:
    """Pieces by cell: cell, number in it, start and end from the cell's start, kind of the cut, piece."""
    out = []
    for j, (a, b, kind) in enumerate(cells(part, marks, first, final, limit)):
        got = plan(part[:b], limit, overlap, a if first and not j else a - overlap)
        got[-1] = (*got[-1][:2], kind)
        out += [(k + j, n, s - a, e - a, cut, part[s:e]) for n, (s, e, cut) in enumerate(got)]
    return out


BOUNDARIES = "item string, h long, k long, n_chars long, pieces long, first_pause long, last_pause long, stretch long"
EMITTED = "item string, h long, k long, n long, s long, e long, cut string, piece string"


def _stitched(boundaries: DataFrame) -> DataFrame:
    """The boundary table with each cell's offset, first piece number, and the item's length and longest stretch; of an item's texts one."""
    once = boundaries.dropDuplicates(["item", "h", "k"]).withColumn("one", F.min("h").over(Window.partitionBy("item"))).where("h = one").drop("one")
    before = Window.partitionBy("item").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    item = Window.partitionBy("item")
    at = F.coalesce(F.sum("n_chars").over(before), F.lit(0))
    b = once.withColumn("offset", at).withColumn("piece_base", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    b = b.withColumn("here", F.when(F.col("last_pause") >= 0, F.col("offset") + F.col("last_pause")))
    b = b.withColumn("gap", F.when(F.col("first_pause") >= 0, F.col("offset") + F.col("first_pause") - F.coalesce(F.max("here").over(before), F.lit(-1)) - 1))
    b = b.withColumn("total", F.sum("n_chars").over(item)).withColumn("tail", F.col("total") - F.coalesce(F.max("here").over(item), F.lit(-1)) - 1)
    longest = F.greatest(F.max("stretch").over(item), F.coalesce(F.max("gap").over(item), F.lit(0)), F.col("tail"))
    return b.select("item", "h", "k", "offset", "piece_base", "total", longest.alias("longest"))


def _joined(emitted: DataFrame, boundaries: DataFrame, name: str, kind: str) -> DataFrame:
    """Pieces at their places in the item."""
    placed = emitted.join(_stitched(boundaries), ["item", "h", "k"]).select(
        F.col("item").cast(kind).alias(name),
        (F.col("piece_base") + F.col("n")).alias("piece_no"),
        (F.col("offset") + F.col("s")).alias("start_pos"),
        (F.col("offset") + F.col("e")).alias("end_pos"),
        "cut",
        "piece",
        F.col("total").alias("n_chars"),
        F.col("longest").alias("longest_stretch"),
    )
    return placed.dropDuplicates([name, "piece_no"])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [c.split() for c in ddl.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


# --- columns of texts --------------------------------------------------------------


def _ranges(x: str, grid: int, size: int, limit: int, overlap: int) -> Iterator[tuple[str, list[int], int, bool, bool]]:
    """(part that is read, grid points in it, number of its first cell, whether it is the first, the last range) of a text."""
    last = max(0, (len(x) - limit - 1) // grid)  # the last cell has more than the limit, and so no anchor at its end
    each, halo = max(1, size // grid), limit + overlap + 64
    for k in range(0, last + 1, each):
        points = [grid * j for j in range(k, min(k + each, last + 1))]
        final = points[-1] == grid * last
        end = len(x) if final else points[-1] + grid
        begin = max(0, points[0] - overlap - 64)
        part = x[begin : end if final else min(len(x), end + halo)]
        yield part, [p - begin for p in [*points, end]], k, k == 0, final


def oversized_pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int | None = None) -> DataFrame:
    """Pieces of the records longer than ``limit``: rec_id, piece_no, start_pos, end_pos, cut, piece, n_chars and longest_stretch of the record.

    ``size``: characters of a range, whatever they are, the pieces are the same.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    grid = GRID * limit
    size = CELLS * grid if size is None else size
    rows = df.select(F.col(key).cast("string").alias("item"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > limit))

    def each(work, ddl: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, h, x in zip(*(c.to_pylist() for c in b.columns)):
                    for part, marks, k, first, final in _ranges(x, grid, size, limit, overlap):
                        yield _batch([(i, h, *r) for r in work(part, marks, k, first, final, limit, overlap)], ddl)

        return run

    boundaries = stored(rows.mapInArrow(each(_bound, BOUNDARIES), BOUNDARIES), "split-boundaries")
    return _joined(rows.mapInArrow(each(_pieces, EMITTED), EMITTED), boundaries, "rec_id", "long")


# --- files -------------------------------------------------------------------------


def split_files(spark: SparkSession, files: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = 64 << 20) -> DataFrame:
    """path, piece_no, start_pos, end_pos, cut, piece, n_chars, longest_stretch of UTF-8 files that all executors can read, of any size.

    Each task reads its byte range and a halo.  Positions are in characters.  Bytes
    that aren't UTF-8 count as one replacement character each.
    """
    from pyarrow import fs

    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    grid, halo = 4 * GRID * limit, 4 * (limit + overlap + 64)
    each = max(1, size // grid)
    ranges = []
    for path in files:
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        n = system.get_file_info(at).size
        last = max(0, (n - 4 * limit - 1) // grid)
        ranges += [(path, k, min(k + each, last + 1), last, n) for k in range(0, last + 1, each)]

    def read(path: str, k: int, until: int, last: int, n: int) -> tuple[str, list[int]]:
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        points = [grid * j for j in range(k, until)] + [n if until > last else grid * until]
        begin = max(0, points[0] - halo)
        with system.open_input_file(at) as f:
            data = f.read_at(min(n, points[-1] + halo) - begin, begin)

        def whole(p: int) -> int:  # a grid point is the first whole character at or after its byte
            while 0 < p < len(data) and (data[p] & 0xC0) == 0x80:
                p += 1
            return p

        at = [whole(p - begin) for p in points]
        texts = [data[p:q].decode("utf-8", "replace") for p, q in zip([whole(1) if begin and (data[0] & 0xC0) == 0x80 else 0, *at], [*at, len(data)])]
        sums = [0]
        for t in texts:
            sums.append(sums[-1] + len(t))
        return "".join(texts), sums[1:-1]

    def over(work, ddl: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, k, until, last, n in zip(*(c.to_pylist() for c in b.columns)):
                    part, marks = read(path, k, until, last, n)
                    yield _batch([(path, 0, *r) for r in work(part, marks, k, k == 0, until > last, limit, overlap)], ddl)

        return run

    todo = spark.createDataFrame(ranges, "item string, k long, until long, last long, n long").repartition(max(1, min(len(ranges), 100_000)), "item", "k")
    boundaries = stored(todo.mapInArrow(over(_bound, BOUNDARIES), BOUNDARIES), "split-boundaries")
    return _joined(todo.mapInArrow(over(_pieces, EMITTED), EMITTED), boundaries, "path", "string")
