"""Evaluation passages inside training text, found through a stored positional inverted index.

``build_index`` reads the training text once and stores the index; ``leaks`` searches
a stored index for any table of items, so the text is scanned once however many items
or searches there are.

The index is partitioned by document.  A row group is a shard: the terms of its documents
in order, and for each the sorted list of the positions at which it stands.  Its rows are
``PIECES`` equal parts of those bytes, so that the JVM copies small rows and buffers one
shard at a time.  A term is a run of ``WIDTH`` letters or digits of the text in NFKC and
lower case, so that spacing, punctuation, letter form and markup don't matter, and a
replaced word breaks only the terms that touch it.  Every position of every document is
posted.

Search, in each shard:

1. The lists of an item's terms are read from the rarest in this shard on.  The most
   frequent ones are left out as long as they cover less than ``LEFT_OUT`` of the
   characters that a match needs.  So what is read must cover the rest of them in
   every match: a bound that holds for each item, of 12 characters or of 12,000.
2. The lists are intersected after adjusting offsets (position in the document less
   position in the item).  Hits within a band of offsets (proximity) that cover enough
   make a candidate.
3. Of a candidate the lists of all terms are read, within its document: the best
   stretch no longer than the item with some room, how much of the item it covers,
   and whether the whole item stands there (exact phrase).

Items come as a table and are searched ``BLOCK_CHARS`` characters at a time; a block is
bounded, and is the only thing that is collected or broadcast.  Nothing of the corpus
is.  Null, blank or short texts match nothing; of an item with fewer than ``LEAST``
kept characters half can't be told from chance, so it is passed over; repeated
deliveries give one row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jikjo.functions.codepoints import grams, kept, slices
from jikjo.storage import stored

WIDTH, LEAST = 6, 12
BAND = 24
#: Share of a match's characters that the terms not read at first may cover.
LEFT_OUT = 0.5
BLOCK_CHARS, SHARD_BYTES = 2_000_000, 1_500_000
_MARKUP = re.compile(r"<[^<>]{1,200}>|&(?:#\d+|[a-zA-Z]+);|\[MASK\]|https?://\S+")


def _plain(x: str | None) -> str:
    if x is None:
        return ""
    return _MARKUP.sub(" ", x) if "<" in x or "&" in x or "[" in x or "://" in x else x


def _inside(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place at which a term fits into a text: the text, and the place in the joined texts."""
    n = np.maximum(0, np.diff(at) - WIDTH + 1)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, at[:-1][owner] + np.arange(n.sum()) - (np.cumsum(n) - n)[owner]


def _terms(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """40 bits of the hash of the term at each place: a list is seldom shared by two terms of a shard."""
    return grams(points, WIDTH)[place] >> np.uint64(24) if len(place) else np.zeros(0, np.uint64)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _planes(a: np.ndarray) -> bytes:
    """The number of bytes that the largest value takes; the first bytes of all numbers, then the second ones ..."""
    n = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    return bytes([n]) + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :n].T).tobytes()


def _numbers(b: memoryview, kind: type) -> np.ndarray:
    n, size = b[0], np.dtype(kind).itemsize
    out = np.zeros(((len(b) - 1) // n, size), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8, offset=1).reshape(n, -1).T
    return out.view(kind).ravel()


# --- the index ---------------------------------------------------------------------

#: Parts of a shard: row ids, ends, terms, counts, places; and the pieces in which they are stored.
PARTS, PIECES = 5, 16
INDEX = "piece int, data binary"
#: Row groups of one shard, pages of one piece, and no dictionary of pieces: shards are read and written one at a time, and none is parted.
LAYOUT = {"parquet.block.row.count.limit": str(PIECES), "parquet.page.size": "100000", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def _cut(parts: list[bytes]) -> pa.RecordBatch:
    """The rows of a shard: the sizes of its parts and the parts, cut into pieces."""
    data = np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)
    size = -(-len(data) // PIECES)
    cut = [data[k : k + size] for k in range(0, PIECES * size, size)]
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(cut, pa.binary())], ["piece", "data"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[memoryview]]:
    """The parts of each shard, of rows as they were stored; a batch may end within a shard."""
    got: list[bytes] = []
    for b in batches:
        for k in range(b.num_rows):
            if b.column(0)[k].as_py() != len(got):
                raise ValueError("the pieces of a shard of the index are parted")
            got.append(b.column(1)[k].as_py())
            if len(got) == PIECES:
                data = memoryview(b"".join(got))
                got = []
                ends = np.cumsum(np.append(8 * PARTS, np.frombuffer(data[: 8 * PARTS], np.int64))).tolist()
                if ends[-1] != len(data):
                    raise ValueError("a shard of the index isn't whole")
                yield [data[a:z] for a, z in zip(ends, ends[1:])]
    if got:
        raise ValueError("the pieces of a shard of the index are parted")


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of an Arrow batch: document keys, where each ends, terms in order, how often each occurs, and where."""
    for whole in batches:
        for b in slices(whole, 1, SHARD_BYTES):
            points, at = kept([_plain(x) for x in b.column(1).to_pylist()])
            _, place = _inside(at)
            h = _terms(points, place)
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            parts = [
                b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                at[1:].astype(np.int64).tobytes(),
                _planes(np.diff(h[first], prepend=np.uint64(0))),
                _planes(np.diff(np.append(first, len(h))).astype(np.uint32)),
                _planes(place[order].astype(np.uint32)),
            ]
            yield _cut(parts)


def build_index(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """The positional index of all rows that have a key and a text, stored in the shared folder."""
    rows = corpus.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).where("row_id is not null and text is not null")
    return stored(rows.mapInArrow(_post, INDEX), "leak-index", codec="zstd", **LAYOUT)


# --- the items ---------------------------------------------------------------------


@dataclass
class Items:
    """The items of one block: of every place of every item its term, the item and the place."""

    names: list[tuple[str, int]]
    sizes: np.ndarray
    need: np.ndarray  # characters that a match must cover
    terms: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int, str]], share: float) -> Items:
        points, at = kept([_plain(r[2]) for r in rows])
        sizes = np.diff(at)
        owner, place = _inside(at)
        use = (sizes >= LEAST)[owner]
        owner, place = owner[use], place[use]
        return cls([r[:2] for r in rows], sizes, np.maximum(share * sizes, 1), _terms(points, place), owner, place - at[:-1][owner])

    def rare(self, df: np.ndarray) -> np.ndarray:
        """True at the places whose terms must be read: all but the most frequent ones that cover less than they may."""
        order = np.lexsort((-df, self.item))
        begin = np.searchsorted(self.item, np.arange(len(self.sizes)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - begin[self.item[order]]
        # the rank at which each character of an item is first covered, and from there the characters covered up to each rank
        at = np.concatenate(([0], np.cumsum(self.sizes)))
        first = np.full(at[-1], np.iinfo(np.int64).max)
        spot = at[self.item] + self.place
        for k in range(WIDTH):
            np.minimum.at(first, spot + k, rank)
        covered = np.zeros(len(order) + 1, np.int64)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        some = first < np.iinfo(np.int64).max
        np.add.at(covered, begin[owner[some]] + first[some], 1)
        total = np.cumsum(covered[:-1])
        before = np.concatenate(([0], total))[begin]
        upto = total - before[self.item[order]]
        out = np.empty(len(order), bool)
        out[order] = upto >= LEFT_OUT * self.need[self.item[order]]
        return out


# --- the search --------------------------------------------------------------------


def passage(size: int, place: np.ndarray, at: np.ndarray) -> tuple[int, int, int, int]:
    """The best passage of one item in one document: item characters covered, first and last item position, document start.

    ``place`` and ``at`` are the positions of equal terms.  Terms belong together
    while their offset drifts by at most BAND from one to the next.
    """
    shift = at - place
    order = np.lexsort((at, shift))
    best = (0, 0, 0, 0)
    cuts = np.flatnonzero(np.diff(shift[order]) > BAND) + 1
    for part in np.split(order, cuts):
        if len(part) * WIDTH < best[0]:
            continue
        part = part[np.argsort(at[part], kind="stable")]
        # within a band, a stretch of the document no longer than the item with some room
        p, a = place[part], at[part]
        for lo in np.concatenate(([0], np.flatnonzero(np.diff(a) > size // 2) + 1)):
            q = np.unique(p[lo : np.searchsorted(a, a[lo] + size + 2 * BAND, "right")])
            covered = np.zeros(size, bool)
            for k in range(WIDTH):
                covered[q + k] = True
            if (c := int(covered.sum())) > best[0]:
                best = (c, int(q[0]), int(q[-1]) + WIDTH, int(a[lo]))
    return best


class Shard:
    """One shard of the index."""

    def __init__(self, row_ids: memoryview, ends: memoryview, terms: memoryview, counts: memoryview, places: memoryview) -> None:
        self.row_ids, self.ends = np.frombuffer(row_ids, np.int64), np.frombuffer(ends, np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1]))
        self.terms = np.cumsum(_numbers(terms, np.uint64), dtype=np.uint64)
        self.counts = _numbers(counts, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.places = _numbers(places, np.uint32).astype(np.int64)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins, and its length (0: the term isn't here)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.first[k], np.where(self.terms[k] == terms, self.counts[k], 0)

    def candidates(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) in which the terms that are read cover enough within a band of offsets."""
        first, df = self.lists(items.terms)
        use = np.flatnonzero(items.rare(df) & (df > 0))
        at = self.places[_spans(first[use], df[use])]
        ask = np.repeat(use, df[use])
        doc = np.searchsorted(self.ends, at, "right")
        pair, place = doc * len(items.names) + items.item[ask], items.place[ask]
        shift = at - self.begins[doc] - place
        order = np.lexsort((shift, pair))
        pair, place, shift = pair[order], place[order], shift[order]
        new = np.ones(len(pair), bool)
        new[1:] = (np.diff(pair) != 0) | (np.diff(shift) > 3 * BAND)
        band, of = np.cumsum(new) - 1, pair[new]
        need = (1 - LEFT_OUT) * items.need[of % len(items.names)]
        some = (np.bincount(band, minlength=len(of)) * WIDTH >= need)[band]  # few are left to be sorted
        band, place = band[some], place[some]
        order = np.lexsort((place, band))
        band, place = band[order], place[order]
        fresh = np.full(len(band), WIDTH)
        fresh[:-1] = np.where(np.diff(band) == 0, np.minimum(WIDTH, np.diff(place)), WIDTH)
        pair = np.unique(of[np.bincount(band, fresh, minlength=len(of)) >= need])
        return pair // len(items.names), pair % len(items.names)

    def hits(self, first: np.ndarray, df: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """Of lists, given by begin and length, the entries within one document: which list, and the position in the document."""
        lo, hi = self.begins[doc], self.ends[doc]
        got = [self.places[a + np.searchsorted(p, lo) : a + np.searchsorted(p, hi)] for a, n in zip(first, df) for p in [self.places[a : a + n]]]
        return np.repeat(np.arange(len(got)), [len(g) for g in got]), np.concatenate(got) - lo if got else np.zeros(0, np.int64)


def _search(items: Items, share: float):
    begin = np.searchsorted(items.item, np.arange(len(items.sizes) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _whole(batches):
            shard = Shard(*parts)
            out: list[tuple] = []
            for d, i in zip(*(x.tolist() for x in shard.candidates(items))):
                mine = slice(begin[i], begin[i + 1])
                which, at = shard.hits(*shard.lists(items.terms[mine]), d)
                size = int(items.sizes[i])
                covered, first, last, start = passage(size, items.place[mine][which], at)
                if covered >= share * size:
                    out.append((*items.names[i], int(shard.row_ids[d]), covered, size, first, last, start, covered == size))
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r)) for r in out], SCHEMA)

    return run


FIELDS = ["bench", "item_id", "row_id", "covered", "item_size", "item_from", "item_to", "doc_from", "exact_phrase"]
SCHEMA = pa.schema([pa.field(n, t) for n, t in zip(FIELDS, [pa.string()] + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int32()] * 2 + [pa.int64(), pa.bool_()])])
DDL = "bench string, item_id long, row_id long, covered int, item_size int, item_from int, item_to int, doc_from long, exact_phrase boolean"


def leaks(index: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """Rows of an index that contain an item's passage of which at least ``share`` of the item's kept characters match.

    ``items``: bench, item_id, text.  One row for each (bench, item_id, row_id): matched
    characters, the item's kept length, the item's and the document's position (in kept
    characters), and whether the whole item stands there letter by letter.
    """
    items = items.select("bench", F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    found = index.sparkSession.createDataFrame([], DDL)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("bench", "item_id", "text"), F.lit(blocks)) == k)
        block = Items.of([tuple(r) for r in mine.collect()], share)  # about BLOCK_CHARS characters
        found = found.union(index.mapInArrow(_search(block, share), DDL))
    best = F.max(F.struct("covered", "item_size", "item_from", "item_to", "doc_from", "exact_phrase"))
    return found.groupBy("bench", "item_id", "row_id").agg(best.alias("m")).select("bench", "item_id", "row_id", "m.*")
