"""Near-duplicate records with small edits: an LSH forest over MinHash signatures.

``near_pairs`` gives every pair whose shingle similarity reaches the threshold,
``near_classes`` one row for each record with its class and its number of links.

Plan
1. One Arrow pass turns each text into a 128-bit fingerprint of its kept
   characters and a signature of ``TREES * DEPTH`` 16-bit MinHash values.  The
   table is written once.
2. Records of equal fingerprint form one class (map-side combined); only its
   smallest id goes on, so that a group of copies that holds a third of all rows
   costs one row in the forest.
3. Each tree is a sorted order of the signatures: its rows stand by their common
   prefixes.  The depth is adaptive by region: where at most ``REGION`` rows share a
   prefix of ``SHALLOW`` values, all of them are candidates of each other; a more
   crowded region is split by one more value, and there too all pairs of a
   (sub)region are candidates, whatever its size.  So a sparse region is searched
   more widely, and a crowded one loses no pair to a bound on neighbours.
4. A subregion of at most ``REGION`` rows is compared where it is sorted; the rows of
   a larger one are spread over tiles of ``TILE`` x ``TILE`` rows and compared by many
   tasks.  Two bits of each of ``SKETCH`` further MinHash values travel with a row, into
   the tiles too; a candidate that differs in over ``FAR`` of them is no match (for
   similarity 0.6 the chance to be lost here is below 1e-4).  What remains is verified exactly
   on the texts.

A group of near copies may hold a third of all rows, and then its prefix is hot in
every tree.  Prefixes are counted first, in ``BUCKETS`` bins that each task combines;
only where a bin stands out are its prefixes counted one by one.  A prefix with more
than ``HOT`` rows is partitioned by all its values, and if those are hot too, the rows
go to the tiles at once, so that no partition holds them all.

Null, blank and short texts have no shingles and so no partners.  In ``near_classes``
short texts of equal kept characters share a class; null and blank ones stand alone.
Repeated deliveries of one id count once; should their texts differ, the one of the
smallest hash is the record's.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jikjo.functions.codepoints import grams, kept, mix, slices
from jikjo.storage import stored

TREES, DEPTH, SHALLOW = 20, 3, 2
REGION, TILE = 24, 200
#: Further MinHash values of which two bits each are kept, and how many of them may differ.
SKETCH, FAR = 64, 34
HOT, BUCKETS = 100_000, 1 << 14
#: Rows of a table of hot prefixes up to which it is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000
_SEEDS = mix(np.arange(1, TREES * 6 + SKETCH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SEEDS = np.concatenate([_SEEDS[: TREES * 6].reshape(TREES, 6)[:, :DEPTH].ravel(), _SEEDS[TREES * 6 :]])  # six were drawn for each tree
_A = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS >> np.uint64(32)).astype(np.uint32)
DEEPER = 16 * (DEPTH - SHALLOW)  # bits of a head that a shallow prefix leaves out


def signatures(shingles: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash of each run of shingles (``begin`` is where each starts; none is empty): forest values, and two words of one bit of each further value."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(begin), TREES * DEPTH), np.uint16)
    word, more = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for k in range(TREES * DEPTH + SKETCH):
        least = np.minimum.reduceat(x * _A[k] + _B[k], begin)
        # a multiplicative hash has its entropy in the high bits; the least values differ in the middle ones
        least = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        if k < TREES * DEPTH:
            low[:, k] = least
        else:
            at = np.uint64(k - TREES * DEPTH)
            word |= (least & np.uint32(1)).astype(np.uint64) << at
            more |= ((least >> np.uint32(1)) & np.uint32(1)).astype(np.uint64) << at
    return low, word, more


def _shingled(texts: list[str], width: int, least: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts that keep enough, where each text's begin, and which texts those are."""
    if words:
        import re

        units, ends = [], [0]
        for t in texts:
            w = re.findall(r"\w+", t.lower())
            units += w
            ends.append(len(units))
        points = pd.util.hash_array(np.array(units, object), categorize=True) if units else np.zeros(0, np.uint64)
        at = np.array(ends)
    else:
        points, at = kept(texts)
    sizes = np.diff(at)
    use = np.flatnonzero(sizes >= max(least, width))
    every = grams(points, width)
    counts = sizes[use] - width + 1
    begin = np.concatenate(([0], np.cumsum(counts)))
    index = np.repeat(at[:-1][use] - begin[:-1], counts) + np.arange(begin[-1])
    return every[index], begin, use


SIGNED = "id long, h long, f1 long, f2 long, sig binary, bits long, more long"


def _sign(width: int, least: int, words: bool):
    """A row for every record.  A text with shingles has fingerprints, signature and bits; a short one fingerprints; a blank one none."""

    def fingerprint(parts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # order matters: each part is mixed with its place
        place = (np.arange(len(parts)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
        f1 = np.add.reduceat(mix(parts + place * np.uint64(0x9E3779B97F4A7C15)), begin[:-1])
        f2 = np.add.reduceat(mix(parts ^ mix(place + np.uint64(77))), begin[:-1])
        return f1.view(np.int64), f2.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, 3_000_000):
                n = b.num_rows
                texts = ["" if x is None else x for x in b.column(2).to_pylist()]
                f1, f2, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
                h, begin, use = _shingled(texts, width, least, words)
                sig: list[bytes | None] = [None] * n
                bits, rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if len(use):
                    low, word, more = signatures(h, begin[:-1])
                    f1[use], f2[use] = fingerprint(h, begin)
                    known[use], bits[use], rest[use] = True, word.view(np.int64), more.view(np.int64)
                    for i, r in zip(use.tolist(), low):
                        sig[i] = r.tobytes()
                points, at = kept([t if s is None else "" for t, s in zip(texts, sig)])
                few = np.flatnonzero(np.diff(at))
                if len(few):
                    f1[few], f2[few] = fingerprint(mix(points.astype(np.uint64) + np.uint64(1 << 40)), np.append(at[:-1][few], at[-1]))
                    known[few] = True
                full = np.array([x is not None for x in sig], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(f1, mask=~known), pa.array(f2, mask=~known), pa.array(sig, pa.binary()), pa.array(bits, mask=~full), pa.array(rest, mask=~full)],
                    [c.split()[0] for c in SIGNED.split(", ")],
                )

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tree: its values packed with the tree, and the sketch."""
    for b in batches:
        if not b.num_rows:
            continue
        low = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, TREES, DEPTH).astype(np.int64)
        ids = b.column(0).to_numpy(zero_copy_only=False)
        bits, more = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        tree = np.arange(TREES, dtype=np.int64)[None, :]
        head = (tree << 48) | (low[:, :, 0] << 32) | (low[:, :, 1] << 16) | low[:, :, 2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(head.ravel())] + [pa.array(np.repeat(x, TREES)) for x in (ids, bits, more)],
            ["head", "id", "bits", "more"],
        )


def _near(x: np.ndarray, y: np.ndarray, more_x: np.ndarray, more_y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(((x ^ y) | (more_x ^ more_y)).view(np.uint64)) <= FAR


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates from rows sorted by head.  ``dense`` is null for a pair; for a row of a subregion over ``REGION`` it is the head.

    No more of a region is held than shows that it is crowded; the rest is passed on as it comes.
    """

    def pairs(rows: list[np.ndarray], crowded: int | None, large: int | None) -> pa.RecordBatch:
        head, ids, bits, more = rows
        prefix = head >> DEEPER
        region = np.cumsum(np.diff(prefix, prepend=prefix[:1]) != 0)
        deep = (np.bincount(region)[region] > REGION) | (prefix == crowded if crowded is not None else False)
        new = np.diff(prefix, prepend=prefix[:1]) != 0
        new |= deep & (np.diff(head, prepend=head[:1]) != 0)
        region = np.cumsum(new)
        dense = deep & ((np.bincount(region)[region] > REGION) | (head == large if large is not None else False))
        where = np.flatnonzero(~dense)
        left, right = [], []
        for step in range(1, REGION):
            where = where[where + step < len(head)]
            where = where[region[where] == region[where + step]]
            if not len(where):
                break
            near = _near(bits[where], bits[where + step], more[where], more[where + step])
            left.append(ids[where[near]])
            right.append(ids[where[near] + step])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        m = int(dense.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.minimum(a, b), ids[dense]])),
                pa.array(np.concatenate([np.maximum(a, b), bits[dense]])),
                *(pa.array(np.concatenate([np.zeros(len(a), np.int64), x[dense]]), mask=np.arange(len(a) + m) < len(a)) for x in (more, head)),
            ],
            ["a", "b", "more", "dense"],
        )

    held: list[np.ndarray] | None = None
    crowded: int | None = None  # the prefix of a region that is known to be crowded
    large: int | None = None  # the head of a subregion of which rows were passed on as dense
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        n = len(rows[0])
        if not n:
            continue
        last = rows[0][-1]
        cut = int(np.searchsorted(rows[0], (last >> DEEPER) << DEEPER))  # sorted by head: the last region may go on
        if n - cut > REGION or last >> DEEPER == crowded:
            if (before := cut) and last >> DEEPER != crowded:
                yield pairs([r[:before] for r in rows], crowded, large)
                rows, n = [r[before:] for r in rows], n - before
                large = None
            crowded = last >> DEEPER
            cut = int(np.searchsorted(rows[0], last))  # and so may its last subregion
            if n - cut > REGION or last == large:
                yield pairs(rows, crowded, large)
                large, held = last, None
                continue
        if cut:
            yield pairs([r[:cut] for r in rows], crowded, large)
        held = [r[cut:] for r in rows]
    if held is not None and len(held[0]):
        yield pairs(held, crowded, large)


def _verify(width: int, words: bool, threshold: float):
    def sets(texts: pd.Series) -> list[np.ndarray]:
        h, begin, use = _shingled(list(texts), width, 0, words)
        out = [np.zeros(0, np.uint64)] * len(texts)
        for k, u in enumerate(use):
            out[u] = np.unique(h[begin[k] : begin[k + 1]])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for o in range(0, len(whole), 1000):
                f = whole.iloc[o : o + 1000]
                x, y = sets(f.text_a), sets(f.text_b)
                both = np.array([len(np.intersect1d(p, q, True)) for p, q in zip(x, y)])
                either = np.array([len(p) + len(q) for p, q in zip(x, y)]) - both
                ok = both >= threshold * np.maximum(either, 1)
                yield f.loc[ok, ["a", "b"]].assign(similarity=(both / np.maximum(either, 1))[ok])

    return run


def _links(df: DataFrame, key: str, text: str, threshold: float, width: int, least: int, words: bool) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep, of which shingled ones have ``full``; links between representatives: a < b, similarity)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("id is not null")
    signed = rows.mapInArrow(_sign(width, least, words), SIGNED)
    first = F.min_by(F.struct("f1", "f2", "sig", "bits", "more"), F.struct(F.col("f1").isNull(), "h")).alias("r")  # of the deliveries of an id
    signed = stored(signed.groupBy("id").agg(first, F.min(F.when(F.col("f1").isNotNull(), F.col("h"))).alias("h")).select("id", "h", "r.*"), "neardup-signatures")
    reps = signed.where("sig is not null").groupBy("f1", "f2").agg(F.min_by(F.struct("id", "sig", "bits", "more"), "id").alias("r")).select("r.*")
    forest = reps.mapInArrow(_plant, "head long, id long, bits long, more long")
    spread, piled = _spread(forest)
    order = spread.repartition("part").sortWithinPartitions("head", "id").select("head", "id", "bits", "more")
    walked = stored(order.mapInArrow(_walk, "a long, b long, more long, dense long"), "neardup-candidates")
    pairs = walked.where("dense is null").select("a", "b")
    dense = walked.where("dense is not null").select("dense", F.col("a").alias("id"), F.col("b").alias("bits"), "more")
    candidates = pairs.union(_tiled(dense if piled is None else dense.union(piled))).distinct()
    candidates = stored(candidates, "neardup-pairs")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(signed.select("id", "h"), "id")
    needed = stored(rows.join(ids, ["id", "h"], "left_semi").dropDuplicates(["id"]).select("id", "text"), "neardup-texts")
    one = needed.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = needed.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    links = candidates.join(one, "a").join(two, "b").mapInPandas(_verify(width, words, threshold), "a long, b long, similarity double")
    known = signed.where("f1 is not null").select("f1", "f2", "id", F.col("sig").isNotNull().alias("full"))
    members = known.join(known.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), ["f1", "f2"]).select("id", "rep", "copies", "full")
    alone = signed.where("f1 is null").select("id", F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("full"))
    return members.union(alone), links


def _few(df: DataFrame) -> DataFrame:
    """A stored table, with the hint to broadcast it only if it is found to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _spread(forest: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows with the value they are partitioned by; rows of hot heads as dense rows, if there are any)."""
    prefix = F.shiftright("head", DEEPER)
    bucket = F.pmod(F.xxhash64(prefix), F.lit(BUCKETS))
    bins = forest.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
    counts = [(r.bin, r.n) for r in bins.collect()]  # at most BUCKETS rows
    usual = sum(n for _, n in counts) / BUCKETS
    full = [b for b, n in counts if n > HOT + 1.5 * usual]
    if not full:
        return forest.withColumn("part", prefix), None
    bins = F.broadcast(forest.sparkSession.createDataFrame([(b,) for b in full], "bin long"))  # at most BUCKETS rows
    marked = forest.withColumn("prefix", prefix).join(bins, bucket == F.col("bin"), "left")
    some = stored(marked.where("bin is not null").groupBy("prefix", "head").agg(F.count("*").alias("n")), "neardup-heads")
    deep = stored(some.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("prefix", F.lit(True).alias("deep")), "neardup-deep")
    hot = stored(some.where(F.col("n") > HOT).select("head", F.lit(True).alias("hot")), "neardup-hot")
    rows = marked.join(_few(deep), "prefix", "left").join(_few(hot), "head", "left")
    usual_ = rows.where("hot is null").select("head", "id", "bits", "more", F.when(F.col("deep"), F.col("head")).otherwise(F.col("prefix")).alias("part"))
    return usual_, rows.where("hot").select(F.col("head").alias("dense"), "id", "bits", "more")


def _tiled(dense: DataFrame) -> DataFrame:
    """All pairs of rows of one dense region whose bits are near, spread over tiles of bounded size.

    Every row is sent to the tiles of its block's row and column, so the work of a
    large region is shared by as many tasks as it has tiles.
    """
    sizes = dense.groupBy("dense").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("long").alias("blocks"))
    rows = dense.join(sizes, "dense").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("dense", "id", "bits", "more", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        block, lo, hi = frame.block.to_numpy(), frame.lo.iloc[0], frame.hi.iloc[0]
        ids, bits, more = (frame[c].to_numpy() for c in ("id", "bits", "more"))
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        near = _near(bits[x][:, None], bits[y][None, :], more[x][:, None], more[y][None, :])
        if lo == hi:
            near &= ids[x][:, None] < ids[y][None, :]
        i, j = np.nonzero(near)
        a, b = ids[x[i]], ids[y[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return tiles.groupBy("dense", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_pairs(df: DataFrame, table: str, key: str, text: str, threshold: float = 0.8, width: int = 5, least: int = 0, words: bool = True) -> DataFrame:
    """All pairs id_a < id_b of records whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    ``words``: shingles of words; else of the letters and digits kept in NFKC and lower
    case.  ``least``: units a text must keep.  Copies under different keys are pairs.
    """
    members, links = _links(df, key, text, threshold, width, least, words)
    members = members.where("full")
    x = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.union(within).select(
        F.lit(table).alias("rec_table"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    )


def near_classes(df: DataFrame, table: str, key: str, text: str, threshold: float = 0.8, width: int = 5, least: int = 0, words: bool = True) -> DataFrame:
    """One row for each record: rec_table, id, class_id and its number of links, that is of other records it is a near duplicate of.

    A class is a connected component of the links between different texts; copies
    are members of their representative's class.  They count as links, of their own
    text's records and of all that these are linked to, without being expanded into
    pairs.  ``class_id`` is the smallest id of the class.
    """
    members, links = _links(df, key, text, threshold, width, least, words)
    members, links = stored(members, "neardup-members"), stored(links.select("a", "b"), "neardup-links")
    weight = members.where("id = rep").select(F.col("rep").alias("b"), "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(weight, "b")
    degree = both.groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("n"))
    classes = components(links).withColumnRenamed("id", "rep")
    each = weight.withColumnRenamed("b", "rep").join(classes, "rep", "left").join(degree, "rep", "left")
    each = each.select("rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return members.join(each, "rep").select(F.lit(table).alias("rec_table"), "id", "class_id", "n_links")


def components(links: DataFrame) -> DataFrame:
    """id, class_id (the smallest id reachable) of links a < b, by alternating large-star and small-star steps.

    Each step is two shuffles of the remaining links, and the number of steps grows
    with the logarithm of the longest path.  Each step's links are a stored table.
    A hub's neighbours are never gathered: minima are aggregated, then joined back.
    """
    edges = links.select("a", "b").where("a <> b").distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = stored(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "neardup-star")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    child = edges.groupBy("b").agg(F.min("a").alias("class_id")).select(F.col("b").alias("id"), "class_id")
    return child.union(child.select(F.col("class_id").alias("id"), "class_id").distinct())
