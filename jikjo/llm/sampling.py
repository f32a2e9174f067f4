"""A uniform sample of fixed size from data of unknown length that arrives in pieces.

Every distinct key has a random key, a hash of the record's key and a seed, 128 bits
as hexadecimal digits.  The random keys of each piece are appended to a stored table
(``append_keys``); what late and repeated deliveries append again counts once, as
``threshold`` takes the distinct keys.  The sample is the k records of the smallest
random keys.  The k-th smallest is found exactly by a radix
histogram: counts of the first digits over all keys, combined in each task; the bin
that holds the k-th; then the next digits within that bin, until the bin is settled.
A filter at that key gives the sample.  There is no global sort and no heap, and the
driver sees one histogram of 16^3 bins at a time.

Ties: two keys never share a random key but by a 128-bit collision, and then both or
neither are in.  Null keys are passed over.  With fewer than k distinct keys the
sample is all of them.  Which delivery of a record is given: the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jikjo.storage import stored

DIGITS, LENGTH = 3, 32


def random_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def append_keys(piece: DataFrame, key: str, seed: int, path: str) -> None:
    """Add one delivery's random keys to the stored table; for use as the body of ``foreachBatch``."""
    piece.where(F.col(key).isNotNull()).select(random_key(key, seed).alias("h")).distinct().write.mode("append").parquet(path)


def threshold(keys: DataFrame, k: int) -> str | None:
    """The k-th smallest of the distinct random keys ``h``, None if there are no more than k.  ``keys`` may hold a key more than once."""
    keys = stored(keys.select("h").distinct(), "sample-keys")
    prefix, left = "", k
    if k <= 0:
        return ""
    while len(prefix) < LENGTH:
        width = min(DIGITS, LENGTH - len(prefix))
        digits = F.substring("h", len(prefix) + 1, width).alias("d")
        bins = keys.where(F.col("h").startswith(prefix)).groupBy(digits).agg(F.count("*").alias("n")).collect()
        bins = sorted((r.d, r.n) for r in bins)  # at most 16^DIGITS rows
        if not prefix and sum(n for _, n in bins) <= k:
            return None
        for d, n in bins:
            if n >= left:
                prefix += d
                if n == left:  # all of this bin are in
                    return prefix + "g"  # above every key of the bin, below the next
                break
            left -= n
    return prefix + "g"


def sample(df: DataFrame, key: str, k: int, seed: int = 42, earliest: list[str] = ()) -> DataFrame:
    """k distinct records of ``df``, each distinct key having the same chance; one delivery of each."""
    rows = df.where(F.col(key).isNotNull()).withColumn("__h", random_key(key, seed))
    top = threshold(rows.select(F.col("__h").alias("h")), k)
    chosen = rows if top is None else rows.where(F.col("__h") < F.lit(top))
    cols = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*cols), F.struct(*earliest, *[F.xxhash64(c) for c in cols[:1]]))
    return chosen.groupBy(key).agg(first.alias("__r")).select(key, "__r.*").select(*df.columns)
