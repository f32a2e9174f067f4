"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mixture's size is cut into blocks of equal tokens, and the blocks are given to
sources by the highest quotients target / (2 k + 1): integer quotas that sum to the
total.  A source's quota ends at what ``max_repeats`` passes over it hold; the
blocks it can't take go on by the same rule.  The quotients' order is found by
bisection on the divisor, so a quota of a billion blocks costs no more than of ten.

A source's quota is apportioned again, to groups of shards and within a group to its
shards (records by a hash of their key), by their tokens.  There are as many shards as
the data need for ``SHARD_TOKENS`` each, and as many groups as a group has shards: the
driver sees a row for each group, about the square root of the shards, a task those of
one group, and the shards' quotas are a table.  In a shard the records of a source
stand in a seeded order, laid end to end and cut into blocks; a record belongs to the
block in which its middle lies.  A quota is whole passes over the shard, and for the
rest blocks in a seeded order until their tokens reach it.

Records without a source, of a source without a target or without tokens are in no
mixture.  Repeated rows of a key count once; other columns are ignored.  Targets are
normalised to sum to 1; a null or negative one is 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jikjo.storage import stored

BLOCK, SHARD_TOKENS = 1_024, 16_000_000


def apportion(weights: dict[str, float], caps: dict[str, int], seats: int) -> dict[str, int]:
    """Seats by the highest quotients weight / (2 k + 1), at most ``caps`` each; ties go to the smaller name.

    Fewer than ``seats`` are given only when every cap is reached.
    """
    names = sorted(n for n, w in weights.items() if w > 0 and caps.get(n, 0) > 0)
    seats = min(seats, sum(caps[n] for n in names))
    got = dict.fromkeys(weights, 0)
    if not names or seats <= 0:
        return got

    def given(level: float) -> dict[str, int]:
        """Seats whose quotient is above the level."""
        return {n: min(caps[n], max(0, -int(-(weights[n] / level + 1) // 2) - 1)) for n in names}

    lo, hi = min(weights[n] / (2 * caps[n] + 2) for n in names), max(weights[n] for n in names)
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if sum(given(mid).values()) > seats:
            lo = mid
        else:
            hi = mid
    got |= given(hi)
    for _ in range(seats - sum(got.values())):  # ties at the last level
        n = max((n for n in names if got[n] < caps[n]), key=lambda n: (weights[n] / (2 * got[n] + 1), [-ord(c) for c in n]))
        got[n] += 1
    return got


def _lookup(values: dict[str, int], kind: str) -> Column:
    """Of ``source`` its value, null for other sources."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("source")].cast(kind) if values else F.lit(None).cast(kind)


def mix(sized: DataFrame, key: str, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture: key, source, n_tokens, copies; report: a row for each target).

    ``sized``: key, source, n_tokens; ``targets``: source, target_share, max_repeats.
    ``total``: tokens of the mixture; the tokens of all records of target sources if None.
    """
    spark = sized.sparkSession
    want = {r.source: (max(0.0, r.target_share or 0.0), max(0, r.max_repeats or 0)) for r in targets.where("source is not null").collect()}
    whole = sum(w for w, _ in want.values()) or 1.0
    rows = sized.where(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0)).groupBy(key).agg(F.max(F.struct("n_tokens", "source")).alias("m"))
    rows = stored(rows.select(key, "m.source", "m.n_tokens"), "mix-sizes")
    everything = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, everything // SHARD_TOKENS)
    groups = max(1, round(shards**0.5))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)))
    sums = rows.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.col("shard") % groups)
    sums = stored(sums.withColumn("cap", F.floor(F.col("n") * _lookup({s: m for s, (_, m) in want.items()}, "int") / block)), "mix-shards")
    have: dict[str, dict[str, tuple[int, int]]] = {s: {} for s in want}
    for r in sums.groupBy("source", "group").agg(F.sum("n").alias("n"), F.sum("cap").alias("cap")).collect():  # one row for each target and group
        have[r.source][f"{r.group:08d}"] = r.n, r.cap
    caps = {s: {k: c for k, (_, c) in have[s].items()} for s in want}
    blocks = apportion({s: w / whole for s, (w, _) in want.items()}, {s: sum(caps[s].values()) for s in want}, (everything if total is None else total) // block)
    plan = [(s, int(k), b) for s in want for k, b in apportion({k: float(n) for k, (n, _) in have[s].items()}, caps[s], blocks[s]).items()]
    seats = spark.createDataFrame(plan, "source string, group long, seats long")

    def divide(frame: pd.DataFrame) -> pd.DataFrame:
        names = [f"{k:012d}" for k in frame["shard"]]
        got = apportion(dict(zip(names, frame.n.astype(float))), dict(zip(names, frame.cap.astype(int))), int(frame.seats.iloc[0]))
        tokens = np.array([got[n] for n in names], np.int64) * block
        return pd.DataFrame({"source": frame.source, "shard": frame["shard"], "passes": tokens // frame.n, "rest": tokens % frame.n})

    quotas = sums.join(F.broadcast(seats), ["source", "group"]).groupBy("source", "group").applyInPandas(divide, "source string, shard long, passes long, rest long")
    quotas = stored(quotas.where("passes > 0 or rest > 0"), "mix-quotas")
    here = Window.partitionBy("source", "shard")
    laid = here.orderBy(F.xxhash64(F.lit(seed), key), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(quotas, ["source", "shard"]).withColumn("block", F.floor((F.sum("n_tokens").over(laid) - F.col("n_tokens") / 2) / block))
    placed = placed.withColumn("turn", F.xxhash64(F.lit(seed), "source", "shard", "block"))
    drawn = F.sum("n_tokens").over(here.orderBy("turn", "block").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("drawn", drawn).withColumn("own", F.sum("n_tokens").over(Window.partitionBy("source", "shard", "turn", "block")))
    mixture = placed.withColumn("copies", F.col("passes") + (F.col("drawn") - F.col("own") / 2 < F.col("rest")).cast("long"))
    mixture = mixture.where("copies > 0").select(key, "source", "n_tokens", "copies")
    sizes = spark.createDataFrame(
        [(s, w / whole, m, sum(n for n, _ in have[s].values()), blocks[s], block) for s, (w, m) in want.items()],
        "source string, target_share double, max_repeats int, available_tokens long, quota_blocks long, block_tokens int",
    )
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    report = sizes.join(used, "source", "left").fillna(0, ["tokens", "most_copies"])
    report = report.withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
    return mixture, report
