"""Filling containers of fixed capacity: vector best-fit.

A container has a residual capacity in three resources: tokens, number of
documents, and attention cost (the sum of squared lengths, as documents of one
container don't attend to each other).  An item goes to the open container that can
take it under every constraint and whose weighted residual norm is then smallest; if
none can, a new one is opened.  Items come largest first.  The attention capacity is
below that of one item that fills a container, so it keeps long items from company; an
item alone is always admitted.

A record longer than the capacity fills containers of its own; only its rest, like
every record that fits, is an item and is never split.  Items are spread by a hash
over shards of about ``SHARD`` items, whatever their number or source, and every
shard is packed by itself: a shard leaves a few containers part-filled, which is
under 0.1 % of its containers.  No task holds more than a shard.

A record without tokens (null or empty text) takes no room: one row, its container
null.  A null key is passed over; repeated rows of a key count once, by their
largest size; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 2_000
#: Most documents in one container; attention cost that one may hold, as a share of capacity squared; weights of the three residuals.
MOST_DOCUMENTS, ATTENTION, WEIGHTS = 32, 0.97, (1.0, 0.02, 0.05)


def best_fit(sizes: np.ndarray, capacity: int, documents: int = MOST_DOCUMENTS, attention: float = ATTENTION, weights: tuple = WEIGHTS) -> np.ndarray:
    """The container of each item; ``sizes`` in any order, each at most ``capacity``."""
    full = np.array([capacity, documents, attention * capacity * capacity], float)
    order = np.argsort(-sizes, kind="stable")
    rest = np.empty((len(sizes), 3))
    out = np.empty(len(sizes), np.int64)
    w, n = np.array(weights), 0
    open_ = np.zeros(0, np.int64)  # containers that may still take the smallest item
    least = sizes.min(initial=1)
    for i in order:
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        left = rest[open_] - need
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            k = open_[fits[np.argmin(((left[fits] / full) ** 2 @ w))]]
        else:
            k, n = n, n + 1
            rest[k] = full
            open_ = np.append(open_, k)
        rest[k] -= need
        out[i] = k
        if rest[k, 0] < least or rest[k, 1] < 1 or rest[k, 2] < float(least) * least:
            open_ = open_[open_ != k]
    return out


def pack(sized: DataFrame, key: str, capacities: DataFrame, **limits: float) -> DataFrame:
    """seq_len, container_id, key, piece_no, token_from, n_tokens of each record for each capacity.

    ``sized``: key and n_tokens; ``capacities``: a small table with seq_len.
    """
    kind = dict(sized.dtypes)[key]
    each = sized.groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))
    lens = sorted({int(r.seq_len) for r in capacities.select("seq_len").where("seq_len > 0").distinct().collect()})
    rows = each.withColumn("seq_len", F.explode(F.array(*[F.lit(n) for n in lens]) if lens else F.array().cast("array<int>")))
    rows = rows.withColumn("whole", F.floor(F.col("n_tokens") / F.col("seq_len"))).withColumn("rest", F.col("n_tokens") % F.col("seq_len"))
    key_text = F.col(key).cast("string")
    full = rows.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece_no"))
    full = full.select(
        "seq_len", F.concat(F.lit("w"), key_text, F.lit("."), F.col("piece_no")).alias("container_id"), key, "piece_no",
        (F.col("piece_no") * F.col("seq_len")).alias("token_from"), F.col("seq_len").cast("long").alias("n_tokens"),
    )
    none = rows.where("n_tokens = 0").select(
        "seq_len", F.lit(None).cast("string").alias("container_id"), key, F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("token_from"), F.lit(0).cast("long").alias("n_tokens")
    )
    items = rows.where("rest > 0").select("seq_len", key, F.col("whole").alias("piece_no"), (F.col("n_tokens") - F.col("rest")).alias("token_from"), F.col("rest").alias("n_tokens"))
    shards = max(1, round(each.count() / SHARD))
    items = items.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", key], ascending=[False, True], kind="stable")
        k = best_fit(frame.n_tokens.to_numpy(), int(frame.seq_len.iloc[0]), **limits)
        name = str(frame["shard"].iloc[0])
        return frame.assign(container_id=[f"s{name}.{c}" for c in k])[["seq_len", "container_id", key, "piece_no", "token_from", "n_tokens"]]

    ddl = f"seq_len int, container_id string, `{key}` {kind}, piece_no long, token_from long, n_tokens long"
    return items.groupBy("seq_len", "shard").applyInPandas(fit, ddl).unionByName(full).unionByName(none)


def containers(packed: DataFrame, documents: int = MOST_DOCUMENTS, attention: float = ATTENTION) -> DataFrame:
    """One row for each container: what it holds, and what is left of each capacity (of attention less than nothing where one long item is alone)."""
    size = F.col("n_tokens").cast("double")
    each = packed.where("container_id is not null").groupBy("seq_len", "container_id")
    each = each.agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("tokens"), F.sum(size * size).alias("attention"))
    return (
        each.withColumn("rest_tokens", F.col("seq_len") - F.col("tokens"))
        .withColumn("rest_documents", F.lit(documents) - F.col("n_documents"))
        .withColumn("rest_attention", F.lit(attention) * F.col("seq_len").cast("double") * F.col("seq_len") - F.col("attention"))
    )


def fill(packed: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens, the share of room used, and the shares of document and attention capacity used."""
    c = containers(packed)
    return (
        c.groupBy("seq_len")
        .agg(
            F.count("*").alias("containers"),
            F.sum("tokens").alias("tokens"),
            F.max("n_documents").alias("most_documents"),
            F.avg(F.col("n_documents") / F.lit(MOST_DOCUMENTS)).alias("documents_used"),
            F.avg(F.col("attention") / (F.col("attention") + F.col("rest_attention"))).alias("attention_used"),
        )
        .withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("seq_len")))
    )
