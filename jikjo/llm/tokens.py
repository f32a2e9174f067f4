"""Sizes in tokens of a public tokenizer; its vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern by which the vocabulary's tokenizer cuts text before merging: a fixed value of that tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(df: DataFrame, key: str, text: str, keep: list[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """key, kept columns and n_tokens of every row with a key; a null text has 0 tokens.  The texts go no further than this scan."""
    kinds = dict(df.dtypes)
    cols = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = [0 if not x else len(enc.encode_ordinary(x)) for x in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(cols))] + [pa.array(n, pa.int64())], [*cols, "n_tokens"])

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", n_tokens long"
    return df.where(F.col(key).isNotNull()).select(*cols, text).mapInArrow(run, ddl)
