"""A byte-level BPE tokenizer, read from its vocabulary file where it is used."""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer(NamedTuple):
    """Carries the path only, so that it is cheap to send to workers."""

    path: str = VOCABULARY

    def encode(self, text: str) -> list[int]:
        return _encoder(self.path).encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        return _encoder(self.path).decode(ids)


def token_count(text: Column | str, tokenizer: Tokenizer | None = None) -> Column:
    """The number of tokens of each text, null for null; equal texts of a batch are encoded once."""
    t = tokenizer or Tokenizer()

    @pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        known = {x: t.count(x) for x in dict.fromkeys(s) if x is not None}
        return s.map(known).astype("Int32")

    return run(F.col(text) if isinstance(text, str) else text)


def fill_token_counts(chunks, tokenizer: Tokenizer | None = None, text: str = "text", count: str = "token_count"):
    """Chunks with a count for each that has none yet; counts that are there stay."""
    return chunks.withColumn(count, F.when(F.coalesce(F.col(count), F.lit(0)) == 0, token_count(text, tokenizer)).otherwise(F.col(count)))
