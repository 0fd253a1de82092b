"""Token counts under a public byte-level tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How the tokenizer cuts a text before merging bytes; a fixed value of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def _encoding(vocabulary: str) -> object:
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Counts(dict):
    """Tokens of each pre-token; merges never cross them, so a text's count is their sum."""

    def __init__(self, vocabulary: str) -> None:
        self.encode = _encoding(vocabulary).encode_ordinary

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(self) < 500_000:
            self[word] = n
        return n


def count_tokens(df: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, *extra, n_tokens)`` of every row; a null text has 0 tokens."""
    ship(df.sparkSession)
    fields = [df.schema[c] for c in (row_id, *extra)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, counts = regex.compile(PATTERN).findall, _Counts(vocabulary)
        for batch in batches:
            # equal texts of a batch are counted once
            seen: dict[str, int] = {}
            column = []
            for body in batch.pop("_text"):
                n = seen.get(body)
                if n is None:
                    n = seen[body] = sum(map(counts.__getitem__, split(body))) if body else 0
                column.append(n)
            yield batch.assign(n_tokens=column)

    return df.select(row_id, *extra, F.col(text).alias("_text")).mapInPandas(run, schema)
