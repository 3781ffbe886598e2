"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64

import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public word pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoder of a vocabulary file, read once a process."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: str | Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; null for null, 0 for the empty text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        found = texts.notna()
        sizes = [len(x) for x in encoder(path).encode_ordinary_batch(texts[found].tolist(), num_threads=1)]
        return pd.Series(sizes, index=texts.index[found], dtype="Int64").reindex(texts.index)

    return count(text)
