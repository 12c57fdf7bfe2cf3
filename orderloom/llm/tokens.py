"""Sizes of texts in tokens of a public tokenizer."""

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("ORDERLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pattern that splits texts for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache
def encoding(path: str):
    """The tokenizer of a vocabulary file of base64 tokens and ranks; loaded once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(documents: DataFrame, text: str = "text", size: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """The rows without their text and with its number of tokens; 0 where it is NULL or empty. Whole texts are counted."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for batch in texts:
            yield pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in batch], dtype="int64")

    others = [c for c in documents.columns if c not in (text, size)]
    return documents.select(*others, count(F.col(text)).alias(size))
