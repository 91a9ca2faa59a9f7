"""Token counts with a public tokenizer; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to the vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 20_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    """Tokens of a whole text, as if encoded at once.

    Very long texts are encoded piece by piece, cut only before a single blank between
    two signs: the split pattern starts a new part there in any case.  A stretch
    without such a blank stays in one piece, however long.
    """
    if not text:
        return 0
    enc, n, at = encoder(path), 0, 0
    while at < len(text):
        m = _SAFE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = m.start() if m else len(text)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_counts(path: str = VOCABULARY):
    """A vectorised column function: tokens of a text column (0 for null and empty)."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, path) for t in texts], dtype="int64")

    return tokens
