"""A small rule-based English stemmer and plural/singular key lookup candidates (Arrow batches)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: suffixes tried in this order, with what replaces them
_RULES = (("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("ingly", ""), ("edly", ""), ("sses", "ss"), ("ies", "y"), ("ing", ""), ("ed", ""), ("ly", ""), ("es", "e"), ("s", ""))
_VOWELS = set("aeiouy")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of three letters or fewer stay as they are."""
    if len(word) <= 3 or word.endswith("ss"):
        return word
    for end, put in _RULES:
        base = word[: -len(end)]
        if word.endswith(end) and len(base) >= 3 and _VOWELS & set(base):
            out = base + put
            if end in ("ing", "ed") and len(out) > 3 and out[-1] == out[-2] and out[-1] not in "lsz":
                out = out[:-1]
            return out
    return word


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    get = lambda w: known.setdefault(w, stem(w)) if len(known) < 200_000 else stem(w)
    return words.map(lambda ws: None if ws is None else [get(w) for w in ws if w])


def lookup_keys(word: Column) -> Column:
    """Spellings under which a dictionary may hold a word: itself, singular, plural, verb forms."""
    ends = lambda e: word.endswith(e)
    cut = lambda n: F.left(word, F.length(word) - n)
    forms = [
        word,
        F.when(ends("ies"), F.concat(cut(3), F.lit("y"))),
        F.when(ends("es"), cut(2)),
        F.when(ends("s"), cut(1)),
        F.when(~ends("s"), F.concat(word, F.lit("s"))),
        F.when(~ends("s"), F.concat(word, F.lit("es"))),
        F.when(ends("y"), F.concat(cut(1), F.lit("ies"))),
        F.when(ends("ing"), cut(3)),
        F.when(ends("ing"), F.concat(cut(3), F.lit("e"))),
        F.when(~ends("ing"), F.concat(word, F.lit("ing"))),
        F.when(~ends("ing"), F.concat(F.regexp_replace(word, "e+$", ""), F.lit("ing"))),
    ]
    return F.array_distinct(F.array_compact(F.array(*forms)))
