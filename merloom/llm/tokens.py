"""Token counts of a public tokenizer, computed in Arrow batches."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: longer texts are counted in parts
PART_CHARS = 1 << 20


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of about ``size`` characters whose token counts add up to that of the whole.

    The pattern ends a piece before a single blank between two letters, so a
    cut there changes nothing; where there is none, the part goes on.
    """
    out, at = [], 0
    while len(text) - at > size:
        i = at + size
        while i < len(text) - 1 and not (text[i] == " " and text[i - 1].isalpha() and text[i + 1].isalpha()):
            i += 1
        if i >= len(text) - 1:
            break
        out.append(text[at:i])
        at = i
    out.append(text[at:])
    return out


#: a run of blanks of this length is more than the tokenizer's own pattern engine takes
LONG_RUN = 10_000
_LONG = re.compile(rf"\s{{{LONG_RUN}}}")


def count_tokens(e, text: str | None) -> int:
    """Tokens of one text of any length; 0 for a null or empty one."""
    if not text:
        return 0
    if len(text) <= LONG_RUN:
        return len(e.encode_ordinary(text))
    if _LONG.search(text):
        import regex

        return sum(len(e._encode_single_piece(m.group().encode("utf-8", "replace"))) for m in regex.finditer(PATTERN, text))
    return sum(len(e.encode_ordinary(p)) for p in parts(text))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for a null or empty one."""

    @F.pandas_udf("long")
    def count(s):
        import pandas as pd

        e = encoder(path)
        return pd.Series([count_tokens(e, t) for t in s], dtype="int64")

    return count(text)


def with_tokens(df: DataFrame, text: str = "text", name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    return df.withColumn(name, token_count(F.col(text), path))
