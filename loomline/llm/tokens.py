"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; pass another place to every operator that counts.
FOLDER = os.environ.get("LOOMLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The pre-tokenisation pattern of these vocabularies, a fixed value of theirs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLOCK = 1 << 16


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary of ranks, and which of its tokens hold letters; one a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    letters = np.zeros(max(ranks.values()) + 1, bool)
    for piece, rank in ranks.items():
        text = piece.decode("utf-8", "ignore")
        # bytes of a split character count as letters
        letters[rank] = any(c.isalpha() for c in text) or not text
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), letters


def tokens(text: str, path: str) -> np.ndarray:
    """Token ids of a text; None is the empty text."""
    return np.array(encoding(path)[0].encode_ordinary(text or ""), np.int64)


def count(text: Column, path: str | None = None) -> Column:
    """Number of tokens; null and empty texts have 0."""
    path = path or os.path.join(FOLDER, VOCABULARY)

    @F.pandas_udf("int")
    def n_tokens(texts: pd.Series) -> pd.Series:
        encode = encoding(path)[0].encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return n_tokens(text)


def pieces(text: Column, capacities: list[int], path: str | None = None) -> Column:
    """Of each capacity the pieces of a text: array of (capacity, piece, n_pieces, token_from, token_to, loss_tokens).

    A text within a capacity is one piece; a longer one is divided into full pieces and
    a rest. loss_tokens counts the tokens that hold letters: times, numbers, signs and
    white space are context that a model isn't trained to write.
    """
    path = path or os.path.join(FOLDER, VOCABULARY)

    @F.pandas_udf("array<struct<capacity:int,piece:int,n_pieces:int,token_from:int,token_to:int,loss_tokens:int>>")
    def divide(texts: pd.Series) -> pd.Series:
        encode, letters = encoding(path)
        out = []
        for t in texts:
            ids = np.array(encode.encode_ordinary(t), np.int64) if t else np.empty(0, np.int64)
            total = np.concatenate([[0], np.cumsum(letters[ids])])
            rows = []
            for c in capacities:
                cuts = [*range(0, max(len(ids), 1), c), len(ids)]
                rows += [{"capacity": c, "piece": i, "n_pieces": len(cuts) - 1, "token_from": x, "token_to": y, "loss_tokens": int(total[y] - total[x])} for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            out.append(rows)
        return pd.Series(out)

    return divide(text)
