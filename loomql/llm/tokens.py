"""Text sizes in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(name: str):
    """The tokenizer of a vocabulary file sent with the job, read once per worker process.

    What is read is kept in a module of its own, since this package travels to the workers by value.
    """
    import base64
    import sys
    import types

    import tiktoken
    from pyspark import SparkFiles

    kept = sys.modules.setdefault("loomql_vocabularies", types.ModuleType("loomql_vocabularies")).__dict__
    if name not in kept:
        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[name] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return kept[name]


def token_counter(path: str = VOCABULARY) -> Callable[[Column], Column]:
    """A column function: number of tokens of a text; null for null, 0 for an empty text. Arrow batches.

    The vocabulary is read on the driver's machine and sent to the executors.
    """
    SparkSession.active().sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(name).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, T.LongType())
