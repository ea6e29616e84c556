"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts a text into pieces. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_loaded: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file of ranks, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(here, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


_sent: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, path: str = TOKENIZER) -> None:
    """Lets the driver serve the vocabulary file to executors that do not have it, once per application."""
    mine = (spark.sparkContext.applicationId, path)
    if mine not in _sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _sent.add(mine)


def sizes(df: DataFrame, key: str, text: str, keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """(key, keep..., n_tokens) of each row; a null or empty text has none. The texts themselves go no further."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *(keep or [])]) + ", n_tokens int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf.drop(columns=[text]).assign(n_tokens=n)

    ship(df.sparkSession)
    ship_vocabulary(df.sparkSession, path)
    return df.select(key, *(keep or []), F.col(text)).mapInPandas(run, schema)
