"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):  # noqa: ANN202 - parsed once in each worker
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, ident: str, text: str, carry: dict[str, Column] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc``, ``tokens`` (long) and the carried columns of each row; null and empty texts have 0 tokens.

    ``tokenizer`` is the path of a vocabulary of ranks, read by the driver and sent to the tasks (its size does not depend on the data).
    Whole texts are encoded; strings of special tokens are ordinary text.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    carry = carry or {}
    names = list(carry)
    rows = docs.select(F.col(ident).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *[c.alias(n) for n, c in carry.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), *[b.column(c) for c in names]], names=["doc", "tokens", *names])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name != "_text" and x.name != "doc")
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, tokens long" + (f", {kinds}" if kinds else ""))
