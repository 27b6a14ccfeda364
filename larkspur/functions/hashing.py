"""Stable hashes whose values are observable: URL hash, routing buckets, Bloom positions, SimHash."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a 64 offset and prime, the seed of the second Bloom hash, and the constants of the SplitMix64 finaliser.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SECOND_SEED = 0x84222325CBF29CE4
MIX_ADD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BUCKETS = 1024


def fnv1a64_flat(flat: np.ndarray, first: np.ndarray, n: np.ndarray, seed: int = FNV_OFFSET) -> np.ndarray:
    """FNV-1a of texts given as bytes: where each begins and how long it is. One vector step per byte position."""
    out = np.full(len(n), seed, np.uint64)
    by = np.argsort(-n, kind="stable")  # the texts still running are a prefix
    ends = np.searchsorted(-n[by], -np.arange(int(n.max(initial=0))), "left")  # how many are longer than each position
    state, at = np.full(len(n), seed, np.uint64), first[by].astype(np.int64)
    for i, left in enumerate(ends):
        state[:left] = (state[:left] ^ flat[at[:left] + i]) * np.uint64(FNV_PRIME)
    out[by] = state
    return out


def fnv1a64(texts: list[str], seed: int = FNV_OFFSET) -> np.ndarray:
    """FNV-1a of many texts at once."""
    raw = [t.encode() for t in texts]
    n = np.array([len(x) for x in raw], np.int64)
    return fnv1a64_flat(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n, seed)


def mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    z = z + np.uint64(MIX_ADD)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def _over(series: pd.Series, f: Callable[[list[str]], list]) -> list:
    """``f`` of the texts that are not null, nulls in their places."""
    got = iter(f([x for x in series if x is not None]))
    return [None if x is None else next(got) for x in series]


@F.pandas_udf(T.LongType())
def url_hash(url: pd.Series) -> pd.Series:
    """Mixed FNV-1a of the text as a signed 64-bit number; null for null."""
    return pd.Series(_over(url, lambda x: mix(fnv1a64(x)).view(np.int64).tolist()), dtype="Int64")


def bucket(hash_: Column) -> Column:
    """Routing bucket: the unsigned hash modulo 1024."""
    return hash_.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def buckets_of(number: int, shards: int) -> list[int]:
    """The buckets that a shard holds."""
    return list(range(number, BUCKETS, shards))


def shard(hash_: Column, shards: int) -> Column:
    """Shard of a hash: its bucket modulo the number of shards."""
    return F.pmod(bucket(hash_), F.lit(shards))


def bloom_positions(bits: int = 1 << 30, hashes: int = 7):  # noqa: ANN201
    """Positions of a key in a Bloom filter: an odd second hash is added again and again."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def positions(key: pd.Series) -> pd.Series:
        def many(x: list[str]) -> list[list[int]]:
            h1 = mix(fnv1a64(x))
            h2 = mix(fnv1a64(x, SECOND_SEED)) | np.uint64(1)
            with np.errstate(over="ignore"):
                p = (h1[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(bits)
            return [list(map(int, r)) for r in p]

        return pd.Series(_over(key, many))

    return positions


def _simhashes(tokens: pa.Array, pieces: int = 1 << 19) -> np.ndarray:
    """SimHash of each list of tokens, some ``pieces`` runs of tokens at a time; equal runs are hashed once."""
    offsets, words = tokens.offsets.to_numpy().astype(np.int64), tokens.values.cast(pa.large_string())
    sizes = np.diff(offsets)
    if tokens.null_count:
        sizes = np.where(tokens.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    runs = np.where(sizes > 0, np.maximum(sizes - 2, 1), 0)
    ends = np.cumsum(runs)
    out, lo = np.zeros(len(sizes), np.uint64), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + pieces, "right")))
        n = runs[lo:hi]
        doc = np.repeat(np.arange(lo, hi), n)
        at = offsets[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        if len(doc):
            part = [words.take(pa.array(np.minimum(at + k, len(words) - 1))) for k in range(3)]
            for k in (1, 2):  # lists of one or two tokens are one run of that length
                part[k] = pc.if_else(pa.array(sizes[doc] > k), part[k], pa.scalar(None, pa.large_string()))
            joined = pc.binary_join_element_wise(*part, pa.scalar(" ", pa.large_string()), null_handling="skip").dictionary_encode()
            _, where, raw = joined.dictionary.cast(pa.large_string()).buffers()
            first = np.frombuffer(where, np.int64)[: len(joined.dictionary) + 1]
            bits = np.unpackbits(mix(fnv1a64_flat(np.frombuffer(raw, np.uint8), first[:-1], np.diff(first))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = np.flatnonzero(n)
            ones = np.add.reduceat(bits[joined.indices.to_numpy()], (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
            out[lo + some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        lo = hi
    return out


@F.arrow_udf(T.LongType())
def simhash_of(tokens: pa.Array) -> pa.Array:
    """SimHash of an array of tokens: bit by bit the majority of the mixed hashes of its runs of three tokens (of all, if fewer); 0 for none."""
    return pa.array(_simhashes(tokens).view(np.int64))


def bands(simhash: Column) -> Column:
    """Four bands of 16 bits, lowest first."""
    return F.array(*[F.shiftrightunsigned(simhash, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int") for i in range(4)])


def blocks(simhash: Column, distance: int = 3) -> Column:
    """Keys two hashes share one of at least if they differ in at most ``distance`` bits: all choices of three of ``distance + 3`` pieces of the hash.

    Each differing bit spoils one piece, so three stay equal. A key has about half of the bits, so that few hashes share one by chance, however many there are.
    """
    n = distance + 3
    edges = [64 * i // n for i in range(n + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(n), 3)):
        mask = sum((1 << edges[p + 1]) - (1 << edges[p]) for p in chosen)
        out.append(F.struct(F.lit(number).alias("block"), simhash.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*out)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def content_hash(title: Column, content: Column) -> Column:
    """SHA-256 of title, newline and content in hexadecimal digits; nulls as empty texts."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), 256)
