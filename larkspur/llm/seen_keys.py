"""Problem 4: has this key been seen before? Scalable Bloom chains, one per shard of the key space.

A chain is a list of Bloom layers, each twice as large as the one before and with half its error rate; a new layer
begins when the last holds as many keys as it was made for. With a first rate e the chain's rate never passes
e + e/2 + e/4 + ... < 2e, however many keys arrive. Keys are 128-bit hashes.

The chains are kept in a shared folder (``ChainStore``), about 30 bits a key at the default rate. A batch of arrivals reads them, is
replayed in order of arrival shard by shard, and is published with the grown chains as one new version: earlier keys are
never read again, and a batch that failed has left nothing. As history grows the shards double, so that a task's bits stay bounded: both
halves of a shard inherit its layers and go on apart.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.incremental import VersionLog
from larkspur.session import scratch_path


class BloomChain:
    """Layers of bits for 128-bit keys given as two uint64 arrays."""

    def __init__(self, capacity: int = 1 << 14, error: float = 5e-7, growth: int = 2, tighten: float = 0.5, layers: list[np.ndarray] | None = None, count: int = 0):
        self.capacity, self.error, self.growth, self.tighten = capacity, error, growth, tighten
        self.layers: list[tuple[np.ndarray, int, int, int]] = []  # bytes, bits, hashes, capacity
        for data in layers or [None]:
            self._add_layer(data)
        self.count = count  # keys in the last layer

    def _add_layer(self, data: np.ndarray | None = None) -> None:
        i = len(self.layers)
        n, e = self.capacity * self.growth**i, self.error * self.tighten**i
        k = math.ceil(-math.log2(e))
        bits = math.ceil(-k * n / math.log(1 - e ** (1 / k))) | 1  # so many that k whole hashes give the rate e when n keys are in
        self.layers.append((np.zeros(bits // 8 + 1, np.uint8) if data is None else data, bits, k, n))
        self.count = 0

    @property
    def bound(self) -> float:
        """Compounded false-positive bound of the layers so far."""
        return sum(self.error * self.tighten**i for i in range(len(self.layers)))

    @staticmethod
    def _positions(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int) -> np.ndarray:
        # enhanced double hashing: the cubic term keeps keys with related steps apart; layers differ by their number of bits
        i = np.arange(hashes, dtype=np.uint64)[:, None]
        mixed = (h1 ^ np.uint64(bits)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29)))[None, :] % np.uint64(bits) + i * (h2 % np.uint64(bits))[None, :] + (i * i * i - i) // np.uint64(6)) % np.uint64(bits)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key may have been added; never false for one that was."""
        out = np.zeros(len(h1), bool)
        for data, bits, hashes, _ in self.layers:
            p = self._positions(h1, h2, bits, hashes)
            out |= ((data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Add keys, opening layers as they fill."""
        while len(h1):
            data, bits, hashes, n = self.layers[-1]
            room = n - self.count
            if room <= 0:
                self._add_layer()
                continue
            p = self._positions(h1[:room], h2[:room], bits, hashes).ravel()
            np.bitwise_or.at(data, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
            self.count += min(room, len(h1))
            h1, h2 = h1[room:], h2[room:]


def _first_of_each(h1: np.ndarray, h2: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows that are the first of their key by ``order``, ascending."""
    by = np.lexsort((order, h2, h1))
    new = np.ones(len(by), bool)
    new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    return np.sort(by[new])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of each key in a batch, only the first arrival; the others are repeats for certain."""
    for b in batches:
        h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        seq = b.column("seq").to_numpy(zero_copy_only=False)
        yield b.take(pa.array(_first_of_each(h1, h2, seq)))


ROWS = "shard long, kind int, seq long, h1 long, h2 long, data binary"
OUT = "kind int, shard long, seq long, seen boolean, layers int, bound double, held long, data binary"


def _replay(capacity: int, error: float):  # noqa: ANN202
    """Rows of a shard come as its stored layers (kind 0), then its keys in order (kind 1); out go a verdict a key, and the shard's layers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, at, stored, held = None, None, [], 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.float64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in OUT.split(", ")]

        def started() -> BloomChain:
            return BloomChain(capacity, error, layers=stored, count=held)

        def kept() -> Iterator[pa.RecordBatch]:
            if at is not None:
                last = chain or started()
                for i, (data, *_) in enumerate(last.layers):  # one layer a batch: the largest is half of the shard's bits
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((0, at, i, None, len(last.layers), last.bound, last.count, data.tobytes()), types, strict=True)], names=names)

        for b in batches:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "seq", "h1", "h2")}
            edges = np.flatnonzero(np.diff(cols["shard"]) | np.diff(cols["kind"])) + 1
            for rows in np.split(np.arange(b.num_rows), edges):
                if not len(rows):
                    continue
                shard = int(cols["shard"][rows[0]])
                if shard != at:
                    yield from kept()
                    chain, at, stored, held = None, shard, [], 0
                if cols["kind"][rows[0]] == 0:
                    stored += [np.frombuffer(x, np.uint8).copy() for x in b.column("data").take(pa.array(rows)).to_pylist()]
                    held = int(cols["h1"][rows[-1]])
                    continue
                chain = chain or started()
                h1, h2 = cols["h1"][rows].view(np.uint64), cols["h2"][rows].view(np.uint64)
                seen = chain.contains(h1, h2)
                first = _first_of_each(h1, h2, np.arange(len(rows)))
                flagged = np.ones(len(rows), bool)
                flagged[first] = seen[first]
                fresh = first[~seen[first]]
                chain.add(h1[fresh], h2[fresh])
                n = len(rows)
                values = (np.ones(n, np.int32), cols["shard"][rows], cols["seq"][rows], flagged, np.full(n, len(chain.layers), np.int32), np.full(n, chain.bound), np.zeros(n, np.int64), [None] * n)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=names)
        yield from kept()

    return run


class ChainStore:
    """The chains of all keys so far, in a shared folder; ``absorb`` tells of each arrival whether its key was seen and remembers it.

    ``shards`` is the number to begin with; it doubles whenever more than ``keys_per_shard`` new keys a shard are held. ``capacity`` and ``error`` are
    those of the first layers and belong to the store from its first version on.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 1, capacity: int = 1 << 14, error: float = 5e-7, keys_per_shard: int = 1 << 20):
        self.spark, self.keys_per_shard = spark, keys_per_shard
        self.log = VersionLog(spark, path)
        self.first = {"version": 0, "folder": None, "shards": shards, "keys": 0, "capacity": capacity, "error": error}

    def state(self) -> dict:
        """The newest version: its number and folder, shards, keys held, and the setting."""
        return self.log.latest() or self.first

    def layers(self) -> DataFrame | None:
        """``shard, seq`` (number of the layer), ``held`` (keys in the shard's last layer) and ``data`` of the newest version."""
        folder = self.state()["folder"]
        return self.spark.read.schema(OUT).parquet(folder).where("kind = 0").select("shard", "seq", "held", "data") if folder else None

    def absorb(self, arrivals: DataFrame, before_publish: Callable[[], None] | None = None) -> DataFrame:
        """Probe and add each arrival in turn: ``shard, seq, seen, layers, bound`` of the first arrivals of each key in a piece of the input.

        ``arrivals`` has ``key`` and ``seq`` (long); null keys and seqs are left out. Arrivals missing from the result repeat, for certain, an arrival with a smaller
        seq. Chains and verdicts become known together; ``before_publish`` is called when all is written but nothing published (for tests of failures).
        """
        now = self.state()
        shards, chains = now["shards"], self.layers()
        stored = None
        if chains is not None:
            double = now["keys"] > shards * self.keys_per_shard
            where = F.explode(F.array("shard", F.col("shard") + shards)) if double else F.col("shard")
            stored = chains.select(where.alias("shard"), F.lit(0).alias("kind"), "seq", F.col("held").alias("h1"), F.lit(0).cast("long").alias("h2"), "data")
            shards *= 1 + double
        h = arrivals.where(F.col("key").isNotNull() & F.col("seq").isNotNull()).select(F.col("seq").cast("long").alias("seq"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
        rows = h.mapInArrow(_collapse, "seq long, h1 long, h2 long").select(F.pmod("h2", F.lit(shards)).alias("shard"), F.lit(1).alias("kind"), "seq", "h1", "h2", F.lit(None).cast("binary").alias("data"))
        rows = rows if stored is None else stored.unionByName(rows)
        placed = rows.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "kind", "seq")
        folder = f"{self.log.path}/data/{uuid.uuid4().hex}"
        placed.mapInArrow(_replay(now["capacity"], now["error"]), OUT).write.partitionBy("kind").parquet(folder)
        verdicts = self.spark.read.schema(OUT).parquet(folder).where("kind = 1").select("shard", "seq", "seen", "layers", "bound")
        new = verdicts.where("NOT seen").count()
        if before_publish:
            before_publish()
        self.log.publish(now["version"] + 1, now | {"version": now["version"] + 1, "folder": folder, "shards": shards, "keys": now["keys"] + new})
        return verdicts


def first_arrivals(known: DataFrame, arrivals: DataFrame, shards: int, capacity: int = 1 << 14, error: float = 5e-7) -> DataFrame:
    """The verdicts on ``arrivals`` (``key, seq``) after the earlier keys ``known`` (``key``), from a new store in the shared folder."""
    spark = arrivals.sparkSession
    store = ChainStore(spark, scratch_path(spark, "chains"), shards, capacity, error)
    store.absorb(known.select("key", F.lit(0).cast("long").alias("seq")))
    return store.absorb(arrivals)


def seen_before(known: DataFrame, arrivals: DataFrame, shards: int, capacity: int = 1 << 14, error: float = 5e-7) -> DataFrame:
    """``seq`` of each arrival whose key was seen before, once each; wrong at a rate below ``2 * error``, and then only by too many.

    Equal seq are copies of one arrival. An arrival is new if the chain says so for its batch's first row of the key;
    all others have been seen.
    """
    new = first_arrivals(known, arrivals, shards, capacity, error).where(~F.col("seen")).select("seq")
    return arrivals.where(F.col("key").isNotNull() & F.col("seq").isNotNull()).select("seq").dropDuplicates(["seq"]).join(new, "seq", "left_anti")
