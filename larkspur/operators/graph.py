"""Link analysis: degrees, PageRank over pages and over hosts, write-back of ranks."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.urls import host_key
from larkspur.session import checkpointed


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges ``src, dst`` without self loops and nulls."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``nodes`` (``id``)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree`` of each node over clean edges."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("id").distinct().join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree")])


#: Nodes and edges that a task has as one block of arrays, and iterations that are planned as one job.
BLOCK, CHAIN = 2_000_000, 10
_SENT = "to long, sender long, nodes long, src binary, at binary, targets array<long>, sizes array<long>, places binary"
_BLOCKS = "block long, nodes long, src binary, at binary, targets array<long>, sizes array<long>, senders array<long>, counts array<long>, places binary"
_MESSAGES = "to long, sender long, lost double, delta double, sums binary, rank binary"
_SENT_ARROW = pa.schema([*[(c, pa.int64()) for c in ("to", "sender", "nodes")], ("src", pa.binary()), ("at", pa.binary()), ("targets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.binary())])
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), *[_SENT_ARROW.field(c) for c in ("nodes", "src", "at", "targets", "sizes")], ("senders", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())])
_MESSAGES_ARROW = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("lost", pa.float64()), ("delta", pa.float64()), ("sums", pa.binary()), ("rank", pa.binary())])


def _sending(rows: pa.Table) -> pa.Table:
    """From the nodes of a block (rows without ``to``) and its edges: the edges as arrays, and for each block the places that it gets sums for."""
    block, edges = rows["block"][0].as_py(), rows.filter(pc.is_valid(rows["to"]))
    src, to, dst = (edges[c].to_numpy() for c in ("src", "to", "dst"))
    order = np.lexsort((dst, to))
    src, to, dst = src[order], to[order], dst[order]
    first = np.ones(len(to), bool)
    first[1:] = (to[1:] != to[:-1]) | (dst[1:] != dst[:-1])
    targets, sizes = np.unique(to[first], return_counts=True)
    own = {"to": block, "sender": block, "nodes": rows.num_rows - edges.num_rows, "src": src.astype(np.int32).tobytes(), "at": (np.cumsum(first) - 1).astype(np.int32).tobytes(), "targets": targets.tolist(), "sizes": sizes.tolist()}
    places = np.split(dst[first].astype(np.int32), np.cumsum(sizes)[:-1]) if len(sizes) else []
    return pa.Table.from_pylist([own, *({"to": q, "sender": block, "places": x.tobytes()} for q, x in zip(targets.tolist(), places, strict=True))], _SENT_ARROW)


def _joined(rows: pa.Table) -> pa.Table:
    """One row for a block: its edges, and the places of the sums that each sender has for it."""
    parts = rows.to_pylist()
    own = next(r for r in parts if r["nodes"] is not None)
    got = sorted((r["sender"], r["places"]) for r in parts if r["places"] is not None)
    row = {"block": own["to"], **{c: own[c] for c in ("nodes", "src", "at", "targets", "sizes")}}
    return pa.Table.from_pylist([row | {"senders": [x for x, _ in got], "counts": [len(x) // 4 for _, x in got], "places": b"".join(x for _, x in got)}], _BLOCKS_ARROW)


class _Block:
    """The arrays of a block of nodes; messages are rows of ``_MESSAGES``."""

    def __init__(self, row: dict, blocks: list[int], n: int, damping: float, tolerance: float) -> None:
        self.key, self.blocks, self.n, self.damping, self.tolerance = row["block"], blocks, n, damping, tolerance
        self.src, self.at = np.frombuffer(row["src"], np.int32).astype(np.intp), np.frombuffer(row["at"], np.int32).astype(np.intp)
        self.degree = np.bincount(self.src, minlength=row["nodes"])
        self.targets, self.ends = row["targets"], np.cumsum(row["sizes"], dtype=int)
        self.places = dict(zip(row["senders"], np.split(np.frombuffer(row["places"], np.int32), np.cumsum(row["counts"], dtype=int)[:-1]) if row["counts"] else [], strict=True))

    def messages(self, rank: np.ndarray, delta: float) -> list[dict]:
        """What a block tells all blocks: its sums by target, the rank of its nodes without edges and its change; to itself its ranks."""
        sums = np.bincount(self.at, (rank / np.maximum(self.degree, 1))[self.src], self.ends[-1] if len(self.ends) else 0)
        return self._rows(dict(zip(self.targets, np.split(sums, self.ends[:-1]), strict=True)) if self.targets else {}, float(rank[self.degree == 0].sum()), delta, rank.tobytes())

    def _rows(self, sums: dict, lost: float, delta: float, rank: bytes) -> list[dict]:
        return [{"to": q, "sender": self.key, "lost": lost, "delta": delta, "sums": sums[q].tobytes() if q in sums else None, "rank": rank if q == self.key else None} for q in self.blocks]

    def step(self, got: list[dict]) -> list[dict]:
        """An iteration; none any more once all blocks together changed by less than the tolerance, which all see alike."""
        got = sorted(got, key=lambda m: m["sender"])
        own = next(m for m in got if m["sender"] == self.key)
        if math.fsum(m["delta"] for m in got) < self.tolerance:
            return self._rows({}, own["lost"], own["delta"], own["rank"])
        sums = np.zeros(len(self.degree))
        for m in got:
            if m["sums"] is not None:
                sums[self.places[m["sender"]]] += np.frombuffer(m["sums"])
        new = (1 - self.damping + self.damping * math.fsum(m["lost"] for m in got)) / self.n + self.damping * sums
        return self.messages(new, float(np.abs(new - np.frombuffer(own["rank"])).sum()))


def _iterated(blocks: DataFrame, keys: list[int], n: int, damping: float, iterations: int, tolerance: float) -> DataFrame:
    """The last messages. With one block its task iterates by itself; else each iteration sends messages once, and ``CHAIN`` of them are a job."""
    setting = (keys, n, damping, tolerance)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            yield from pa.Table.from_pylist(_Block(row, *setting).messages(np.full(row["nodes"], 1 / n), math.inf), _MESSAGES_ARROW).to_batches()

    def stepped(rounds: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(rows: pa.Table, messages: pa.Table) -> pa.Table:
            block, now = _Block(rows.to_pylist()[0], *setting), messages.to_pylist()
            for _ in range(rounds):
                now = block.step(now)
            return pa.Table.from_pylist(now, _MESSAGES_ARROW)

        return run

    done, state = 0, blocks.mapInArrow(start, _MESSAGES)
    while done < iterations:
        rounds = iterations if len(keys) == 1 else 1
        for _ in range(min(CHAIN, -(-(iterations - done) // rounds))):
            state = blocks.groupBy("block").cogroup(state.groupBy("to")).applyInArrow(stepped(rounds), _MESSAGES)
            done += rounds
        state = checkpointed(state)
        if state.where("to = sender").agg(F.sum("delta")).first()[0] < tolerance:
            break
        gc.collect()  # shuffle and checkpoint files stay until the driver collects its garbage
        blocks.sparkSession._jvm.System.gc()
    return state


def _apart(spark: SparkSession, parts: int) -> list[int]:
    """As many keys, each of which hashes to another of so many partitions."""
    return [r.key for r in spark.range(40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("key")).orderBy("part").collect()]


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (r for b in batches for r in b.to_pylist()):
        rank = np.frombuffer(row["rank"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), row["to"])), pa.array(np.arange(len(rank))), pa.array(rank)], ["block", "place", "rank"])


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-9, block: int = BLOCK) -> DataFrame:
    """``id, rank``: ranks that sum to 1, from equal ranks, until the ranks change by less than ``tolerance`` in all or ``iterations`` are done.

    Ranks of nodes without outgoing edges are spread over all nodes. Nodes are numbered, and they and the edges from them are written once as arrays in blocks of about
    ``block`` nodes and edges (at most as many blocks as there are shuffle partitions). An iteration sends the partial sums from block to block, and with them the two totals;
    it is one stage, as adaptive planning, which would merge the partitions, is off in the loop. No nodes: no rows.
    """
    spark = nodes.sparkSession
    adaptive, partitions = "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (adaptive, partitions)}
    names = checkpointed(nodes.where("id IS NOT NULL").select("id").distinct().repartition(int(before[partitions]), "id").withColumn("node", F.monotonically_increasing_id()))
    counts = names.groupBy(F.shiftright("node", 33).cast("int").alias("part")).count().orderBy("part").collect()
    n = sum(r["count"] for r in counts)
    if not n:
        return names.select("id", F.lit(0.0).alias("rank"))
    ends = [names.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node")) for c in ("src", "dst")]
    links = checkpointed(clean_edges(edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))))
    keys = _apart(spark, max(1, min(len(counts), -(-(n + links.count()) // block))))
    block_of, offset, filled = {}, {}, dict.fromkeys(keys, 0)
    for i, r in enumerate(counts):
        block_of[r["part"]], offset[r["part"]] = (key := keys[i % len(keys)]), filled[key]
        filled[key] += r["count"]
    looked_up = lambda of, c: F.get(F.array(*[F.lit(of.get(i, 0)).cast("long") for i in range(int(before[partitions]))]), F.shiftright(c, 33).cast("int"))
    place_of = lambda c: looked_up(offset, c) + F.col(c).bitwiseAND(F.lit((1 << 33) - 1))
    rows = links.select(looked_up(block_of, "src").alias("block"), place_of("src").alias("src"), looked_up(block_of, "dst").alias("to"), place_of("dst").alias("dst"))
    rows = rows.unionByName(names.select(looked_up(block_of, "node").alias("block"), place_of("node").alias("src"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("dst")))
    try:
        spark.conf.set(adaptive, "false")
        spark.conf.set(partitions, str(len(keys)))
        blocks = rows.groupBy("block").applyInArrow(_sending, _SENT).groupBy("to").applyInArrow(_joined, _BLOCKS)
        blocks = checkpointed(blocks.repartition("block").sortWithinPartitions("block"))
        state = _iterated(blocks, keys, n, damping, iterations, tolerance)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    ranks = state.where("to = sender").select("to", "rank").mapInArrow(_ranks, "block long, place long, rank double")
    return names.select("id", looked_up(block_of, "node").alias("block"), place_of("node").alias("place")).join(ranks, ["block", "place"]).select("id", "rank")


def page_graph(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (all pages that are not gone) and edges of the page graph."""
    nodes = pages.where("status <> 'gone' AND url IS NOT NULL").select(F.col("url").alias("id")).distinct()
    return nodes, links.select(F.col("source_url").alias("src"), F.col("target_url").alias("dst"))


def host_graph(hosts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (all hosts) and the distinct edges between different hosts."""
    nodes = hosts.select(host_key(F.col("host")).alias("id")).distinct()
    ends = links.select(host_key(F.col("source_host")).alias("src"), host_key(F.col("target_host")).alias("dst"))
    return nodes, ends.where("src <> dst").distinct()


def changed_ranks(old: DataFrame, new: DataFrame, at_least: float = 1e-12) -> DataFrame:
    """``id, rank`` to write back: only ranks that differ from the stored one by more than ``at_least`` (or replace none)."""
    stored: Column = F.when(~F.isnan("old_rank"), F.col("old_rank"))
    return new.join(old, "id").where(stored.isNull() | (F.abs(F.col("rank") - stored) > at_least)).select("id", "rank")
