"""Exact row numbers and running sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import checkpointed, fresh


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", running: dict[str, str] | None = None) -> DataFrame:
    """Add the 1-based row number in ``keys`` by ``order``; ``running`` maps new names to columns summed up to and including the row.

    No task ever holds a whole group: rows are range-partitioned on keys and order together, so that a
    group with a third of all rows spreads over a third of the partitions. Each (partition, group) piece is
    numbered where it lies and moved by the number of rows in the group's earlier pieces.  The sorted rows are
    checkpointed first since range bounds are sampled and must not be drawn twice.  Keys may be null (null
    groups with null); ``order`` should end in a unique column, as ties are else broken arbitrarily but once.
    An empty input gives an empty output.
    """
    running = running or {}
    seq, lo, off = fresh(df, "_seq", "_lo", "_off")
    placed = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], *order)
    placed = checkpointed(placed.withColumn(seq, F.monotonically_increasing_id()))
    piece = F.shiftright(F.col(seq), 33)
    names = [f"_k{i}" for i in range(len(keys))]
    sums = [f"_s{i}" for i in range(len(running))]
    pieces = placed.groupBy(piece.alias("_piece"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(
        F.min(seq).alias(lo), F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c)).alias(s) for s, c in zip(sums, running.values(), strict=True)]
    )
    # one row per piece: as many rows in a group as it has partitions
    before = Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "_piece", *names, lo, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(off), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in sums]
    )
    cond = piece == F.col("_piece")
    for k, n in zip(keys, names, strict=True):
        cond = cond & placed[k].eqNullSafe(pieces[n])
    out = placed.join(pieces, cond)
    out = out.withColumn(rank, F.col(seq) - F.col(lo) + F.col(off) + 1)
    if running:
        # inside a piece: bounded by the size of a partition, in the order already fixed by seq
        local = Window.partitionBy("_piece", *names).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        for (name, col), s in zip(running.items(), sums, strict=True):
            out = out.withColumn(name, F.sum(F.col(col)).over(local) + F.col(s))
    return out.select(*df.columns, rank, *running)
