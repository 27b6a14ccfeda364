"""Problem 9: sources mixed to target shares of the total size, by Pareto order sampling.

Each source gets a size: its share of the total, but no more than its records times its cap of repeats; what a source cannot
fill goes to the others in proportion. Within a source, a record's expected copies are proportional to its weight, capped, and add up to
that size. Its whole copies are certain. For the rest, records are ranked by random odds over inclusion odds, (u/(1-u)) / (p/(1-p)), and
the sample is a prefix of that ranking whose size in tokens is fixed: it ends before the record that would pass the source's size, and the one of
the records behind whose size is nearest to what is left takes that place, if it brings the total nearer.
The random numbers are hashes of record and seed, so that a run can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ranking import ranked


@dataclass
class Goal:
    """What a source should and can give."""

    source: str
    share: float
    repeats: int
    available: int = 0
    weight: float = 0.0
    size: float = 0.0
    rate: float = 0.0


def allocate(goals: list[Goal], total: float) -> None:
    """Set the sizes: shares of the total, capped at ``available * repeats``, the shortfall spread over the others by share."""
    open_, left = [g for g in goals if g.available > 0 and g.share > 0], total
    while open_:
        whole = sum(g.share for g in open_)
        over = [g for g in open_ if left * g.share / whole >= g.available * g.repeats]
        for g in over or open_:
            g.size = g.available * g.repeats if over else left * g.share / whole
        left -= sum(g.size for g in over)
        open_ = [g for g in open_ if g not in over] if over else []


def _by_source(goals: list[Goal], value: str) -> Column:
    return F.element_at(F.create_map(*[x for g in goals for x in (F.lit(g.source), F.lit(float(getattr(g, value))))]), F.col("source"))


def mix(docs: DataFrame, goals: list[Goal], total: float | None = None, seed: int = 17) -> DataFrame:
    """``doc, source, tokens, copies`` (at least 1) of the chosen records; fills in the goals' sizes.

    ``docs`` has ``doc, source, tokens, weight``; sources without a goal, sizes and weights of 0 and nulls are left out. ``goals`` are
    few: one for each source named (12 in the table here); the totals of their sources are all that comes to the driver.
    ``total`` is by default the size of all records that have a goal. A goal without records keeps size 0.
    """
    goals = [g for g in goals if g.source is not None]
    rows = docs.where(F.col("source").isin([g.source for g in goals]) & (F.col("tokens") > 0) & (F.col("weight") > 0))
    by = {g.source: g for g in goals}
    for r in rows.groupBy("source").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("weight")).alias("w")).collect():
        by[r.source].available, by[r.source].weight = r.n, r.w
    allocate(goals, total if total is not None else sum(g.available for g in goals if g.share > 0))
    for g in goals:
        g.rate = g.size / g.weight if g.weight else 0.0
    rate, cap = (lambda: _by_source(goals, "rate")), _by_source(goals, "repeats")
    for _ in range(60):  # records at the cap pass their surplus on; their set only grows, most often for a few rounds
        full = rate() * F.col("weight") >= cap
        sums = rows.groupBy("source").agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("rest")).collect()
        moved = False
        for r in sums:
            g = by[r.source]
            if r.full and r.rest:
                new = (g.size - g.repeats * r.full) / r.rest
                moved |= new > g.rate * (1 + 1e-9)
                g.rate = max(g.rate, new)
        if not moved:
            break
    expected = F.least(cap, rate() * F.col("weight"))
    rows = rows.withColumn("expected", expected).where("expected > 0").withColumn("sure", F.floor(F.col("expected") + 1e-9)).withColumn("p", F.greatest(F.col("expected") - F.col("sure"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = ranked(rows.where("p > 1e-9").withColumn("odds", odds), ["source"], [F.col("odds").asc(), F.col("doc").asc()], "place", {"upto": "tokens"})
    room = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("sure")).alias("sure_tokens"))
    size = _by_source(goals, "size")
    placed = drawn.join(room, "source").withColumn("room", size - F.col("sure_tokens"))
    fits = F.col("upto") <= F.col("room")
    left = placed.groupBy("source").agg((F.max("room") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("left"))
    # one row a goal: the record behind the prefix that fills best what is left
    behind = placed.where(~fits).join(F.broadcast(left), "source").withColumn("miss", F.abs(F.col("left") - F.col("tokens")))
    filler = behind.where(F.col("miss") < F.col("left")).groupBy("source").agg(F.min_by(F.struct("doc", "tokens"), F.struct("miss", "place")).alias("f")).select("f.doc", "source", "f.tokens")
    taken = placed.where(fits).select("doc", "source", "tokens").unionByName(filler)
    chosen = taken.select("doc", "source", "tokens", F.lit(1).cast("long").alias("copies")).unionByName(rows.where("sure > 0").select("doc", "source", "tokens", F.col("sure").cast("long").alias("copies")))
    return chosen.groupBy("doc", "source", "tokens").agg(F.sum("copies").alias("copies"))


def shares(chosen: DataFrame, goals: list[Goal]) -> DataFrame:
    """``source, target_share, available_tokens, documents, tokens, share``: what was reached, a row for each goal."""
    spark = chosen.sparkSession
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    want = spark.createDataFrame([(g.source, g.share, int(g.available)) for g in goals], "source string, target_share double, available_tokens long")
    rows = want.join(got, "source", "left").select("source", "target_share", "available_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_copies")])
    # as many rows as goals
    return rows.join(rows.agg(F.sum("tokens").alias("_all")), how="cross").select(*rows.columns, F.round(F.col("tokens") / F.greatest("_all", F.lit(1)), 6).alias("share"))
