"""Problem 2: one ranking from several scores on unlike scales, by outranking net flow.

Within a group each score becomes a percentile (mid-rank, 0 to 1), so that scales and distributions no longer matter. For
each pair and score, the preference for the better item rises linearly from 0 at a percentile lead of ``indifference`` to 1 at
``strict``. The flow of an item is its mean preference over the others minus theirs over it, weighted over the scores. The sums over
all pairs are computed exactly without forming pairs: sorted percentiles with prefix sums give, for each item, the count and
the sum of the percentiles in any range below or above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.ranking import ranked
from larkspur.operators.skew import spread_join
from larkspur.session import checkpointed, fresh

OUT = "flow double, above array<int>, equal array<int>, members int"


def _flows(group: np.ndarray, value: np.ndarray, n: np.ndarray, q: float, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Net preference sums of one score, and how many items of the group are above and equal to each; groups are numbered from 0."""
    by = np.lexsort((value, group))
    g, v = group[by], value[by]
    new = np.ones(len(by), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    tie = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(by)))
    begin = np.searchsorted(g, g, "left")
    less, same = start[tie] - begin, size[tie]
    span = np.maximum(n[g] - 1, 1)
    r = (less + (same - 1) / 2) / span  # percentile
    # one sorted key for all groups: group number times 4 keeps ranges of width 1 around a percentile apart
    key, cum = g * 4.0 + r, np.concatenate(([0.0], np.cumsum(r)))

    def pref(sign: int) -> np.ndarray:
        near, far = (np.searchsorted(key, g * 4.0 + r - sign * x, "right" if sign > 0 else "left") for x in (q, p))
        lo = begin if sign > 0 else begin + n[g]
        full = (far - lo) * sign  # leads of at least strict
        count, total = (near - far) * sign, (cum[near] - cum[far]) * sign
        return full + ((r - sign * q) * count - total) * sign / (p - q)

    net = np.empty(len(by))
    above, equal = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    net[by] = pref(1) - pref(-1)
    above[by], equal[by] = n[g] - less - same, same - 1
    return net, above, equal


def _bounded(scores: int, weights: list[float], q: float, p: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("rows")
            sizes = np.diff(rows.offsets.to_numpy())
            items = rows.flatten()
            group = np.repeat(np.arange(len(sizes)), sizes)
            flow, above, equal = np.zeros(len(group)), [], []
            for k in range(scores):
                net, a, e = _flows(group, items.field(f"s{k}").to_numpy(zero_copy_only=False), sizes, q, p)
                flow += weights[k] * net
                above.append(a)
                equal.append(e)
            flow /= np.maximum(sizes[group] - 1, 1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(group) * scores + 1, scores), pa.int32()), pa.array(np.stack(x, 1).ravel().astype(np.int32))) for x in (above, equal)]
            yield pa.RecordBatch.from_arrays(
                [b.column("grp").take(pa.array(group)), items.field("item"), pa.array(flow), *lists, pa.array(sizes[group].astype(np.int32))],
                names=["grp", "item", "flow", "above", "equal", "members"],
            )

    return run


def _running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    return ranked(df, keys, order, "_place", sums).drop("_place")


def _large(items: DataFrame, scores: int, weights: list[float], q: float, p: float) -> DataFrame:
    """The same for groups of any size: rows are sorted over many tasks, values tied in a group are one row."""
    long = items.select("grp", "item", F.posexplode(F.array(*[F.col(f"s{k}") for k in range(scores)])).alias("k", "v"))
    values = long.groupBy("grp", "k", "v").agg(F.count(F.lit(1)).alias("same"))
    n = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    placed = _running(values, ["grp", "k"], [F.col("v").asc()], {"upto": "same"}).join(n, "grp")
    span = F.greatest(F.col("n") - 1, F.lit(1))
    placed = placed.withColumn("r", (F.col("upto") - F.col("same") + (F.col("same") - 1) / 2) / span).withColumn("mass", F.col("r") * F.col("same"))
    # each value asks for the counts and sums up to four places; a place that meets a value counts it or not by "side"
    asks = placed.select(
        "grp", "k", "v", "r",
        F.inline(F.array(*[F.struct(F.lit(name).alias("ask"), (F.col("r") + d).alias("x"), F.lit(side).alias("side")) for name, d, side in (("qd", -q, 2), ("pd", -p, 2), ("qu", q, 0), ("pu", p, 0))])),
    )
    asks = asks.select("grp", "k", "v", "ask", "x", "side", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("m"))
    points = placed.select("grp", "k", "v", F.lit("").alias("ask"), F.col("r").alias("x"), F.lit(1).alias("side"), F.col("same").alias("c"), F.col("mass").alias("m"))
    walked = _running(points.unionByName(asks), ["grp", "k"], [F.col("x").asc(), F.col("side").asc(), F.col("v").asc(), F.col("ask").asc()], {"C": "c", "M": "m"})
    got = walked.where("ask <> ''").groupBy("grp", "k", "v").agg(*[F.max(F.when(F.col("ask") == a, F.col(c))).alias(f"{c}{a}") for a in ("qd", "pd", "qu", "pu") for c in ("C", "M")])
    r, w = F.col("r"), p - q
    down = F.col("Cpd") + ((r - q) * (F.col("Cqd") - F.col("Cpd")) - (F.col("Mqd") - F.col("Mpd"))) / w
    up = F.col("n") - F.col("Cpu") + ((F.col("Mpu") - F.col("Mqu")) - (r + q) * (F.col("Cpu") - F.col("Cqu"))) / w
    net = placed.join(got, ["grp", "k", "v"]).select(
        "grp", "k", "v", "n", ((down - up) * F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("k") + 1)).alias("net"),
        (F.col("n") - F.col("upto")).cast("int").alias("above"), (F.col("same") - 1).cast("int").alias("equal"), "same",
    )
    # a value that much of a large group has in common meets its row in several tasks
    each = spread_join(long, net, ["grp", "k", "v"], "same", "item").groupBy("grp", "item").agg(
        F.sum("net").alias("net"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "above", "equal"))).alias("per")
    )
    return each.select(
        "grp", "item", (F.col("net") / F.greatest(F.col("n") - 1, F.lit(1))).alias("flow"), F.transform("per", lambda x: x["above"]).alias("above"),
        F.transform("per", lambda x: x["equal"]).alias("equal"), F.col("n").cast("int").alias("members"),
    )


def net_flow(
    df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, indifference: float = 0.0, strict: float = 0.5, group_rows: int = 20_000
) -> DataFrame:
    """``grp, item, flow, above, equal, members``: the net flow of each item in its group, in [-1, 1], highest first.

    ``above`` and ``equal`` tell, per score, how many items of the group have a higher and the same value. Items with a null group,
    item, or a null or NaN score take no part. ``item`` should be unique in its group; equal items get a row each. A group of one has flow 0.
    Groups of up to ``group_rows`` items are computed as arrays, larger ones by distributed sorting: both are exact.
    """
    weights = [1 / len(scores)] * len(scores) if weights is None else [w / sum(weights) for w in weights]
    ok = F.lit(True)
    for s in scores:
        ok = ok & F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    items = df.where(ok & F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("grp"), F.col(item).alias("item"), *[(F.col(s).cast("double") + F.lit(0.0)).alias(f"s{k}") for k, s in enumerate(scores)]
    )
    large = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("grp")
    large = checkpointed(large)  # read three times; at most one group in group_rows items
    kinds = f"grp {items.schema['grp'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, {OUT}"
    small = items.join(large, "grp", "left_anti").groupBy("grp").agg(F.collect_list(F.struct("item", *[f"s{k}" for k in range(len(scores))])).alias("rows"))
    out = small.mapInArrow(_bounded(len(scores), weights, indifference, strict), kinds)
    if large.limit(1).count():
        out = out.unionByName(_large(items.join(large, "grp", "left_semi"), len(scores), weights, indifference, strict))
    return out


def fused_rank(flows: DataFrame, rank: str = "rank") -> DataFrame:
    """The place of each item by flow; flows equal to 12 decimals (sums taken in another order differ beyond) go by item. For groups bounded in size."""
    (name,) = fresh(flows, rank)
    return flows.withColumn(name, F.row_number().over(Window.partitionBy("grp").orderBy(F.round("flow", 12).desc(), "item")))
