"""Problem 8: items packed into containers of fixed capacity, by shortest-pack-first over the length histogram.

Only the histogram (at most as many lengths as the capacity) comes to the driver. Lengths are placed longest first, each time into
the packs that are filled least and still have room; packs alike are one pattern with a count, so that the work depends on the
capacity and not on the number of items. The patterns then meet the items again by rank: the r-th item of a length takes the r-th slot
that the patterns have for it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ranking import ranked
from larkspur.session import written


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (count of packs, lengths in a pack). Every length must lie between 1 and the capacity."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    groups: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room: pattern: packs
    heap: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            if room not in groups or not groups[room]:
                heapq.heappush(heap, -room)
            groups[room][pattern] = groups[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not groups.get(-heap[0]):
                groups.pop(-heapq.heappop(heap), None)
            room = -heap[0] if heap else 0
            if room < length:  # no pack has room: new ones, each filled as the next items of this length would fill it
                each = capacity // length
                put(capacity - each * length, (length,) * each, left // each)
                put(capacity - left % each * length, (length,) * (left % each), 1 if left % each else 0)
                break
            pattern = next(iter(groups[room]))
            packs = groups[room].pop(pattern)
            used = min(packs, left)
            put(room, pattern, packs - used)
            put(room - length, (*pattern, length), used)
            left -= used
    return [(n, p) for room in sorted(groups) for p, n in groups[room].items()]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int]]]:
    """For each length, where its runs of slots start (counted over its items) and the first container of each run."""
    out: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for count, lengths in patterns:
        for length in lengths:
            starts, bases = out[length]
            starts.append(taken[length])
            bases.append(base)
            taken[length] += count
        base += count
    return out


def pack(items: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Pack ``doc, tokens`` into containers of each window: ``window_name, container, doc, piece, start, tokens``.

    An item larger than the capacity is divided into full containers and a rest; no other is. Items of size 0 (or null) take
    no container: their one row has a null ``container``. Containers are numbered from 0 in each window. Ties of equal length go
    by doc. Items should be unique; repeated rows are packed as often as they come.
    """
    spark = items.sparkSession
    options = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in windows.items()])
    size = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    rows = items.select("doc", size.alias("size"), F.inline(options))
    pieces = rows.select(
        "window_name", "doc", "size", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr("(size - 1) div capacity"), F.lit(0)))).alias("piece")
    ).select("window_name", "doc", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).alias("length"))
    counts = defaultdict(dict)  # at most the capacity's number of lengths for each window
    for r in pieces.where("length > 0").groupBy("window_name", "length").count().collect():
        counts[r.window_name][r.length] = r["count"]
    table = [(w, length, *s) for w, hist in counts.items() for length, s in _slots(pack_histogram(hist, windows[w])).items()]
    slots = spark.createDataFrame(table, "window_name string, length long, starts array<long>, bases array<long>")
    placed = ranked(pieces.where("length > 0"), ["window_name", "length"], [F.col("doc").asc(), F.col("piece").asc()], "rank").join(slots, ["window_name", "length"])
    run = F.size(F.filter("starts", lambda s: s < F.col("rank")))
    container = F.element_at("bases", run) + F.col("rank") - 1 - F.element_at("starts", run)
    empty = pieces.where("length = 0").select("window_name", F.lit(None).cast("long").alias("container"), "doc", "piece", "start", F.col("length").alias("tokens"))
    return placed.select("window_name", container.alias("container"), "doc", "piece", "start", F.col("length").alias("tokens")).unionByName(empty)


def fill_rates(packed: DataFrame, windows: dict[str, int]) -> DataFrame:
    """``window_name, capacity_tokens, containers, tokens, fill``."""
    capacity = F.element_at(F.create_map(*[x for n, c in windows.items() for x in (F.lit(n), F.lit(c).cast("long"))]), F.col("window_name"))
    full = packed.where("container IS NOT NULL").groupBy("window_name").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return full.select("window_name", capacity.alias("capacity_tokens"), "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))


def sized(items: DataFrame) -> DataFrame:
    """Token counts written once, as they are read for the histogram and again for the ranks."""
    return written(items, "sizes")
