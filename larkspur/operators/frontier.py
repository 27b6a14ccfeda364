"""The crawl frontier as tables: ``queue`` (origin, url, depth, retries, kind, seq), ``seen`` (url) and ``ready`` (origin, ready_at).

Every operation takes tables and gives tables, so that a state is a written version and a step that failed can be run again. Times
are arguments: nothing here looks at a clock. Queues of any length are ranked over many tasks.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.crawl import priority
from larkspur.operators.ranking import ranked

QUEUE = ["origin", "url", "depth", "retries", "kind", "seq"]


def accepted(queue: DataFrame, seen: DataFrame, entries: DataFrame, capacity: int = 100_000) -> DataFrame:
    """The entries (columns of the queue and ``force``) that a queue takes up, in order of ``seq``.

    An entry needs room in its origin's queue, must not wait there already and, unless it is forced, its URL must not have been seen. Of entries with one
    URL the first counts. An entry that finds no room is not remembered as seen.
    """
    rows = entries.where("origin IS NOT NULL AND url IS NOT NULL AND seq IS NOT NULL")
    plain = rows.where("NOT force").join(seen.select("url"), "url", "left_anti")
    fresh = rows.where("force").select(*QUEUE).unionByName(plain.select(*QUEUE)).join(queue.select("origin", "url"), ["origin", "url"], "left_anti")
    first = fresh.groupBy("origin", "url").agg(F.min(F.struct("seq", "depth", "retries", "kind")).alias("e")).select("origin", "url", "e.depth", "e.retries", "e.kind", "e.seq")
    waiting = queue.groupBy("origin").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("origin", "_o")
    nth = ranked(first, ["origin"], [F.col("seq").asc(), F.col("url").asc()], "_nth")
    return nth.join(waiting, F.col("origin") == F.col("_o"), "left").where(F.col("_nth") + F.coalesce("_n", F.lit(0)) <= capacity).select(*QUEUE)


def enqueue(queue: DataFrame, seen: DataFrame, ready: DataFrame, entries: DataFrame, capacity: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after ``entries``; an origin that had no queue may be asked at once (a null ``ready_at``)."""
    new = accepted(queue, seen, entries, capacity)
    fresh = new.select("origin").distinct().join(ready.select("origin"), "origin", "left_anti").withColumn("ready_at", F.lit(None).cast("timestamp"))
    return queue.select(*QUEUE).unionByName(new), seen.select("url").unionByName(new.select("url")).distinct(), ready.select("origin", "ready_at").unionByName(fresh)


def claims(queue: DataFrame, ready: DataFrame, now: datetime, limit: int | None = None, lease: float = 60.0) -> DataFrame:
    """Leases ``origin, url, depth, retries, kind, seq, lease_until``: of every origin that may be asked, the first entry by priority and arrival.

    With ``limit``, only the origins that have waited longest (null first, of equal times by name). A lease that was never released ends by itself: its
    origin is ready again at ``lease_until``.
    """
    at = ready.where(F.col("ready_at").isNull() | (F.col("ready_at") <= F.lit(now)))
    best = queue.groupBy("origin").agg(F.min(F.struct(priority(F.col("kind"), F.col("depth"), F.col("retries")).alias("p"), "seq", "url", "depth", "retries", "kind")).alias("b"))
    rows = best.join(at, "origin")
    if limit is not None:
        rows = rows.orderBy(F.col("ready_at").asc_nulls_first(), "origin").limit(limit)
    return rows.select("origin", "b.url", "b.depth", "b.retries", "b.kind", "b.seq", F.lit(now + timedelta(seconds=lease)).alias("lease_until"))


def claimed(queue: DataFrame, ready: DataFrame, leases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue and ready times after the leases were handed out."""
    left = queue.join(leases.select("origin", "url"), ["origin", "url"], "left_anti").select(*QUEUE)
    times = ready.join(leases.select("origin", "lease_until"), "origin", "left")
    return left, times.select("origin", F.coalesce("lease_until", "ready_at").alias("ready_at"))


def released(queue: DataFrame, ready: DataFrame, releases: DataFrame) -> DataFrame:
    """Ready times after ``releases`` (origin, next_allowed_at): origins with nothing more to ask are dropped."""
    left = queue.select("origin").distinct()
    times = ready.join(releases.groupBy("origin").agg(F.max("next_allowed_at").alias("next")), "origin", "left")
    idle = times.where("next IS NOT NULL").select("origin").join(left, "origin", "left_anti")
    return times.join(idle, "origin", "left_anti").select("origin", F.coalesce("next", "ready_at").alias("ready_at"))


def stats(queue: DataFrame, ready: DataFrame, now: datetime) -> DataFrame:
    """One row: ``hosts, ready, queued``."""
    one = ready.agg(F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("ready_at").isNull() | (F.col("ready_at") <= F.lit(now))).alias("ready"))
    return one.join(queue.agg(F.count(F.lit(1)).alias("queued")), how="cross")  # one row each


def schedule(entries: DataFrame, next_times: DataFrame, start: datetime, delay: float = 1.0) -> DataFrame:
    """When each waiting entry is asked: ``origin, url, priority, seq, lease_at``, one ``delay`` (seconds) apart in each origin.

    ``next_times`` (origin, next_at) holds what earlier batches have taken up. A plan of the whole queue: no entry is left behind, whatever the length.
    """
    rows = entries.where("origin IS NOT NULL AND url IS NOT NULL")
    nth = ranked(rows, ["origin"], [F.col("priority").asc(), F.col("seq").asc(), F.col("url").asc()], "_nth")
    begin = F.unix_micros(F.greatest(F.coalesce("next_at", F.lit(start).cast("timestamp")), F.lit(start).cast("timestamp")))
    joined = nth.join(next_times.select(F.col("origin").alias("_o"), "next_at"), F.col("origin") == F.col("_o"), "left")
    return joined.select("origin", "url", "priority", "seq", F.timestamp_micros(begin + (F.col("_nth") - 1) * int(delay * 1e6)).alias("lease_at"))
