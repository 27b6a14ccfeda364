"""Structured Streaming: an index kept fresh from page changes, and a frontier whose requests are planned origin by origin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.urls import normalize_url, origin
from larkspur.operators import frontier
from larkspur.operators.crawl import latest_versions, refreshed
from larkspur.operators.segments import SegmentedIndex
from larkspur.session import checkpointed

STATE = "id string, status string, version_hash string, at timestamp, change_seq long"
LEASES = "origin string, url string, priority long, seq long, lease_at timestamp"


def state_index(spark: SparkSession, path: str) -> SegmentedIndex:
    """The newest state of each page, live or not, in segments under ``path``."""
    return SegmentedIndex(spark, path, STATE)


def refresh_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest state of each page under ``path``: each micro-batch appends one segment of what it has made newer, older segments are untouched.

    Late and repeated deliveries lose to newer states. A batch that runs again after a failure finds its own states stored and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        index = state_index(batch.sparkSession, path)
        rows = batch.where("id IS NOT NULL").select("id", "status", "version_hash", F.coalesce("updated_at", "delivered_at").alias("at"), "change_seq")
        new = latest_versions(rows, "id", F.col("at"), F.col("change_seq"))
        known = index.live().select(F.col("id").alias("_id"), F.struct("at", "change_seq").alias("_version"))
        newer = new.join(known, new["id"] == known["_id"], "left").where(F.col("_version").isNull() | (F.struct("at", "change_seq") > F.col("_version")))
        index.apply(newer.select(*new.columns), new.where("false").select("id"), str(number))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_index(spark: SparkSession, path: str) -> DataFrame:
    """The live pages so far."""
    return state_index(spark, path).live().where("status = 'ok'")


def frontier_stream(entries: DataFrame, path: str, checkpoint: str, clock: Callable[[], datetime] | None = None, delay: float = 1.0) -> StreamingQuery:
    """Plan the requests of a stream of ``url, priority, seq``: ``leases`` under ``path``, one ``delay`` apart in each origin and none before the batch's time.

    A URL is planned once, however often and in whatever spelling it comes. Each micro-batch plans all that it brings, so that no queue is left when the stream
    ends, and an origin with a third of the rows is ranked over many tasks. What has been planned is kept in segments (URLs, and for each origin the
    time that is free next) and published whole with the batch's number: a batch that runs again is planned again from the same state, or not at all once it is published.
    """
    now = clock or (lambda: datetime.now(timezone.utc))

    def plan(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = SegmentedIndex(spark, f"{path}/state", "id string, at timestamp")
        if state.state()["mark"] is not None and int(state.state()["mark"]) >= number:
            return
        live = state.live()
        rows = batch.select(normalize_url(F.col("url")).alias("url"), "priority", "seq").where("url IS NOT NULL AND seq IS NOT NULL")
        first = rows.groupBy("url").agg(F.min(F.struct("seq", "priority")).alias("f")).select("url", "f.priority", "f.seq")
        known = live.where("id LIKE 'url %'").select(F.substr("id", F.lit(5)).alias("url"))
        fresh = first.join(known, "url", "left_anti").withColumn("origin", origin(F.col("url")))
        times = live.where("id LIKE 'next %'").select(F.substr("id", F.lit(6)).alias("origin"), F.col("at").alias("next_at"))
        leases = checkpointed(frontier.schedule(fresh, times, now(), delay))
        leases.select("origin", "url", F.col("priority").cast("long").alias("priority"), "seq", "lease_at").write.mode("overwrite").parquet(f"{path}/leases/batch={number}")
        after = F.timestamp_micros(F.unix_micros(F.max("lease_at")) + int(delay * 1e6))
        urls = leases.select(F.concat(F.lit("url "), "url").alias("id"), F.lit(None).cast("timestamp").alias("at"))
        state.apply(urls.unionByName(leases.groupBy(F.concat(F.lit("next "), "origin").alias("id")).agg(after.alias("at"))), urls.where("false").select("id"), str(number))

    return entries.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def planned(spark: SparkSession, path: str) -> DataFrame:
    """The leases of all published batches."""
    mark = SegmentedIndex(spark, f"{path}/state", "id string, at timestamp").state()["mark"]
    if mark is None:
        return spark.createDataFrame([], LEASES)
    return spark.read.schema(LEASES + ", batch int").option("basePath", f"{path}/leases").parquet(f"{path}/leases").where(F.col("batch") <= int(mark)).drop("batch")


def apply_refresh(index: DataFrame, batch: DataFrame, since: datetime, overlap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """One batch refresh by high-water mark: changes updated after ``since`` less an overlap replace or remove their pages; applying one twice changes nothing.

    Gives the index and one row with the new ``mark``: the latest update read, or ``since`` if there was none.
    """
    cut = F.timestamp_micros(F.unix_micros(F.lit(since).cast("timestamp")) - int(overlap * 1e6))
    rows = batch.where(F.col("updated_at") > cut)
    new = latest_versions(rows, "id", F.col("updated_at"), F.col("change_seq"))
    mark = rows.agg(F.greatest(F.max("updated_at"), F.lit(since).cast("timestamp")).alias("mark"))
    return refreshed(index, new, "id", F.col("status") == "ok"), mark
