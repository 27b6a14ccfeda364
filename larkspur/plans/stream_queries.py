"""Queries that run a stream to its end over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import crawl
from larkspur.operators.crawl import priority
from larkspur.plans import duck
from larkspur.plans.crawl_queries import _CHANGES, _PRIORITY, NOW, NOW_SQL
from larkspur.session import scratch_path, table
from larkspur.streaming import refresh

SINCE_SQL = "TIMESTAMPTZ '2026-03-15 00:00:00+00'"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a folder or one file."""
    at = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return source.parquet(at) if folder else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live index after all page changes were streamed through it."""
    path = scratch_path(spark, "refresh")
    refresh.refresh_stream(_stream(spark, sf_dir, "page_changes"), f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return refresh.fresh_index(spark, f"{path}/state").select("id", "version_hash", "change_seq")


def stream_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each address of the frontier is asked, planned from a stream of its rows a second apart in each origin."""
    path = scratch_path(spark, "frontier")
    rows = _stream(spark, sf_dir, "frontier").select("url", priority(F.col("kind"), F.col("depth"), F.col("retries")).cast("long").alias("priority"), "seq")
    refresh.frontier_stream(rows, path, f"{path}/checkpoint", lambda: NOW).awaitTermination()
    return refresh.planned(spark, path).select("origin", "url", "seq", F.unix_micros("lease_at").alias("lease_us"))


def refresh_by_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of early updates after one refresh by high-water mark, with two seconds of overlap."""
    from datetime import datetime, timezone

    since = datetime(2026, 3, 15, tzinfo=timezone.utc)
    rows = table(spark, sf_dir, "page_changes").select("id", "change_seq", "status", "version_hash", "updated_at").where("updated_at IS NOT NULL")
    old = crawl.latest_versions(rows.where(F.col("updated_at") <= F.lit(since)), "id", F.col("updated_at"), F.col("change_seq")).where("status = 'ok'")
    index, mark = refresh.apply_refresh(old.select("id", "version_hash"), rows, since)
    return index.join(mark, how="cross").select("id", "version_hash", F.unix_micros("mark").alias("mark_us"))  # one row of mark


QUERIES = {f.__name__: f for f in (stream_refresh, stream_frontier, refresh_by_mark)}

ORACLE = {
    "stream_refresh": "SELECT id, version_hash, change_seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, delivered_at) DESC, change_seq DESC) AS n FROM page_changes WHERE id IS NOT NULL) WHERE n = 1 AND status = 'ok'",
    # all rows are one batch here
    "stream_frontier": f"""
WITH f AS (SELECT {duck.normalize_url('url')} AS url, seq, {_PRIORITY} AS priority FROM frontier WHERE seq IS NOT NULL),
g AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, url, min(seq) AS seq, arg_min(priority, {{'a': seq, 'b': priority}}) AS priority FROM f WHERE url IS NOT NULL GROUP BY url)
SELECT origin, url, seq, epoch_us({NOW_SQL}) + 1000000 * (row_number() OVER (PARTITION BY origin ORDER BY priority, seq, url) - 1) AS lease_us FROM g
""",
    "refresh_by_mark": f"""
WITH {_CHANGES.replace('seen_at FROM page_changes WHERE', 'seen_at FROM page_changes WHERE updated_at IS NOT NULL AND')},
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c WHERE seen_at <= {SINCE_SQL}) WHERE n = 1 AND status = 'ok'),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c WHERE seen_at > {SINCE_SQL} - INTERVAL 2 SECOND) WHERE n = 1)
SELECT id, version_hash, (SELECT epoch_us(max(seen_at)) FROM w) AS mark_us FROM (SELECT id, version_hash FROM o WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, version_hash FROM w WHERE status = 'ok')
""",
}
