"""Queries of the incremental operator (problem 1)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.incremental import IncrementalTarget, successful_runs
from larkspur.session import scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each successful refresh run took up: the runs are replayed one by one, each against the target so far."""
    changes = table(spark, sf_dir, "page_changes").select("id", "delivered_at", F.coalesce("updated_at", "delivered_at").alias("state_at"))
    target = IncrementalTarget(spark, scratch_path(spark, "p1"), "id", "state_at")
    for run_id, at in successful_runs(spark, sf_dir):
        until = datetime.strptime(at, "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=timezone.utc)
        target.run(changes, run_id, arrival="delivered_at", until=until)
    rows = target.rows()
    if rows is None:
        return spark.createDataFrame([], "run_id long, id string")
    return rows.select("run_id", F.col("key").alias("id"))


QUERIES = {"p1_found": p1_found}

ORACLE = {
    "p1_found": """
WITH ok_runs AS (
  SELECT run_id, cutoff_at, max(cutoff_at) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_at
  FROM refresh_runs WHERE lower(trim(outcome)) = 'ok' AND finished_at IS NOT NULL AND cutoff_at IS NOT NULL
), taken AS (
  SELECT r.run_id, c.id, max(coalesce(c.updated_at, c.delivered_at)) AS t
  FROM ok_runs r JOIN page_changes c ON c.delivered_at <= r.cutoff_at AND (r.before_at IS NULL OR c.delivered_at > r.before_at)
  WHERE c.id IS NOT NULL GROUP BY 1, 2
), seen AS (
  SELECT run_id, id, t, max(t) OVER (PARTITION BY id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM taken
)
SELECT run_id, id FROM seen WHERE known IS NULL OR t > known
"""
}
