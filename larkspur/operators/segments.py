"""An index kept fresh in segments: each change is a new segment and tombstones for what it replaces; many segments are compacted into one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.incremental import VersionLog


class SegmentedIndex:
    """Rows by ``key`` in written segments under ``path``; versions are published whole.

    A row is live while no tombstone of a later segment names its key. Rows of one key within one ``apply`` should be one; the highest by all columns counts otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", max_segments: int = 8):
        self.spark, self.schema, self.key, self.max_segments = spark, schema, key, max_segments
        self.log = VersionLog(spark, path)

    def state(self) -> dict:
        """Newest version: its number, ``segments`` and ``tombstones`` as lists of (number, folder), and the mark of the changes read."""
        return self.log.latest() or {"version": 0, "next": 0, "segments": [], "tombstones": [], "mark": None}

    def _read(self, folders: list[list], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema).withColumn("_segment", F.lit(0))
        for number, folder in folders:  # at most max_segments
            out = out.unionByName(self.spark.read.schema(schema).parquet(folder).withColumn("_segment", F.lit(number)))
        return out

    def _live(self, state: dict) -> DataFrame:
        rows = self._read(state["segments"], self.schema)
        kind = rows.schema[self.key].dataType.simpleString()
        dead = self._read(state["tombstones"], f"{self.key} {kind}").groupBy(F.col(self.key).alias("_key")).agg(F.max("_segment").alias("_dead"))
        return rows.join(dead, (F.col(self.key) == F.col("_key")) & (F.col("_dead") > F.col("_segment")), "left_anti").drop("_segment")

    def live(self) -> DataFrame:
        """The rows that are valid now."""
        return self._live(self.state())

    def _write(self, df: DataFrame) -> str:
        folder = f"{self.log.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def apply(self, upserts: DataFrame, removals: DataFrame, mark: str | None = None) -> dict:
        """Add or replace ``upserts`` and remove the keys of ``removals``; both may be empty. Applying the same again changes nothing that is live."""
        state = self.state()
        number = state["next"] + 1
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        rows = upserts.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("_key")).agg(F.max(F.struct(*columns)).alias("r")).select("r.*")
        segment = self._write(rows)
        keys = self.spark.read.schema(self.schema).parquet(segment).select(self.key).unionByName(removals.select(self.key)).where(F.col(self.key).isNotNull()).distinct()
        new = state | {"version": state["version"] + 1, "next": number, "segments": [*state["segments"], [number, segment]], "tombstones": [*state["tombstones"], [number, self._write(keys)]], "mark": mark or state["mark"]}
        if len(new["segments"]) > self.max_segments:
            new |= {"segments": [[number, self._write(self._live(new))]], "tombstones": []}
        self.log.publish(new["version"], new)
        return new

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Remove folders that no version names any more."""
        s = self.state()
        return self.log.vacuum([f for _, f in [*s["segments"], *s["tombstones"]]], older_than)

    def status(self) -> DataFrame:
        """One row: ``documents, segments, tombstones``."""
        s = self.state()
        return self.live().agg(F.count(F.lit(1)).alias("documents")).withColumn("segments", F.lit(len(s["segments"]))).withColumn("tombstones", F.lit(len(s["tombstones"])))
