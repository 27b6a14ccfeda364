"""Processing only new or changed records: the target is the state.

Every output row stores the source key and the version that it was made from.  A run anti-joins the source
against the rows published so far, writes what is new beside them and then publishes one new target version
by an atomic rename of a small manifest.  What a failed run has written is never named by a manifest, so it
neither hides records from the next run nor repeats them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import table


class VersionLog:
    """Numbered versions of a folder, each a small JSON file that appears whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._jvm = spark, spark._jvm
        hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        plain = hadoop.Path(path.rstrip("/"))
        self._fs = plain.getFileSystem(conf)
        whole = self._fs.makeQualified(plain)
        self.path = whole.toString()
        self._fc = hadoop.FileContext.getFileContext(whole.toUri(), conf)
        self._fs.mkdirs(self._p("_log"))

    def _p(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def latest(self) -> dict | None:
        """The newest published version, or None."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("_log"))]
        done = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not done:
            return None
        stream = self._fs.open(self._p(f"_log/{max(done)}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, body: dict) -> None:
        """Make ``version`` known by one atomic rename that refuses an existing goal: of two runs at once, one fails and can be tried again."""
        draft = self._p(f"_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._fc.rename(draft, self._p(f"_log/{version:012d}.json"), options)

    def vacuum(self, keep: list[str], older_than: float = 86_400.0) -> int:
        """Remove the data folders that ``keep`` does not name and nobody has written to for ``older_than`` seconds, as failed runs leave them."""
        data, gone = self._p("data"), 0
        if not self._fs.exists(data):
            return 0
        for s in self._fs.listStatus(data):
            if s.getPath().toString() not in keep and s.getModificationTime() < (time.time() - older_than) * 1000:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


@dataclass
class Manifest:
    """One published target version: the folders that belong to it."""

    version: int = 0
    parts: list[str] = field(default_factory=list)


class IncrementalTarget:
    """A target table in a shared folder that takes up each new or changed record once.

    ``key`` names the record, ``version`` orders its states (a later state has a greater one). Rows with a null
    key or version are no records and are left out. Equal versions of a key count as one; an older one that
    arrives late is skipped. Extra source columns are ignored, whatever their names. Every ``compact_after`` parts are
    written anew as one, at publication, so that a run reads few folders.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, compact_after: int = 8):
        self.spark, self.key, self.version, self.compact_after = spark, key, version, compact_after
        self.log = VersionLog(spark, path)
        self.path = self.log.path

    def manifest(self) -> Manifest:
        """The newest published version; version 0 if there is none."""
        body = self.log.latest()
        return Manifest(body["version"], body["parts"]) if body else Manifest()

    def rows(self, manifest: Manifest | None = None) -> DataFrame | None:
        """All published rows, or None before the first version."""
        m = manifest or self.manifest()
        return self.spark.read.parquet(*m.parts) if m.parts else None

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Remove what failed runs and compactions have left."""
        return self.log.vacuum(self.manifest().parts, older_than)

    def _part(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def run(
        self,
        source: DataFrame,
        run_id: int,
        arrival: str | None = None,
        until: datetime | None = None,
        before_publish: Callable[[], None] | None = None,
    ) -> Manifest:
        """Take up what is new or changed in ``source`` and publish it as one new version.

        With ``arrival`` and ``until``, only rows that arrived up to and including ``until`` are read. The target alone tells what is known: a
        record that turns up later than its arrival says is taken by the next run. ``before_publish`` is called when all
        is written but nothing published (for tests of failures).
        """
        last = self.manifest()
        rows = source.select(F.col(self.key).alias("key"), F.col(self.version).alias("version"), *([F.col(arrival).alias("at")] if arrival else []))
        if arrival and until is not None:
            rows = rows.where(F.col("at") <= F.lit(until))
        # partial aggregation before the shuffle: a key delivered very often costs one row a task
        latest = rows.where(F.col("key").isNotNull() & F.col("version").isNotNull()).groupBy("key").agg(F.max("version").alias("version"))
        known = self.rows(last)
        if known is not None:
            k = known.select(F.col("key").alias("k"), F.col("version").alias("v"))
            latest = latest.join(k, (F.col("key") == F.col("k")) & (F.col("v") >= F.col("version")), "left_anti")
        parts = [*last.parts, self._part()]
        latest.withColumn("run_id", F.lit(run_id).cast("long")).write.parquet(parts[-1])
        if len(parts) > self.compact_after:
            whole = self._part()
            self.spark.read.parquet(*parts).repartition("key").sortWithinPartitions("key").write.parquet(whole)
            parts = [whole]
        if before_publish:
            before_publish()
        new = Manifest(last.version + 1, parts)
        self.log.publish(new.version, new.__dict__)
        return new


def successful_runs(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """Runs that ended well, in order, with their cutoff as UTC text. The table holds one row a run."""
    runs = table(spark, sf_dir, "refresh_runs").where((F.lower(F.trim("outcome")) == "ok") & F.col("finished_at").isNotNull() & F.col("cutoff_at").isNotNull())
    return [(r.run_id, r.at) for r in runs.select("run_id", F.date_format("cutoff_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).orderBy("run_id").collect()]
