"""Session helpers: the shared folder, table reading and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages links hosts frontier "
    "search_impressions search_clicks seeds page_changes refresh_runs context_windows source_targets"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a lazy Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a temporary folder is made and set.
    """
    jsc = spark.sparkContext._jsc.sc()
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not jsc.getCheckpointDir().isDefined():
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            path = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(path)
    return path or jsc.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, so that a lost executor cannot change what was decided."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Like ``checkpointed``, but as a compressed Parquet table; removed when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone, and its folder with it
        return


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not use yet, whatever its extra columns are called (case is ignored, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def same(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str] | None = None) -> Column:
    """Null-safe equality of key columns, as a join condition."""
    cond = F.lit(True)
    for a, b in zip(keys, right_keys or keys, strict=True):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond
