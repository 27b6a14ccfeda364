"""Jobs from the command line, over a folder of tables (``name.parquet``): ``python -m larkspur.cli DIR link-analysis | train-ranker | seed URL``.

A changed table is written beside the old one and then takes its name, so that a job that fails leaves the tables as they were.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.api import Engine
from larkspur.schema import SCHEMAS


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored tables; those that are missing are empty."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet"))
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") if there(n) else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}


def save(spark: SparkSession, folder: str, name: str, df: DataFrame) -> None:
    """Put a new version of a table in the place of the old one."""
    path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f".{name}-{uuid.uuid4().hex}", f".{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{new}")
    if fs.exists(path(f"{name}.parquet")):
        fs.rename(path(f"{name}.parquet"), path(old))
    fs.rename(path(new), path(f"{name}.parquet"))
    fs.delete(path(old), True)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    parser.add_argument("folder")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("link-analysis", help="rank pages and hosts by their links and store the ranks")
    train = jobs.add_parser("train-ranker", help="learn a ranking model from the click log and store it as a new version")
    train.add_argument("--days", type=int, help="how many days of clicks count (30)")
    train.add_argument("--min-pairs", type=int, help="fewer pairs leave the model as it is (1000)")
    train.add_argument("--dry-run", action="store_true", help="do not store the model")
    seed = jobs.add_parser("seed", help="add an address to begin with and queue it")
    seed.add_argument("url")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    engine = Engine(spark, load(spark, a.folder))
    if a.job == "link-analysis":
        out, changed = engine.link_analysis(), ["pages", "hosts"]
    elif a.job == "train-ranker":
        got = engine.train_ranker(a.days, a.min_pairs, a.dry_run)
        out, changed = got.__dict__, ["pages", *(["ranking_models"] if got.weights and not a.dry_run else [])]
    else:
        engine.add_seed(str(uuid.uuid4()), a.url)
        out, changed = engine.recrawl(a.url), ["seeds", "frontier"]
    for name in changed:
        save(spark, a.folder, name, engine.tables[name])
    return out


if __name__ == "__main__":
    print(main())
