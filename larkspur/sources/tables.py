"""Stored tables: empty ones by their schema, and tables of a database over JDBC."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from larkspur.schema import SCHEMAS


def create(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Write every table (or those named) that is not there yet, empty; gives the names written."""
    made = []
    for name in names or list(SCHEMAS):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
            made.append(name)
    return made


def drop(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Remove tables."""
    for name in names or list(SCHEMAS):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def jdbc_options(url: str) -> dict[str, str]:
    """Options of Spark's JDBC source from ``postgres://user:password@host:port/database?name=value``."""
    u = urlsplit(url)
    if u.scheme not in ("postgres", "postgresql"):
        raise ValueError("a database address begins with postgres://")
    out = {"url": f"jdbc:postgresql://{u.hostname}:{u.port or 5432}/{u.path.lstrip('/')}", "driver": "org.postgresql.Driver"}
    return out | {k: v for k, v in (("user", u.username), ("password", u.password)) if v} | dict(parse_qsl(u.query))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of a database; with a number ``column`` and its ``bounds`` it is read in ``parts`` pieces at once."""
    options = jdbc_options(url) | {"dbtable": table}
    if column and bounds:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append") -> None:
    """Append to (or replace) a table of a database."""
    df.write.format("jdbc").options(**jdbc_options(url), dbtable=table).mode(mode).save()
