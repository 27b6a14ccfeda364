"""Joins whose keys may be as common as a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import fresh


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, by: str, piece: int = 100_000, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` by ``keys``, where ``count`` tells how many rows have them (about); null keys have no partner.

    A key with more than ``piece`` rows is divided by hash of the column ``by`` into pieces of about that size. There are at most rows/piece such keys:
    Spark broadcasts them where their measured size allows, and splits them where it finds them skewed beyond. ``how`` is inner or left_semi; an inner join
    adds the table's other columns.
    """
    n, salt = fresh(rows, "_salts", "_salt")
    sized = table.withColumn(n, F.floor(F.col(count) / piece) + 1)
    salted = rows.join(sized.where(F.col(n) > 1).select(*keys, n), keys, "left").withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1)))).drop(n)
    extra = [c for c in table.columns if c not in keys] if how == "inner" else []
    pieces = sized.select(*keys, *extra, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(salt))
    return salted.join(pieces, [*keys, salt], how).select(*rows.columns, *extra)


def spread_semi_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, by: str, piece: int = 100_000) -> DataFrame:
    """The rows whose ``keys`` are in ``table``, common keys divided as in ``spread_join``."""
    return spread_join(rows, table, keys, count, by, piece, "left_semi")
