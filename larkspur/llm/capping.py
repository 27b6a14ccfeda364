"""Problem 3: at most a set number or share of records per contributor, the best ones.

Contributors at or under the cap need no rank. The records of the others are salted, as many salts to a contributor as it has
``piece_rows``, and ranked by quality and identifier inside (contributor, salt): a record whose rank there is over the cap is over it in
the whole as well, so that at most ``cap`` records a salt go on. These are ranked again over all salts, by range partitions of
(contributor, quality, identifier), so that no task holds a contributor whole in either step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.ranking import ranked
from larkspur.session import checkpointed, fresh


def quality_order(quality: str, ident: str) -> list[Column]:
    """Best first; null and NaN last; then by identifier."""
    q = F.col(quality)
    return [F.when(~F.isnan(q), q).desc_nulls_last(), F.col(ident).asc_nulls_last()]


def sizes(df: DataFrame, contributor: str) -> DataFrame:
    """Rows per contributor (columns ``contributor`` and ``records``), counted in the map tasks first and written once."""
    return checkpointed(df.groupBy(F.col(contributor).alias("contributor")).agg(F.count(F.lit(1)).alias("records")))


def share_cap(counts: DataFrame, share: float, at_least: int = 1) -> int:
    """The largest count that is no more than ``share`` of all records, but ``at_least`` some."""
    total = counts.agg(F.sum("records")).first()[0] or 0
    return max(at_least, math.floor(total * share + 1e-9))


def _pre_ranked(df: DataFrame, contributor: str, quality: str, ident: str, cap: int, counts: DataFrame, piece_rows: int, pre: str) -> DataFrame:
    """Rows of contributors with more than ``cap`` records and their rank ``pre`` among those of their salt."""
    key, salts, salt = fresh(df, "_contributor", "_salts", "_salt")
    # at most total/cap contributors are large: Spark broadcasts them where their measured size allows
    large = counts.where(F.col("records") > cap).select(F.col("contributor").alias(key), F.ceil(F.col("records") / piece_rows).alias(salts))
    rows = df.join(large, df[contributor].eqNullSafe(large[key]), "inner").withColumn(salt, F.pmod(F.xxhash64(ident), F.col(salts)))
    w = Window.partitionBy(contributor, salt).orderBy(*quality_order(quality, ident))
    return rows.withColumn(pre, F.row_number().over(w)).select(*df.columns, pre)


def over_cap(df: DataFrame, contributor: str, quality: str, ident: str, cap: int, counts: DataFrame | None = None, rank: str = "rank", piece_rows: int = 100_000) -> DataFrame:
    """Rows of contributors with more than ``cap`` records, with their rank; those with a rank over ``cap`` are in excess.

    Ranks are exact up to the cap, and beyond it for records that their salt let through; a record stopped there has its rank in the salt, which
    is over the cap too. A null contributor is a contributor of its own; equal qualities go by identifier, and fully equal rows in an
    order that is fixed once. An empty table gives an empty result.
    """
    counts = sizes(df, contributor) if counts is None else counts
    (pre,) = fresh(df, "_pre")
    rows = checkpointed(_pre_ranked(df, contributor, quality, ident, cap, counts, piece_rows, pre))
    stopped = rows.where(F.col(pre) > cap).select(*df.columns, F.col(pre).cast("long").alias(rank))
    return ranked(rows.where(F.col(pre) <= cap).select(*df.columns), [contributor], quality_order(quality, ident), rank).unionByName(stopped)


def capped(df: DataFrame, contributor: str, quality: str, ident: str, cap: int, counts: DataFrame | None = None, piece_rows: int = 100_000) -> DataFrame:
    """The records kept: all of small contributors, the best ``cap`` of the others. Spark stops at ``cap`` rows a salt before it shuffles."""
    counts = sizes(df, contributor) if counts is None else counts
    key, pre, rank = fresh(df, "_contributor", "_pre", "_rank")
    small = counts.where(F.col("records") <= cap).select(F.col("contributor").alias(key))
    rest = df.join(small, df[contributor].eqNullSafe(small[key]), "left_semi")
    best = _pre_ranked(df, contributor, quality, ident, cap, counts, piece_rows, pre).where(F.col(pre) <= cap).select(*df.columns)
    return rest.unionByName(ranked(best, [contributor], quality_order(quality, ident), rank).where(F.col(rank) <= cap).select(*df.columns))
