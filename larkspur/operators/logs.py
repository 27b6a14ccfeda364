"""Search logs: suggestions and the guard on clicks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.learning import distinct_rows
from larkspur.plans.query import normalize_phrase
from larkspur.schema import DEFAULTS


def suggest(impressions: DataFrame, prefix: str, limit: int = 10, at_least: int = 5) -> DataFrame:
    """``normalized_query, n`` of the most frequent queries that begin with the prefix, asked at least ``at_least`` times; none for a blank prefix."""
    start = normalize_phrase(prefix)
    rows = distinct_rows(impressions).where(F.col("normalized_query").startswith(start) & F.lit(bool(start)))
    return rows.groupBy("normalized_query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).orderBy(F.col("n").desc(), "normalized_query").limit(limit)


def impression_rows(shown: DataFrame, ident: str, raw: str, page: int, model_version: int, now: datetime) -> DataFrame:
    """One log row for a page of results (``rank, url, features``): the query's first 200 characters, its phrase, and each result with its place. No results, no row."""
    result = F.struct(F.col("url"), F.col("rank").cast("int").alias("position"), F.col("features"))
    rows = shown.agg(F.array_sort(F.collect_list(F.struct("rank", result.alias("r")))).alias("all")).where(F.size("all") > 0)  # at most 50 results
    return rows.select(
        F.lit(ident).alias("id"), F.lit(raw[: DEFAULTS.query_chars]).alias("query"), F.lit(normalize_phrase(raw)).alias("normalized_query"), F.lit(page).alias("page"),
        F.struct(F.transform("all", lambda x: x["r"]).alias("results")).alias("payload"), F.lit(model_version).alias("model_version"), F.lit(now).cast("timestamp").alias("created_at"),
    )


def loggable_clicks(clicks: DataFrame, impressions: DataFrame) -> DataFrame:
    """Clicks to append to the log: on a URL at the position where their impression shows it. Valid clicks of an unknown impression lead on but are not logged."""
    shown = distinct_rows(impressions).select(F.col("id").alias("impression_id"), F.inline("payload.results")).select("impression_id", "url", "position").distinct()
    return distinct_rows(clicks).join(shown, ["impression_id", "url", "position"], "left_semi").select(*clicks.columns)


def valid_clicks(clicks: DataFrame, impressions: DataFrame, pages: DataFrame) -> DataFrame:
    """Clicks that may be followed: on a URL at the position where its impression shows it; of an unknown impression, on a URL that is a page."""
    shown = distinct_rows(impressions).select(F.col("id").alias("impression_id"), F.inline("payload.results")).select("impression_id", "url", "position").distinct()
    known = impressions.select(F.col("id").alias("impression_id")).distinct()
    rows = distinct_rows(clicks)
    seen = rows.join(shown, ["impression_id", "url", "position"], "left_semi")
    stray = rows.join(known, "impression_id", "left_anti").join(pages.select("url").distinct(), "url", "left_semi")
    return seen.unionByName(stray.select(*seen.columns))
