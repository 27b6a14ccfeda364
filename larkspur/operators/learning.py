"""Learning to rank from logs: counts, skip-above pairs, training and accuracy."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.schema import DEFAULTS, FEATURES, WEIGHTS
from larkspur.session import written


def distinct_rows(df: DataFrame) -> DataFrame:
    """Log rows of one id once."""
    return df.where("id IS NOT NULL").dropDuplicates(["id"])


def url_counts(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """``url, impressions, clicks``: how often each URL was shown, and clicked in all (0 if never)."""
    shown = distinct_rows(impressions).select(F.explode("payload.results.url").alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("impressions"))
    clicked = distinct_rows(clicks).where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("clicks"))
    return shown.join(clicked, "url", "left").select("url", "impressions", F.coalesce("clicks", F.lit(0)).alias("clicks"))


def recent(rows: DataFrame, now: datetime, days: int = DEFAULTS.training_days, at: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days before ``now``; rows without a time are left out."""
    return rows.where(F.unix_micros(at) >= F.unix_micros(F.lit(now).cast("timestamp")) - days * 86_400_000_000)


def smoothed_ctr(clicks: Column, impressions: Column) -> Column:
    """(clicks + 1) / (impressions + 10)."""
    return (clicks + 1.0) / (impressions + 10.0)


def skip_above_pairs(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """``impression_id, good, bad, difference``: a clicked result against each unclicked one above it, and the one right below.

    Of results with one position the first counts. Pairs need two whole feature arrays of equal length (12, no null or NaN). Clicks of unknown
    impressions are left out. A pair exists only inside one page of results, which is as large as a page may be.
    """
    where = distinct_rows(clicks).where("position IS NOT NULL").groupBy(F.col("impression_id").alias("id")).agg(F.collect_set("position").alias("clicked"))
    shown = distinct_rows(impressions.select("id", F.col("payload.results").alias("results"))).join(where, "id")
    first = F.filter("results", lambda r, i: r["position"].isNotNull() & ~F.exists(F.slice("results", 1, i), lambda o: o["position"] == r["position"]))
    whole = lambda r: (F.size(r["features"]) == len(FEATURES)) & ~F.exists(r["features"], lambda x: x.isNull() | F.isnan(x))
    rows = shown.withColumn("results", F.filter(first, whole))
    good = rows.select("id", "clicked", "results", F.explode(F.filter("results", lambda r: F.array_contains("clicked", r["position"]))).alias("g"))
    g = F.col("g.position")
    bad = F.filter("results", lambda r: ~F.array_contains("clicked", r["position"]) & ((r["position"] < g) | (r["position"] == g + 1)))
    pairs = good.select("id", "g", F.explode(bad).alias("b"))
    return pairs.select(F.col("id").alias("impression_id"), g.alias("good"), F.col("b.position").alias("bad"), F.zip_with("g.features", "b.features", lambda x, y: x - y).alias("difference"))


def margin(weights: list[float]) -> Column:
    """Weighted sum of a pair's differences."""
    return F.aggregate(F.zip_with(F.array(*[F.lit(float(w)) for w in weights]), F.col("difference"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def pair_accuracy(pairs: DataFrame, weights: list[float] = WEIGHTS) -> DataFrame:
    """``pairs, accuracy``: the share of pairs that the model puts in order; 0 without pairs."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.avg((margin(weights) > 0).cast("double")), F.lit(0.0)).alias("accuracy"))


def train(pairs: DataFrame, weights: list[float] = WEIGHTS, epochs: int = 20, rate: float = 0.05, pull: float = 0.01, steps: float = 100.0) -> list[float]:
    """Pairwise logistic regression, pulled towards the first weights: each epoch is one aggregate of the mean gradient, ``steps`` of it are taken.

    Deterministic and free of the order of rows, unlike descent pair by pair in random order, whose expected step it takes ``steps`` times an epoch (tests hold
    the two against each other); a log without pairs leaves the weights as they are.
    """
    rows = written(pairs.select("difference"), "pairs")
    w, first = list(weights), list(weights)
    for epoch in range(epochs):
        sigma = 1 / (1 + F.exp(margin(w)))
        sums = rows.agg(F.count(F.lit(1)), *[F.sum(sigma * F.get("difference", F.lit(i))) for i in range(len(w))]).first()
        if not sums[0]:
            return w
        step = rate / (1 + 0.1 * epoch) * steps
        hold = math.exp(-step * pull)  # the pull of many small steps at once
        w = [f + (x - f) * hold + step * (g / sums[0]) for x, f, g in zip(w, first, sums[1:], strict=True)]
    return w


@dataclass
class Training:
    """What a training run has found: pairs, the new weights (None if there were too few pairs) and the accuracy before and after."""

    pairs: int
    weights: list[float] | None
    before: float
    after: float


def train_run(impressions: DataFrame, clicks: DataFrame, now: datetime, weights: list[float] = WEIGHTS, days: int = DEFAULTS.training_days, minimum: int = DEFAULTS.minimum_pairs, **options: float) -> Training:
    """Learn from the clicks of the last days; fewer than ``minimum`` pairs leave the model as it is."""
    pairs = written(skip_above_pairs(impressions, recent(clicks, now, days)), "pairs")
    n, before = pair_accuracy(pairs, weights).first()
    if n < minimum:
        return Training(n, None, before, before)
    new = train(pairs, weights, **options)
    return Training(n, new, before, pair_accuracy(pairs, new).first().accuracy)


def appended_model(models: DataFrame, ident: str, weights: list[float], pairs: int, now: datetime) -> DataFrame:
    """The model table with one model more, a version above the newest (1 if there is none)."""
    new = models.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v")).select(
        F.lit(ident).alias("id"), F.col("v").alias("version"),
        F.struct(F.col("v").alias("version"), F.array(*[F.lit(n) for n in FEATURES]).alias("featureNames"), F.array(*[F.lit(float(w)) for w in weights]).alias("weights")).alias("model"),
        F.lit(pairs).alias("trained_pairs"), F.lit(now).cast("timestamp").alias("created_at"),
    )
    return models.unionByName(new.select(*models.columns))
