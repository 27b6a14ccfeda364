"""Queries over search logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import learning, logs
from larkspur.plans.search_queries import _CRAWLER, NOW, _features_sql, _page
from larkspur.schema import FEATURES, WEIGHTS
from larkspur.session import table


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "search_impressions").select("id", "payload"), table(spark, sf_dir, "search_clicks")


def click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions, clicks and smoothed click rate of every URL shown."""
    rows = learning.url_counts(*_logs(spark, sf_dir))
    return rows.select("url", "impressions", "clicks", F.round(learning.smoothed_ctr(F.col("clicks"), F.col("impressions")), 9).alias("ctr"))


def count_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the counts they have after the write-back; pages never shown keep theirs."""
    pages = table(spark, sf_dir, "pages").select("id", "url", F.col("impressions").alias("old_i"), F.col("clicks").alias("old_c")).dropDuplicates(["id"])
    joined = pages.join(learning.url_counts(*_logs(spark, sf_dir)), "url", "left")
    return joined.select("id", F.coalesce("impressions", F.col("old_i").cast("long")).alias("impressions"), F.when(F.col("impressions").isNotNull(), F.col("clicks")).otherwise(F.col("old_c").cast("long")).alias("clicks"))


def skip_above_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs with the first and last of their differences."""
    rows = learning.skip_above_pairs(*_logs(spark, sf_dir))
    return rows.select("impression_id", "good", "bad", F.round(F.get("difference", F.lit(0)), 6).alias("bm25"), F.round(F.get("difference", F.lit(11)), 6).alias("language_match"))


def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs the first model puts in order."""
    return learning.pair_accuracy(learning.skip_above_pairs(*_logs(spark, sf_dir))).select("pairs", F.round("accuracy", 9).alias("accuracy"))


def train_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights before and after training, with the accuracy of either."""
    pairs = learning.skip_above_pairs(*_logs(spark, sf_dir))
    after = learning.train(pairs)
    rows = spark.createDataFrame(list(zip(FEATURES, map(float, WEIGHTS), after, strict=True)), "feature string, before double, after double")
    one = learning.pair_accuracy(pairs).select("pairs", F.col("accuracy").alias("accuracy_before"))
    two = learning.pair_accuracy(pairs, after).select(F.col("accuracy").alias("accuracy_after"))
    both = rows.join(one.join(two, how="cross"), how="cross")  # one row each
    return both.select("feature", *[F.round(c, 6).alias(c) for c in ("before", "after")], "pairs", *[F.round(c, 6).alias(c) for c in ("accuracy_before", "accuracy_after")])


def training_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs of the clicks of the last ten days."""
    impressions, clicks = _logs(spark, sf_dir)
    return learning.skip_above_pairs(impressions, learning.recent(clicks, NOW, 10)).select("impression_id", "good", "bad")


def model_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model log after one model more; the versions that the impressions name stand for the stored models."""
    models = table(spark, sf_dir, "search_impressions").where("model_version IS NOT NULL").groupBy(F.col("model_version").alias("version")).agg(F.min("id").alias("id"))
    names, zeros = F.array(*[F.lit(n) for n in FEATURES]), F.array(*[F.lit(0.0)] * len(FEATURES))
    models = models.select("id", "version", F.struct("version", names.alias("featureNames"), zeros.alias("weights")).alias("model"), F.lit(0).alias("trained_pairs"), F.lit(NOW).cast("timestamp").alias("created_at"))
    pairs = learning.skip_above_pairs(*_logs(spark, sf_dir)).count()
    rows = learning.appended_model(models, "new", WEIGHTS, pairs, NOW)
    return rows.select("id", F.col("version").cast("long").alias("version"), F.round(F.get("model.weights", F.lit(0)), 6).alias("first_weight"), F.col("trained_pairs").cast("long").alias("trained_pairs"))


def click_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that are written to the log."""
    impressions, clicks = _logs(spark, sf_dir)
    return logs.loggable_clicks(clicks, impressions).select("id", "impression_id", "position", "url")


def impression_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log row of a page of results, its payload as JSON and read back."""
    shown = _page(spark, sf_dir)
    row = logs.impression_rows(shown, "i1", "Crawler  SNAPSHOT", 2, 0, NOW)
    text = row.withColumn("payload", F.from_json(F.to_json("payload"), "results array<struct<url:string,position:int,features:array<double>>>"))
    return text.select("id", "query", "normalized_query", "page", "model_version", F.inline("payload.results")).select("id", "query", "normalized_query", "page", "model_version", "url", "position", F.round(F.get("features", F.lit(0)), 6).alias("bm25"))


def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent queries that begin with c."""
    return logs.suggest(table(spark, sf_dir, "search_impressions").select("id", "normalized_query"), "c")


def click_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that may be logged."""
    impressions, clicks = _logs(spark, sf_dir)
    return logs.valid_clicks(clicks, impressions, table(spark, sf_dir, "pages")).select("id")


QUERIES = {f.__name__: f for f in (click_counts, count_writeback, skip_above_pairs, pair_accuracy, train_ranker, training_window, model_append, suggest, click_guard, click_append, impression_append)}

_IMP = "imp AS (SELECT id, any_value(payload.results) AS results FROM search_impressions WHERE id IS NOT NULL GROUP BY id)"
_CLK = "clk AS (SELECT id, any_value(impression_id) AS impression_id, any_value(position) AS position, any_value(url) AS url FROM search_clicks WHERE id IS NOT NULL GROUP BY id)"
_COUNTS = f"{_IMP}, {_CLK}, shown AS (SELECT url, count(*) AS impressions FROM (SELECT unnest(results).url AS url FROM imp) WHERE url IS NOT NULL GROUP BY url), clicked AS (SELECT url, count(*) AS clicks FROM clk WHERE url IS NOT NULL GROUP BY url), counts AS (SELECT url, impressions, coalesce(clicks, 0) AS clicks FROM shown LEFT JOIN clicked USING (url))"
_PAIRS = f"""
{_IMP}, {_CLK},
flat AS (SELECT id, i, results[i].position AS position, results[i].features AS f FROM (SELECT id, results, unnest(range(1, len(results) + 1)) AS i FROM imp)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, position ORDER BY i) AS n FROM flat WHERE position IS NOT NULL) WHERE n = 1 AND len(f) = 12 AND len(list_filter(f, lambda x: x IS NULL OR isnan(x))) = 0),
marked AS (SELECT r.*, EXISTS (SELECT 1 FROM clk WHERE clk.impression_id = r.id AND clk.position = r.position) AS hit FROM firsts r),
pairs AS (SELECT g.id AS impression_id, g.position AS good, b.position AS bad, list_transform(range(1, 13), lambda k: g.f[k] - b.f[k]) AS d
  FROM marked g JOIN marked b ON b.id = g.id AND g.hit AND NOT b.hit AND (b.position < g.position OR b.position = g.position + 1))"""

_RECENT = "created_at >= TIMESTAMPTZ '2026-04-01 00:00:00+00' - INTERVAL 10 DAY"
_W0 = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"

ORACLE = {
    "click_counts": f"WITH {_COUNTS} SELECT url, impressions, clicks, round((clicks + 1.0::DOUBLE) / (impressions + 10), 9) AS ctr FROM counts",
    "count_writeback": f"WITH {_COUNTS}, p AS (SELECT id, any_value(url) AS url, any_value(impressions) AS i, any_value(clicks) AS c FROM pages GROUP BY id) SELECT id, coalesce(impressions, CAST(i AS BIGINT)) AS impressions, CASE WHEN impressions IS NOT NULL THEN clicks ELSE CAST(c AS BIGINT) END AS clicks FROM p LEFT JOIN counts USING (url)",
    "skip_above_pairs": f"WITH {_PAIRS} SELECT impression_id, good, bad, round(d[1], 6) AS bm25, round(d[12], 6) AS language_match FROM pairs",
    "pair_accuracy": f"WITH {_PAIRS} SELECT count(*) AS pairs, round(coalesce(avg(CASE WHEN {' + '.join(f'{w} * d[{i + 1}]' for i, w in enumerate(WEIGHTS))} > 0 THEN 1.0 ELSE 0.0 END), 0), 9) AS accuracy FROM pairs",
    "suggest": "SELECT normalized_query, count(*) AS n FROM (SELECT id, any_value(normalized_query) AS normalized_query FROM search_impressions WHERE id IS NOT NULL GROUP BY id) WHERE starts_with(normalized_query, 'c') GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, normalized_query LIMIT 10",
    "training_window": f"WITH {_PAIRS.replace('FROM search_clicks WHERE id IS NOT NULL', 'FROM search_clicks WHERE id IS NOT NULL AND ' + _RECENT)} SELECT impression_id, good, bad FROM pairs",
    # each step is one mean gradient over all pairs
    "train_ranker": f"""
WITH RECURSIVE {_PAIRS}, m AS MATERIALIZED (SELECT d FROM pairs),
step(epoch, w) AS (
  SELECT 0, {_W0} UNION ALL
  SELECT epoch + 1, list_transform(range(1, 13), lambda i: {_W0}[i] + (w[i] - {_W0}[i]) * exp(-5.0::DOUBLE / (1 + 0.1::DOUBLE * epoch) * 0.01::DOUBLE) + 5.0::DOUBLE / (1 + 0.1::DOUBLE * epoch) * g[i] / n)
  FROM (SELECT epoch, w, count(*) AS n, [{', '.join(f'sum(s * d[{i}])' for i in range(1, 13))}] AS g FROM (SELECT epoch, w, d, 1 / (1 + exp(list_dot_product(w, d))) AS s FROM step, m WHERE epoch < 20) GROUP BY epoch, w)
), last AS (SELECT w FROM step ORDER BY epoch DESC LIMIT 1)
SELECT unnest([{', '.join(f"'{n}'" for n in FEATURES)}]) AS feature, round(unnest({_W0}), 6) AS before, round(unnest(w), 6) AS after, (SELECT count(*) FROM m) AS pairs,
  (SELECT round(avg(CASE WHEN list_dot_product({_W0}, d) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM m) AS accuracy_before, (SELECT round(avg(CASE WHEN list_dot_product(l.w, d) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM m, last l) AS accuracy_after
FROM last
""",
    "model_append": f"""
WITH {_PAIRS}, v AS (SELECT model_version AS version, min(id) AS id FROM search_impressions WHERE model_version IS NOT NULL GROUP BY 1)
SELECT id, CAST(version AS BIGINT) AS version, 0.0::DOUBLE AS first_weight, 0::BIGINT AS trained_pairs FROM v UNION ALL SELECT 'new', (SELECT coalesce(max(version), 0) + 1 FROM v), {WEIGHTS[0]}::DOUBLE, (SELECT count(*) FROM pairs)
""",
    "click_append": f"WITH {_IMP}, {_CLK}, shown AS (SELECT DISTINCT id AS impression_id, r.url AS url, r.position AS position FROM (SELECT id, unnest(results) AS r FROM imp)) SELECT id, impression_id, position, url FROM clk WHERE (impression_id, url, position) IN (SELECT impression_id, url, position FROM shown)",
    "impression_append": _features_sql(_CRAWLER) + " SELECT 'i1' AS id, 'Crawler  SNAPSHOT' AS query, 'crawler snapshot' AS normalized_query, 2 AS page, 0 AS model_version, url, CAST(rank AS INTEGER) AS position, round(f1, 6) AS bm25 FROM shown",
    "click_guard": f"WITH {_IMP}, {_CLK}, shown AS (SELECT DISTINCT id AS impression_id, r.url AS url, r.position AS position FROM (SELECT id, unnest(results) AS r FROM imp)) SELECT id FROM clk WHERE (impression_id, url, position) IN (SELECT impression_id, url, position FROM shown) OR (impression_id NOT IN (SELECT id FROM imp) AND url IN (SELECT url FROM pages WHERE url IS NOT NULL))",
}
