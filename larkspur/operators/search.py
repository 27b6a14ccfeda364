"""Retrieval and ranking: BM25F over postings, filters, features, model score, crowding and pages of results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.hashing import shard, url_hash
from larkspur.functions.text import snippet
from larkspur.functions.urls import host_within, path_depth
from larkspur.operators.index import corpus_stats, matching_postings, normalized
from larkspur.plans.query import Query
from larkspur.schema import DEFAULTS, FEATURES, FIELD_B, FIELD_WEIGHTS, FIELDS, K1, SYNONYM_FACTOR, WEIGHTS, Settings

# Signs that stay as they are in a query, by their codes.
OPEN = [("%2F", "/"), ("%3A", ":"), ("%3F", "?"), ("%40", "@"), ("%21", "!"), ("%24", "$"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%3B", ";"), ("%2B", "+")]


def idf(documents: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log1p((documents - df + 0.5) / (df + 0.5))


def weighted_tf(tf: str, lengths: str, averages: str) -> Column:
    """Sum over the fields of weight * tf / (1 - b + b * length / average length)."""
    total = F.lit(0.0)
    for i, (w, b) in enumerate(zip(FIELD_WEIGHTS, FIELD_B, strict=True)):
        total = total + w * F.get(tf, F.lit(i)) / (1 - b + b * F.get(lengths, F.lit(i)) / F.get(averages, F.lit(i)))
    return total


def variants(spark, query: Query) -> DataFrame:  # noqa: ANN001
    """``term`` (as indexed), ``ord``, ``factor`` and ``alt``: each query term and its synonyms, as many rows as the query has words."""
    rows = [(t, i, 1.0, 0) for i, t in enumerate(query.terms)]
    rows += [(s, i, SYNONYM_FACTOR, k + 1) for i, t in enumerate(query.terms) for k, s in enumerate(query.synonyms.get(t, []))]
    return spark.createDataFrame(rows, "term string, ord int, factor double, alt int")


def bm25(posts: DataFrame, stats: DataFrame, query: Query) -> DataFrame:
    """``page_id, bm25, matched, title_matches, anchor_matches`` of pages with any term.

    Of a term and its synonyms the best counts, the term itself among equals. ``matched`` lists ordinals of query terms in order.
    The query's few words are broadcast with their document frequencies; a page's partial scores meet by page.
    """
    words = [t for t in dict.fromkeys([*query.terms, *[s for a in query.synonyms.values() for s in a]])]
    hits = posts.where(F.col("term").isin(words))
    # one row a word of the query (at most 200 characters long): small by construction
    found = F.broadcast(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(variants(posts.sparkSession, query), "term"))
    scored = hits.join(found, "term").join(F.broadcast(stats), how="cross")  # stats: one row
    w = weighted_tf("tf", "lengths", "average_lengths")
    score = F.col("factor") * idf(F.col("documents"), F.col("df")) * w / (K1 + w)
    each = scored.select("page_id", "ord", F.struct(score.alias("score"), (-F.col("alt")).alias("alt"), (F.get("tf", F.lit(0)) > 0).alias("title"), (F.get("tf", F.lit(3)) > 0).alias("anchor")).alias("s"))
    per_page = each.repartition("page_id").groupBy("page_id", "ord").agg(F.max("s").alias("s"))  # both groupings share the one shuffle
    return per_page.groupBy("page_id").agg(
        F.sum("s.score").alias("bm25"), F.array_sort(F.collect_list("ord")).alias("matched"), F.count_if("s.title").alias("title_matches"), F.count_if("s.anchor").alias("anchor_matches")
    )


def document_columns(sources: DataFrame, query: Query) -> DataFrame:
    """What ranking needs of each page that passes the filters; texts are tested where they lie and never shuffled."""
    rows = sources if "norm_text" in sources.columns else normalized(sources)
    if query.site:
        rows = rows.where(host_within(F.col("host"), query.site))
    if query.language:
        rows = rows.where(F.coalesce(F.lower("language").startswith(query.language), F.lit(False)))
    for phrase in query.phrases:
        rows = rows.where(F.col("norm_title").contains(phrase) | F.col("norm_text").contains(phrase))
    said = F.lit(bool(query.text))
    return rows.select(
        "page_id", "url", "host", "title", "description", "language", "changed_at", "page_rank", "host_rank", "clicks", "impressions", path_depth(F.col("norm_url")).alias("depth"),
        (said & F.col("norm_title").contains(query.text)).cast("double").alias("in_title"), (said & F.col("norm_text").contains(query.text)).cast("double").alias("in_body"),
    )


def features(query: Query, now: datetime) -> Column:
    """The twelve ranking features in order."""
    n = float(max(1, len(query.terms)))
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("changed_at")) / 86_400e6)
    lang = F.when(F.col("language").isNull(), 0.5).otherwise((F.lower("language").startswith("ja") == F.lit(query.has_cjk)).cast("double"))
    share = lambda x, most: F.when(F.col(most) > 0, F.col(x) / F.col(most)).otherwise(0.0)
    return F.array(
        F.log1p("bm25"), F.size("matched") / n, F.col("title_matches") / n, F.col("anchor_matches") / n, F.col("in_title"), F.col("in_body"), share("page_rank", "max_page_rank"),
        share("host_rank", "max_host_rank"), F.when(F.col("changed_at").isNull(), 0.0).otherwise(F.exp(-age / 365)), 1.0 / (1 + F.col("depth")), (F.col("clicks") + 1.0) / (F.col("impressions") + 10.0), lang,
    )


def linear_score(vector: Column, weights: list[float] = WEIGHTS) -> Column:
    """Sum of weight times feature."""
    return F.aggregate(F.zip_with(F.array(*[F.lit(float(w)) for w in weights]), vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def query_words(query: Query) -> list[str]:
    """All words whose postings a query needs: terms, synonyms and excluded words."""
    return [*query.terms, *[s for a in query.synonyms.values() for s in a], *query.excluded]


def matched(sources: DataFrame, tokens: DataFrame | None, query: Query, posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Every page that a query finds, with its parts of the score and what ranking needs of it.

    ``posts`` and ``stats`` are those of a stored index if there is one, else the query's postings are taken from the token arrays.
    """
    posts = matching_postings(tokens, query_words(query)) if posts is None else posts
    hits = bm25(posts, corpus_stats(tokens, sources) if stats is None else stats, query)
    if query.excluded:
        hits = hits.join(posts.where(F.col("term").isin(query.excluded)).select("page_id"), "page_id", "left_anti")
    return hits.join(document_columns(sources, query), "page_id")


def candidates(
    sources: DataFrame, tokens: DataFrame | None, query: Query, now: datetime, settings: Settings = DEFAULTS, posts: DataFrame | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """The best pages of each shard by preliminary score, with features. A query without terms has no result."""
    stats = corpus_stats(tokens, sources) if stats is None else stats
    rows = matched(sources, tokens, query, posts, stats).join(F.broadcast(stats.select("max_page_rank", "max_host_rank")), how="cross")  # stats: one row
    rows = rows.withColumn("features", features(query, now))
    f = lambda i: F.get("features", F.lit(i))
    rows = rows.withColumn("preliminary", F.col("bm25") * f(1) * f(1) * (1 + 0.5 * f(4) + 0.2 * f(5)) * (1 + 0.5 * f(6)))
    rows = rows.withColumn("shard", shard(url_hash("url"), settings.shards))
    # limited within each task before the shuffle; scores that differ beyond 12 decimals only go by URL
    best = Window.partitionBy("shard").orderBy(F.round("preliminary", 12).desc(), "url")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= settings.candidates)


def total(sources: DataFrame, tokens: DataFrame | None, query: Query, posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """One row ``total``: how many pages a query finds, before any limit."""
    if not query.terms:
        return sources.where("false").agg(F.count(F.lit(1)).alias("total"))
    return matched(sources, tokens, query, posts, stats).agg(F.count(F.lit(1)).alias("total"))


def diversified(ranked: DataFrame, max_per_host: int = DEFAULTS.max_per_host) -> DataFrame:
    """Add ``rank``: by score and URL, but what exceeds ``max_per_host`` results of a host comes after all the rest. For bounded candidate lists."""
    within = Window.partitionBy("host").orderBy(F.round("score", 12).desc(), "url")
    rows = ranked.withColumn("_nth", F.row_number().over(within))
    overall = Window.orderBy((F.col("_nth") > max_per_host).cast("int"), F.round("score", 12).desc(), "url")
    return rows.withColumn("rank", F.row_number().over(overall)).drop("_nth")


def search(
    sources: DataFrame, tokens: DataFrame | None, query: Query, now: datetime, page: int = 1, per: int = 10, weights: list[float] = WEIGHTS, settings: Settings = DEFAULTS, posts: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """One page of results: ``rank, page_id, url, host, title, description, snippet, score, features, terms, shard, changed_at``; snippets are made for the page only.

    ``terms`` are the words of the query that the page has.
    """
    if not 1 <= page <= 100 or not 1 <= per <= 50:
        raise ValueError("page must be 1 to 100 and per 1 to 50")
    if not query.terms:
        return sources.where("false").select(
            F.lit(0).alias("rank"), "page_id", "url", "host", "title", "description", F.lit("").alias("snippet"), F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("features"),
            F.array().cast("array<string>").alias("terms"), F.lit(0).alias("shard"), "changed_at",
        )
    found = candidates(sources, tokens, query, now, settings, posts, stats)
    words = F.array(*[F.lit(t) for t in query.terms])
    found = found.select("page_id", "url", "host", "title", "description", "changed_at", "shard", "features", F.transform("matched", lambda i: F.element_at(words, i + 1)).alias("terms"), linear_score(F.col("features"), weights).alias("score"))
    shown = diversified(found, settings.max_per_host).where(F.col("rank").between((page - 1) * per + 1, page * per))
    texts = sources.select("page_id", F.col("content").alias("_content"))
    shown = texts.join(F.broadcast(shown), "page_id")  # at most 50 rows
    snip = snippet(F.col("_content"), F.col("description"), query.terms, settings.snippet_chars)
    return shown.select("rank", "page_id", "url", "host", "title", "description", snip.alias("snippet"), F.round("score", 3).alias("score"), "features", "terms", "shard", "changed_at")


def click_url(impression: Column, position: Column, url: Column) -> Column:
    """Address of the call that logs a click and goes on to ``url``; what a query may hold stays as it is."""
    text = F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    for code, sign in OPEN:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.concat(F.lit("/click?i="), impression, F.lit("&p="), position.cast("string"), F.lit("&u="), text)


def result_items(shown: DataFrame, impression: str | None = None, explain: bool = False) -> DataFrame:
    """``rank, item``: each result as JSON with its click address (if there is an impression), time in ISO 8601, and with ``explain`` its features, terms and shard."""
    fields = ["rank", "url", *([click_url(F.lit(impression), F.col("rank"), F.col("url")).alias("clickURL")] if impression else []), "title", "description", "snippet", "score"]
    fields.append(F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changedAt"))
    if explain:
        named = F.struct(*[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)])
        fields.append(F.struct(named.alias("features"), F.col("terms").alias("matchedTerms"), F.col("shard").alias("shardID")).alias("explain"))
    return shown.select("rank", F.to_json(F.struct(*fields)).alias("item"))


__all__ = ["FIELDS", "bm25", "candidates", "diversified", "document_columns", "features", "idf", "click_url", "linear_score", "matched", "result_items", "search", "total", "variants", "weighted_tf"]
