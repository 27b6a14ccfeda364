"""One batch of fetch results taken into the stored tables: pages saved, touched or marked gone, links replaced, entries queued again.

``fetches`` has a row for each answered (or failed) request: ``url`` (normalised), ``depth, retries``, ``status`` (null if the fetch failed), ``html``
(the answer is HTML), ``allowed`` (by robots.txt), ``location`` (target of a redirect), ``canonical``, ``noindex``, ``nofollow``, ``title, description,
content, language, etag, last_modified``, ``content_hash``, ``simhash``, ``headings`` (array), ``links`` (array of url, text, nofollow) and ``original`` (URL of the page
that this one repeats, see ``crawl.page_duplicates``). One URL has one row. The stored tables have the columns of ``schema.SCHEMAS``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.hashing import url_hash
from larkspur.functions.urls import origin, url_host
from larkspur.operators.crawl import in_scope, next_interval
from larkspur.schema import DEFAULTS, Settings
from larkspur.sources.web import is_redirect

GONE = ["gone", "redirect", "canonical", "blocked"]


def jittered(seconds: Column, hash_: Column) -> Column:
    """The interval moved by up to a tenth either way, by a hash instead of chance, so that a batch that runs again gives the same."""
    return seconds * (0.9 + 0.2 * F.pmod(hash_, F.lit(1 << 20)) / float(1 << 20))


def _later(now: datetime, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + F.round(seconds * 1e6).cast("long"))


def lookup(urls: DataFrame, pages: DataFrame, name: str = "old") -> DataFrame:
    """``urls`` with the stored page of the same hash and URL as a struct, null if there is none; repeated rows of a page count once."""
    rows = pages.where("url IS NOT NULL").dropDuplicates(["url"]).select(F.col("url").alias("_url"), F.struct(*pages.columns).alias(name))
    keyed = rows.withColumn("_hash", url_hash("_url"))
    return urls.withColumn("url_hash", url_hash("url")).join(keyed, (F.col("url_hash") == F.col("_hash")) & (F.col("url") == F.col("_url")), "left").drop("_hash", "_url")


def full_hosts(hosts: DataFrame, most: int) -> DataFrame:
    """``origin`` of hosts that have their number of pages."""
    return hosts.where(F.col("page_count") >= most).select("origin").distinct()


def decided(fetches: DataFrame, pages: DataFrame, hosts: DataFrame, settings: Settings = DEFAULTS, allow: list[str] | None = None, block: list[str] | None = None) -> DataFrame:
    """The fetches with ``old`` (the stored page) and ``action``: what is to be done with each.

    blocked (by robots.txt), full (a new page of a host that has enough), retry, keep (no retries left), drop (the same without a page),
    touch (304), skip (304 without a page), redirect, gone, canonical (another URL in scope stands for it) or save.
    """
    rows = lookup(fetches, pages)
    full = full_hosts(hosts, settings.max_pages_per_host).select(F.col("origin").alias("_full"))
    rows = rows.join(full, origin(F.col("url")) == F.col("_full"), "left")
    s, known = F.col("status"), F.col("old").isNotNull()
    elsewhere = F.coalesce((F.col("canonical") != F.col("url")) & in_scope(F.col("canonical"), F.col("depth"), allow, block, settings), F.lit(False))
    action = (
        F.when(~F.coalesce("allowed", F.lit(True)), "blocked").when(~known & F.col("_full").isNotNull(), "full")
        .when(s.isNull() | (s == 429) | (s >= 500), F.when(F.col("retries") < settings.max_retries, "retry").when(known, "keep").otherwise("drop"))
        .when(s.between(200, 299), F.when(~F.coalesce("html", F.lit(False)), "gone").when(elsewhere, "canonical").otherwise("save"))
        .when(s == 304, F.when(known, "touch").otherwise("skip")).when(is_redirect(s), "redirect").otherwise("gone")
    )
    return rows.withColumn("action", action).drop("_full")


def _fetched(changed: Column, now: datetime, settings: Settings) -> dict[str, Column]:
    """What a fetch changes in a stored page, seen as ``old`` (null for a new one)."""
    count = F.coalesce("old.fetch_count", F.lit(0))
    interval = F.when(F.col("old").isNull(), F.lit(settings.initial_interval)).otherwise(next_interval(F.col("old.revisit_interval"), changed & (count > 0), settings))
    return {
        "fetched_at": F.lit(now).cast("timestamp"), "fetch_count": (count + 1).cast("int"), "changed_at": F.when(changed, F.lit(now).cast("timestamp")).otherwise(F.col("old.changed_at")),
        "change_count": (F.coalesce("old.change_count", F.lit(0)) + changed.cast("int")).cast("int"), "revisit_interval": interval,
        "next_crawl_at": _later(now, jittered(interval, F.col("url_hash"))), "updated_at": F.lit(now).cast("timestamp"),
    }


def saved(rows: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """Page rows of the fetches to save: stored ones keep their id and the smaller depth; ``changed`` tells whether the content is another.

    noindex pages are never duplicates nor originals; a page with an ``original`` is a duplicate of it, all others are ok.
    """
    r = rows.where("action = 'save'")
    changed = F.col("old").isNull() | ~F.col("old.content_hash").eqNullSafe(F.col("content_hash"))
    status = F.when(F.coalesce("noindex", F.lit(False)), "noindex").when(F.col("original").isNotNull(), "duplicate").otherwise("ok")
    return r.select(
        F.coalesce("old.id", F.sha2("url", 256)).alias("id"), "url", "url_hash", F.coalesce("old.host", url_host(F.col("url"))).alias("host"), status.alias("status"), "title", "description",
        F.array_join("headings", "\n").alias("headings"), "content", "language", "content_hash", "simhash", F.when(status == "duplicate", F.col("original")).alias("duplicate_of"), "etag", "last_modified",
        F.least(F.coalesce("old.depth", "depth"), "depth").alias("depth"), *[c.alias(n) for n, c in _fetched(changed, now, settings).items()], changed.alias("changed"), F.col("old").isNull().alias("is_new"),
    )


def touched(rows: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """Stored pages that have not changed (304), with the times of the next visit."""
    new = _fetched(F.lit(False), now, settings)
    return rows.where("action = 'touch'").select("old.id", "url", *[c.alias(n) for n, c in new.items()])


def gone(rows: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """Stored pages that are gone: ``changed_at`` is now when they first are; they are looked at again after the longest interval."""
    at = F.lit(now).cast("timestamp")
    return rows.where(F.col("action").isin(GONE) & F.col("old").isNotNull()).select(
        "old.id", "url", F.lit("gone").alias("status"), F.when(F.col("old.status") == "gone", F.col("old.changed_at")).otherwise(at).alias("changed_at"), _later(now, F.lit(settings.max_interval)).alias("next_crawl_at"),
        (F.col("old.status") != "gone").alias("first"),
    )


def kept(rows: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """Stored pages that could not be fetched and have no retries left: they stay, to be tried again after the shortest interval."""
    return rows.where("action = 'keep'").select("old.id", "url", _later(now, F.lit(settings.min_interval)).alias("next_crawl_at"))


def retried(rows: DataFrame) -> DataFrame:
    """Queue entries of failed fetches with one retry more; they are queued again by force."""
    return rows.where("action = 'retry'").select(origin(F.col("url")).alias("origin"), "url", "depth", (F.col("retries") + 1).alias("retries"), F.lit(True).alias("force"))


def followed(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows with ``links`` cut to those that are followed: none of a nofollow page, no nofollow links, the first ``links_per_page`` of the page."""
    some = F.slice(F.filter("links", lambda x: ~F.coalesce(x["nofollow"], F.lit(False))), 1, settings.links_per_page)
    return rows.withColumn("links", F.when(F.coalesce("nofollow", F.lit(False)), F.array().cast(rows.schema["links"].dataType)).otherwise(some))


def replaced_links(links: DataFrame, rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The link table afterwards: links of saved and gone pages are removed, those of saved pages written anew, without links to the page itself."""
    mine = rows.where((F.col("action") == "save") | (F.col("action").isin(GONE) & F.col("old").isNotNull())).select(F.col("url").alias("source_url"))
    old = links.join(mine, "source_url", "left_anti").select("source_url", "source_host", "target_url", "target_host", "anchor_text")
    new = followed(rows.where("action = 'save'"), settings).select(F.col("url").alias("source_url"), F.inline("links")).where("url <> source_url")
    return old.unionByName(new.select(
        "source_url", url_host(F.col("source_url")).alias("source_host"), F.col("url").alias("target_url"), url_host(F.col("url")).alias("target_host"), F.substring("text", 1, settings.anchor_chars).alias("anchor_text"),
    ))


def queued(rows: DataFrame, settings: Settings = DEFAULTS, allow: list[str] | None = None, block: list[str] | None = None) -> DataFrame:
    """``origin, url, depth`` that follow from the fetches: links one deeper, redirect targets and canonical URLs as deep, all within scope."""
    linked = followed(rows.where("action IN ('save', 'canonical')"), settings).select(F.explode("links.url").alias("url"), (F.col("depth") + 1).alias("depth"))
    target = rows.where("action = 'redirect'").select(F.col("location").alias("url"), "depth")
    other = rows.where("action = 'canonical'").select(F.col("canonical").alias("url"), "depth")
    every = linked.unionByName(target).unionByName(other).where(in_scope(F.col("url"), F.col("depth"), allow, block, settings))
    return every.groupBy("url").agg(F.min("depth").alias("depth")).select(origin(F.col("url")).alias("origin"), "url", "depth")


def counters(rows: DataFrame, pages: DataFrame, entries: DataFrame, sitemaps: int = 0) -> DataFrame:
    """``event, n`` of the ten kinds of crawl events: enqueued, fetched, notModified, indexed, duplicate, skipped, gone, error, retried, sitemap.

    ``pages`` are the saved rows and ``entries`` the accepted queue entries of the batch.
    """
    a, status = F.col("action"), F.col("status")
    asked = ~a.isin("blocked", "full") & status.isNotNull()
    html = F.coalesce("html", F.lit(False))
    skipped = a.isin("blocked", "full", "redirect", "canonical", "skip") | ((a == "gone") & status.between(200, 299) & ~html)
    one = rows.agg(
        F.count_if(asked).alias("fetched"), F.count_if(a == "touch").alias("notModified"), F.count_if(skipped).alias("skipped"), F.count_if((a == "gone") & ~status.between(200, 299)).alias("gone"),
        F.count_if(a.isin("retry", "keep", "drop")).alias("error"), F.count_if(a == "retry").alias("retried"),
    )
    two = pages.agg(F.count_if(F.col("status") == "ok").alias("indexed"), F.count_if(F.col("status") == "duplicate").alias("duplicate"))
    three = entries.agg(F.count(F.lit(1)).alias("enqueued"))
    kinds = ["enqueued", "fetched", "notModified", "indexed", "duplicate", "skipped", "gone", "error", "retried"]
    flat = one.join(two, how="cross").join(three, how="cross").withColumn("sitemap", F.lit(sitemaps).cast("long"))  # one row each
    return flat.select(F.inline(F.array(*[F.struct(F.lit(k).alias("event"), F.col(k).alias("n")) for k in [*kinds, "sitemap"]])))


def pause(crawl_delay: Column, action: Column, status: Column, settings: Settings = DEFAULTS) -> Column:
    """Seconds until the next request to the host of a fetch: four times the delay after a failed fetch, eight times after a busy or broken answer."""
    from larkspur.operators.crawl import politeness

    factor = F.when(action.isin("retry", "keep", "drop"), F.when(status.isNull(), F.lit(4.0)).otherwise(F.lit(8.0))).otherwise(F.lit(1.0))
    return politeness(crawl_delay, factor, settings)


def counted_hosts(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """Hosts with ``page_count`` raised by their new pages (``is_new`` of the saved rows)."""
    new = pages.where("is_new").groupBy(origin(F.col("url")).alias("_origin")).agg(F.count(F.lit(1)).alias("_new"))
    joined = hosts.join(new, hosts["origin"] == new["_origin"], "left")
    return joined.withColumn("page_count", (F.col("page_count") + F.coalesce("_new", F.lit(0))).cast("int")).drop("_origin", "_new")
