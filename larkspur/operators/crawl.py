"""Crawl state as batch dataflows: scope, dispatch, duplicates, versions, revisits, purge and the frontier."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.hashing import blocks, hamming
from larkspur.functions.urls import host_within, is_non_html, looks_like_trap, normalize_url, origin, url_host
from larkspur.operators.ranking import ranked
from larkspur.schema import DEFAULTS, Settings
from larkspur.session import checkpointed, written


def in_scope(url: Column, depth: Column, allow: list[str] | None = None, block: list[str] | None = None, settings: Settings = DEFAULTS) -> Column:
    """Whether a normalised URL may be crawled: depth, length, no file ending, no trap, not blocked, and within ``allow`` if given."""
    host = url_host(url)
    any_of = lambda domains: F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: host_within(host, d)) if domains else F.lit(False)
    ok = url.isNotNull() & (depth <= settings.max_depth) & (F.octet_length(url) <= settings.max_url_bytes) & ~is_non_html(url) & ~looks_like_trap(url) & ~any_of(block)
    return F.coalesce(ok & any_of(allow) if allow is not None else ok, F.lit(False))


def politeness(crawl_delay: Column, back_off: Column, settings: Settings = DEFAULTS) -> Column:
    """Seconds until the next request to a host: the longer of its and our delay, times the back-off factor, at most ``max_delay``."""
    own = F.least(F.greatest(F.lit(settings.min_delay), F.coalesce(crawl_delay, F.lit(0.0))), F.lit(settings.max_delay))
    return F.least(own * back_off, F.lit(settings.max_delay))


def priority(kind: Column, depth: Column, retries: Column) -> Column:
    """Sitemaps first, then by depth and two for each retry."""
    return F.when(kind == "sitemap", F.lit(-1)).otherwise(depth + 2 * retries)


def next_interval(previous: Column, changed: Column, settings: Settings = DEFAULTS) -> Column:
    """Seconds to the next visit: half after a change, half as much again without, within bounds; new pages get the first interval."""
    new = F.when(changed, previous / 2).otherwise(previous * 1.5)
    plain = F.when(previous.isNull() | F.isnan(previous) | (previous <= 0), F.lit(settings.initial_interval)).otherwise(new)
    return F.least(F.greatest(plain, F.lit(settings.min_interval)), F.lit(settings.max_interval))


def due(pages: DataFrame, now: datetime, limit: int = 5000) -> DataFrame:
    """``id, url, next_crawl_at`` of pages whose time has come, the longest waiting first."""
    rows = pages.where(F.col("next_crawl_at") <= F.lit(now)).select("id", "url", "next_crawl_at").dropDuplicates(["id"])
    return rows.orderBy("next_crawl_at", "id").limit(limit)


def pushed(interval: Column, now: datetime, settings: Settings = DEFAULTS) -> Column:
    """When a page that was queued is due again unless its fetch says otherwise: its interval later, so that it is not queued twice."""
    seconds = F.when(interval.isNull() | F.isnan(interval) | (interval <= 0), F.lit(settings.initial_interval)).otherwise(interval)
    return F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + F.round(seconds * 1e6).cast("long"))


def scope_hosts(seeds: DataFrame, configured: list[str]) -> DataFrame:
    """``domain``: the hosts of the enabled seeds and the configured ones. Read anew for each batch, so that a new seed counts from the next on."""
    mine = seeds.where("enabled").select(url_host(normalize_url(F.col("url"))).alias("domain")).where("domain IS NOT NULL")
    return mine.unionByName(seeds.sparkSession.createDataFrame([(d,) for d in configured], "domain string")).distinct()


def within_hosts(rows: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is one of the domains or a subdomain: a host is split into its suffixes, which meet the domains in an equi-join, however many there are."""
    hosts = rows.select(F.col(host).alias("_host")).where("_host IS NOT NULL").distinct().withColumn("_parts", F.split("_host", "[.]"))
    inside = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "."))).alias("domain"))
    ok = inside.join(domains, "domain", "left_semi").select("_host").distinct()
    return rows.join(ok, rows[host] == ok["_host"], "left_semi")


def active(beats: DataFrame, worker: str, at: str, timeout: float = 30.0, now: datetime | None = None) -> DataFrame:
    """``worker, seen``: workers whose last sign of life is less than ``timeout`` seconds old at ``now``, by default the time of the last of all."""
    last = beats.where(F.col(worker).isNotNull()).groupBy(F.col(worker).alias("worker")).agg(F.max(at).alias("seen"))
    end = beats.agg(F.max(at).alias("_end")) if now is None else beats.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("_end"))
    return last.join(end, how="cross").where(F.unix_micros("seen") > F.unix_micros("_end") - int(timeout * 1e6)).select("worker", "seen")  # one row of end


def purged(pages: DataFrame, links: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Pages that were gone for longer than ``purge_after``, and the links that go with them."""
    limit = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - int(settings.purge_after * 1e6))
    dead = pages.where((F.col("status") == "gone") & (F.col("changed_at") < limit)).select("id", "url").dropDuplicates(["id"])
    return dead, links.join(dead.select(F.col("url").alias("source_url")), "source_url", "left_semi")


def latest_versions(changes: DataFrame, key: str, version: Column, order: Column) -> DataFrame:
    """The row of each key with the highest version, of equal ones the latest in ``order``. Partial maxima before the shuffle, so hot keys don't hurt."""
    best = F.max_by(F.struct(*changes.columns), F.struct(version, order)).alias("row")
    return changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(best).select("row.*")


def refreshed(index: DataFrame, changes: DataFrame, key: str, live: Column) -> DataFrame:
    """The index after a batch: rows of changed keys are replaced, those no longer live are removed. ``changes`` has one row a key."""
    kept = index.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(live).select(*index.columns))


def status_rows(pages: DataFrame, hosts: DataFrame, links: DataFrame, now: datetime) -> DataFrame:
    """``name, n``: pages by status, pages due, hosts and links. Repeated rows count once."""
    p = pages.select("id", "status", "next_crawl_at").dropDuplicates(["id"])
    rows = p.groupBy(F.concat(F.lit("pages_"), F.coalesce("status", F.lit("null"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return rows.unionByName(one(p.where(F.col("next_crawl_at") <= F.lit(now)), "due")).unionByName(one(hosts.select("id").distinct(), "hosts")).unionByName(one(links.select("id").distinct(), "links"))


def exact_duplicates(pages: DataFrame) -> DataFrame:
    """``id, original``: pages whose ``content_hash`` an earlier page (by fetch time, then id) has; ``original`` is the first of them."""
    rows = pages.where("content_hash IS NOT NULL").select("id", "content_hash", "fetched_at").dropDuplicates(["id"])
    first = rows.groupBy("content_hash").agg(F.min_by("id", F.struct(F.coalesce("fetched_at", F.lit("9999-12-31").cast("timestamp")).alias("at"), "id")).alias("original"))
    return rows.join(first, "content_hash").where("id <> original").select("id", "original")


def _near(pages: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Distinct SimHashes ``simhash, at`` and their pairs ``x, xt, y`` within ``distance`` bits, ``x`` the earlier."""
    far = F.lit("9999-12-31").cast("timestamp")
    hashes = checkpointed(pages.where("simhash IS NOT NULL").groupBy("simhash").agg(F.min(F.coalesce("fetched_at", far)).alias("at")))
    keyed = hashes.select("simhash", "at", F.inline(blocks(F.col("simhash"), distance)))
    # hardly any key has two hashes: a hash aggregate finds those that have, and only theirs are joined
    shared = keyed.groupBy("block", "bits").agg(F.min("simhash").alias("lo"), F.max("simhash").alias("hi")).where("lo <> hi").select("block", "bits")
    keyed = written(keyed.join(written(shared, "shared"), ["block", "bits"], "left_semi"), "keyed")
    a, b = keyed.select("block", "bits", F.col("simhash").alias("x"), F.col("at").alias("xt")), keyed.select("block", "bits", F.col("simhash").alias("y"), F.col("at").alias("yt"))
    near = a.join(b, ["block", "bits"]).where((F.struct("xt", "x") < F.struct("yt", "y")) & (hamming(F.col("x"), F.col("y")) <= distance))
    return hashes, checkpointed(near.select("x", "xt", "y").distinct())


def near_duplicates(pages: DataFrame, distance: int = 3) -> DataFrame:
    """``simhash, original, bits``: SimHashes within ``distance`` bits of an earlier original one; ``original`` is its leader.

    Works on distinct SimHashes, as pages that share one are one case; no pair is missed (see ``blocks``). An
    earlier hash (by first fetch, then value) leads a later one; a hash is an original once all its earlier neighbours are known to be duplicates, and a
    duplicate once one of them is an original. Of several leaders the earliest counts. ``pages`` has ``simhash`` and ``fetched_at``.
    """
    return _led(*_near(pages, distance))


def _led(hashes: DataFrame, near: DataFrame) -> DataFrame:
    """The duplicates among ``hashes``; each round solves at least the earliest open one, so that it ends."""
    state = checkpointed(hashes.join(near.select(F.col("y").alias("simhash")), "simhash", "left_anti").select("simhash", F.lit(True).alias("original")))
    open_ = checkpointed(near.select(F.col("y").alias("simhash")).distinct())
    while open_.limit(1).count():
        known = near.join(open_, near["y"] == open_["simhash"], "left_semi").join(state.withColumnRenamed("simhash", "x"), "x", "left")
        verdict = known.groupBy(F.col("y").alias("simhash")).agg(F.max("original").alias("led"), F.count_if(F.col("original").isNull()).alias("unknown"))
        solved = checkpointed(verdict.where("led OR unknown = 0").select("simhash", (~F.coalesce("led", F.lit(False))).alias("original")))
        state = checkpointed(state.unionByName(solved))
        open_ = checkpointed(open_.join(solved, "simhash", "left_anti"))
    leaders = near.join(state.where("original").select(F.col("simhash").alias("x")), "x")
    dup = state.where("NOT original").select(F.col("simhash").alias("y"))
    return leaders.join(dup, "y").groupBy(F.col("y").alias("simhash")).agg(F.min_by("x", F.struct("xt", "x")).alias("original")).withColumn("bits", hamming(F.col("simhash"), F.col("original")))


def near_duplicate_pages(pages: DataFrame, ident: str, distance: int = 3) -> DataFrame:
    """``ident, simhash, leader, bits, links`` of every page with a SimHash: the class it is in and how it hangs on it.

    ``leader`` is the first page (by fetch, then ``ident``) of the leading SimHash, for originals of their own; ``bits`` lie between the page and it, 0
    for the leader and its copies; ``links`` counts the other pages within ``distance`` bits, copies included. Rows of one ``ident`` count once.
    """
    rows = checkpointed(pages.where(F.col("simhash").isNotNull() & F.col(ident).isNotNull()).select(ident, "simhash", "fetched_at").dropDuplicates([ident]))
    hashes, near = _near(rows, distance)
    far = F.lit("9999-12-31").cast("timestamp")
    first = rows.groupBy("simhash").agg(F.min_by(ident, F.struct(F.coalesce("fetched_at", far), F.col(ident))).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = checkpointed(first)
    both = near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(near.select(F.col("y").alias("a"), F.col("x").alias("b")))
    around = both.join(first.select(F.col("simhash").alias("b"), "copies"), "b").groupBy(F.col("a").alias("simhash")).agg(F.sum("copies").alias("around"))
    led = _led(hashes, near).select("simhash", "original")
    classes = first.join(led, "simhash", "left").join(around, "simhash", "left").select(
        "simhash", F.coalesce("original", "simhash").alias("original"), (F.col("copies") - 1 + F.coalesce("around", F.lit(0))).alias("links")
    )
    leaders = first.select(F.col("simhash").alias("original"), F.col("first").alias("leader"))
    classes = classes.join(leaders, "original").select("simhash", "leader", hamming(F.col("simhash"), F.col("original")).alias("bits"), "links")
    return rows.select(ident, "simhash").join(classes, "simhash").select(ident, "simhash", "leader", "bits", "links")


def duplicate_member(simhash: Column, url: Column) -> Column:
    """SimHash (16 hexadecimal digits) and URL as one text."""
    return F.concat(F.lpad(F.lower(F.hex(simhash)), 16, "0"), F.lit("|"), url)


def parsed_member(member: Column) -> tuple[Column, Column]:
    """SimHash and URL of such a text; nulls if it is none."""
    ok = member.rlike("^[0-9a-f]{16}[|]")
    half = lambda at: F.conv(F.substring(member, at, 8), 16, 10).cast("long")
    return F.when(ok, F.shiftleft(half(1), 32).bitwiseOR(half(9))), F.when(ok, F.substr(member, F.lit(18)))


def frontier_new(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, seq, origin, depth, retries, kind``: the first arrival of each web URL that no page has, URLs normalised."""
    rows = frontier.select(normalize_url(F.col("url")).alias("url"), "seq", "depth", "retries", "kind").where("url IS NOT NULL AND seq IS NOT NULL")
    first = rows.groupBy("url").agg(F.min(F.struct("seq", "depth", "retries", "kind")).alias("f")).select("url", "f.*")
    known = pages.select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    return first.join(known, "url", "left_anti").withColumn("origin", origin(F.col("url")))


def frontier_picks(frontier: DataFrame, now: datetime) -> DataFrame:
    """``origin, url, seq, priority``: of each origin that may be asked at ``now``, the entry that comes first.

    Lowest priority, then arrival. A null ``next_allowed_at`` may be asked at once; an origin whose latest time lies ahead may not. One aggregate with
    partial minima: an origin with a third of the queue is no heavier than another.
    """
    rows = frontier.where("origin IS NOT NULL AND url IS NOT NULL").select("origin", "url", "seq", "next_allowed_at", priority(F.col("kind"), F.col("depth"), F.col("retries")).alias("priority"))
    best = rows.groupBy("origin").agg(F.min(F.struct("priority", "seq", "url")).alias("b"), F.max("next_allowed_at").alias("at"))
    return best.where(F.col("at").isNull() | (F.col("at") <= F.lit(now))).select("origin", "b.url", "b.seq", "b.priority")


def frontier_stats(frontier: DataFrame, now: datetime) -> DataFrame:
    """One row: origins, origins ready at ``now``, and queued entries (exact repeats once)."""
    rows = frontier.where("origin IS NOT NULL").distinct().groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.max("next_allowed_at").alias("at"))
    return rows.agg(F.count(F.lit(1)).alias("origins"), F.count_if(F.col("at").isNull() | (F.col("at") <= F.lit(now))).alias("ready"), F.coalesce(F.sum("n"), F.lit(0)).alias("queued"))


def first_per_key(df: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key, whatever the key's size."""
    return ranked(df, [key], order, "_nth").where(F.col("_nth") <= cap).drop("_nth")


def neighbours(links: DataFrame, side: str, cap: int = 200) -> DataFrame:
    """Up to ``cap`` links for each page: ``url`` and the link's columns; ``side`` is source_url (outgoing) or target_url (incoming)."""
    w = Window.partitionBy(side).orderBy("id")  # limited to cap rows within each task before the shuffle
    rows = links.where(F.col(side).isNotNull()).select("id", "source_url", "target_url", "anchor_text").dropDuplicates(["id"])
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= cap).drop("_nth")
