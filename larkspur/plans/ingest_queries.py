"""Queries over one batch of fetches, the frontier's steps, the scheduler and the segmented index.

The saved page states stand for fetches: what was delivered up to ``CUT`` is the stored table, the newest later state of each page its fetch. A state with the
content of the stored one is an answer 304, a state ``gone`` one of 404, 503, 301 or a failed request, by its sequence number.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.hashing import buckets_of
from larkspur.functions.urls import host_key, normalize_url, origin, url_host
from larkspur.operators import crawl, frontier, ingest
from larkspur.operators.segments import SegmentedIndex
from larkspur.plans import duck
from larkspur.plans.crawl_queries import _CHANGES, _PRIORITY, NOW, NOW_SQL
from larkspur.session import checkpointed, scratch_path, table

CUT, CUT_SQL = datetime(2026, 3, 15, tzinfo=timezone.utc), "TIMESTAMPTZ '2026-03-15 00:00:00+00'"
CLAIM, CLAIM_SQL = datetime(2026, 4, 1, 0, 5, tzinfo=timezone.utc), "TIMESTAMPTZ '2026-04-01 00:05:00+00'"
CAPACITY, CLAIMS = 40, 500
PAGE = "title string, description string, headings array<string>, content string, language string, etag string, last_modified string, simhash bigint, canonical string"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "page_changes").select("id", "url", "host", "change_seq", "status", "version_hash", "fetch_count", "delivered_at", F.coalesce("updated_at", "delivered_at").alias("at"))
    latest = lambda part: crawl.latest_versions(rows.where(part), "id", F.col("at"), F.col("change_seq"))
    return latest(F.col("delivered_at") <= F.lit(CUT)), latest(F.col("delivered_at") > F.lit(CUT))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetches, decided."""
    old, new = _states(spark, sf_dir)
    more = table(spark, sf_dir, "pages").select("id", "depth", "revisit_interval", "duplicate_of").where("id IS NOT NULL").dropDuplicates(["id"])
    pages = old.join(more, "id").select(
        "id", "url", "host", "status", F.col("version_hash").alias("content_hash"), "depth", "revisit_interval", "fetch_count", F.lit(1).alias("change_count"), F.col("at").alias("changed_at")
    )
    before = old.select(F.col("url").alias("_url"), F.col("version_hash").alias("_hash"))
    rows = new.join(more, "id").join(before, F.col("url") == F.col("_url"), "left")
    seq = F.pmod("change_seq", F.lit(4))
    code = (
        F.when(F.col("status") == "gone", F.when(seq == 0, F.lit(None)).when(seq == 1, 503).when(seq == 2, 301).otherwise(404))
        .when((F.col("status") == "ok") & (F.col("version_hash") == F.col("_hash")), 304).otherwise(200)
    )
    fetches = rows.select(
        "url", (F.col("depth") + F.pmod("change_seq", F.lit(3)) - 1).cast("int").alias("depth"), F.pmod("change_seq", F.lit(5)).cast("int").alias("retries"), code.cast("int").alias("status"),
        F.lit(True).alias("html"), F.lit(True).alias("allowed"), F.concat(origin(F.col("url")), F.lit("/moved/"), F.col("version_hash")).alias("location"),
        (F.col("status") == "noindex").alias("noindex"), F.lit(False).alias("nofollow"), F.col("version_hash").alias("content_hash"),
        F.when(F.col("status") == "duplicate", F.coalesce("duplicate_of", F.lit("unknown"))).alias("original"), *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PAGE.split(", ")],
    )
    hosts = table(spark, sf_dir, "hosts").select("origin", "page_count")
    return ingest.decided(fetches, pages, hosts, settings=crawl.Settings(max_pages_per_host=60))


def fetch_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with each fetch, and when its host may be asked again if its robots.txt sets no delay."""
    rows = _batch(spark, sf_dir)
    return rows.select("url", "action", ingest.pause(F.lit(None).cast("double"), F.col("action"), F.col("status")).alias("pause"))


def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page rows that the batch saves."""
    rows = ingest.saved(_batch(spark, sf_dir), NOW)
    return rows.select("url", "status", "depth", "duplicate_of", "fetch_count", "change_count", "changed", "is_new", F.round("revisit_interval", 6).alias("revisit_interval"), F.unix_micros("next_crawl_at").alias("next_us"))


def page_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that answered 304."""
    return ingest.touched(_batch(spark, sf_dir), NOW).select("id", "fetch_count", "change_count", F.round("revisit_interval", 6).alias("revisit_interval"), F.unix_micros("next_crawl_at").alias("next_us"))


def page_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the batch marks gone."""
    return ingest.gone(_batch(spark, sf_dir), NOW).select("id", "status", F.unix_micros("changed_at").alias("changed_us"), F.unix_micros("next_crawl_at").alias("next_us"), "first")


def retry_or_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed fetches: queued again with one retry more, or kept for the shortest interval once they have had three."""
    rows = _batch(spark, sf_dir)
    again = ingest.retried(rows).select("url", F.col("retries").cast("long").alias("retries"), F.lit(None).cast("long").alias("next_us"))
    return again.unionByName(ingest.kept(rows, NOW).select("url", F.lit(None).cast("long").alias("retries"), F.unix_micros("next_crawl_at").alias("next_us")))


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links = table(spark, sf_dir, "links").where("id IS NOT NULL").dropDuplicates(["id"])
    mine = links.where("source_url IS NOT NULL").groupBy(F.col("source_url").alias("_source")).agg(F.array_sort(F.collect_list(F.struct("id", F.col("target_url").alias("url"), F.col("anchor_text").alias("text")))).alias("found"))
    rows = _batch(spark, sf_dir)
    found = F.transform(F.coalesce("found", F.array().cast(mine.schema["found"].dataType)), lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), F.lit(False).alias("nofollow")))
    return links, rows.join(mine, rows["url"] == mine["_source"], "left").withColumn("links", found).drop("_source", "found")


def link_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link table after the batch; the stored links of a page stand for those found on it (here at most 3 are followed)."""
    links, rows = _linked(spark, sf_dir)
    return ingest.replaced_links(links, rows, crawl.Settings(links_per_page=3, anchor_chars=20))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to be queued after the batch."""
    return ingest.queued(_linked(spark, sf_dir)[1]).select("origin", "url", F.col("depth").cast("long").alias("depth"))


def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch by kind of event; addresses that are pages already are not queued."""
    rows = checkpointed(_linked(spark, sf_dir)[1])
    known = table(spark, sf_dir, "page_changes").select("url").distinct()
    return ingest.counters(rows, ingest.saved(rows, NOW), ingest.queued(rows).join(known, "url", "left_anti"))


def host_counts_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page counts of the hosts after the batch."""
    hosts = table(spark, sf_dir, "hosts").select("id", "origin", "page_count").distinct()
    return ingest.counted_hosts(hosts, ingest.saved(_batch(spark, sf_dir), NOW)).select("id", F.col("page_count").cast("long").alias("page_count"))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored page, if any, of every link target, by hash and URL."""
    urls = table(spark, sf_dir, "links").select(F.col("target_url").alias("url")).where("url IS NOT NULL").distinct()
    pages = table(spark, sf_dir, "pages").select("id", "url", "etag")
    return ingest.lookup(urls, pages).select("url", "old.id", "old.etag")


def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that the second of three shards reads: its buckets are a filter of the scan."""
    rows = table(spark, sf_dir, "pages").where(F.col("shard_bucket").isin(buckets_of(1, 3)) & (F.col("status") == "ok"))
    return rows.select("id", F.col("shard_bucket").cast("long").alias("bucket")).distinct()


def segment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live pages and segments of an index that took up each page's states in eleven parts by their sequence: after the ninth there was one segment."""
    rows = table(spark, sf_dir, "page_changes").where("id IS NOT NULL").select("id", "status", "version_hash", "change_seq")
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), "id string, version_hash string, change_seq long")
    parts = checkpointed(crawl.latest_versions(rows.withColumn("part", F.pmod("change_seq", F.lit(11))), "id", F.col("change_seq"), F.col("change_seq")))
    for n in range(11):
        mine = parts.where(F.col("part") == n)
        index.apply(mine.where("status = 'ok'").select("id", "version_hash", "change_seq"), mine.where("status <> 'ok'").select("id"))
    return index.status().select("documents", F.col("segments").cast("long").alias("segments"))


# the frontier


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    empty = spark.createDataFrame([], "origin string, url string, depth int, retries int, kind string, seq long")
    seen = table(spark, sf_dir, "pages").select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    ready = spark.createDataFrame([], "origin string, ready_at timestamp")
    rows = table(spark, sf_dir, "frontier").select(normalize_url(F.col("url")).alias("url"), "depth", "retries", "kind", "seq").distinct()
    return empty, seen, ready, rows.select(origin(F.col("url")).alias("origin"), "url", "depth", "retries", "kind", "seq", (F.col("retries") > 0).alias("force"))


def frontier_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the queues take up of the whole frontier, with room for 40 entries each; entries that are retries are forced."""
    queue, seen, _, entries = _tables(spark, sf_dir)
    return frontier.accepted(queue, seen, entries, CAPACITY).select("origin", "url", "seq")


def _claimed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queue and ready times when every origin has the time of its last entry, and the first claims."""
    queue, seen, ready, entries = _tables(spark, sf_dir)
    queue, _, ready = frontier.enqueue(queue, seen, ready, entries, CAPACITY)
    queue = checkpointed(queue)
    times = table(spark, sf_dir, "frontier").select(origin(normalize_url(F.col("url"))).alias("origin"), F.col("next_allowed_at").alias("at")).groupBy("origin").agg(F.max("at").alias("next_allowed_at"))
    ready = frontier.released(queue, ready, times.where("next_allowed_at IS NOT NULL"))
    ready = checkpointed(ready)
    return queue, ready, checkpointed(frontier.claims(queue, ready, CLAIM, CLAIMS))


def frontier_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 leases at a moment: of the origins that have waited longest."""
    return _claimed(spark, sf_dir)[2].select("origin", "url", "seq", F.unix_micros("lease_until").alias("until_us"))


def frontier_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each origin may be asked again after the leases were handed out and given back; origins with nothing left are dropped."""
    queue, ready, leases = _claimed(spark, sf_dir)
    left, times = frontier.claimed(queue, ready, leases)
    done = leases.select("origin", F.lit(CLAIM + timedelta(seconds=2)).alias("next_allowed_at"))
    return frontier.released(left, times, done).select("origin", F.unix_micros("ready_at").alias("ready_us"))


def frontier_takeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases a minute later if none of the first was given back: their origins are taken over, with the next entry."""
    queue, ready, leases = _claimed(spark, sf_dir)
    left, times = frontier.claimed(queue, ready, leases)
    return frontier.claims(left, times, CLAIM + timedelta(seconds=60)).select("origin", "url", "seq")


def recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue entries for addresses to be fetched at once, at their stored depth or 0; here those of the clicks."""
    urls = table(spark, sf_dir, "search_clicks").select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy("url").agg(F.min("depth").alias("depth"))
    return urls.join(pages, "url", "left").select(origin(F.col("url")).alias("origin"), "url", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.lit(True).alias("force"))


def scheduler_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one tick of the scheduler queues and removes: enabled seeds, pages that are due with their time pushed forward, pages long gone."""
    pages = table(spark, sf_dir, "pages")
    seeds = table(spark, sf_dir, "seeds").where("enabled").select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    due = crawl.due(pages, NOW).join(pages.select("id", "revisit_interval").dropDuplicates(["id"]), "id")
    due = due.where(origin(F.col("url")).isNotNull()).select(F.lit("due").alias("step"), "url", F.unix_micros(crawl.pushed(F.col("revisit_interval"), NOW)).alias("next_us"))
    dead = crawl.purged(pages, table(spark, sf_dir, "links"), NOW)[0]
    null = F.lit(None).cast("long").alias("next_us")
    return seeds.select(F.lit("seed").alias("step"), "url", null).unionByName(due).unionByName(dead.select(F.lit("purge").alias("step"), "url", null))


def seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled seeds in their order."""
    rows = table(spark, sf_dir, "seeds").where("enabled").dropDuplicates(["id"])
    return rows.orderBy("created_at", "id").select("id", "url")


def seed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frontier addresses lie within the hosts of the enabled seeds and one configured domain."""
    allowed = crawl.scope_hosts(table(spark, sf_dir, "seeds"), ["example.org", "www.lantern-harbor.example"])
    rows = table(spark, sf_dir, "frontier").select("seq", normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    return crawl.within_hosts(rows.withColumn("host", url_host(F.col("url"))), "host", allowed).select("seq", "url")


def active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins whose last page was saved within a day of the last of all: hosts stand for the workers that report."""
    beats = table(spark, sf_dir, "page_changes").select(host_key(F.col("host")).alias("worker"), F.col("delivered_at").alias("at"))
    return crawl.active(beats, "worker", "at", 86_400.0).select("worker", F.unix_micros("seen").alias("seen_us"))


# the segmented index


def segment_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live index after page states came in twelve deliveries, each a segment with its tombstones, compacted when there are more than eight."""
    rows = checkpointed(table(spark, sf_dir, "page_changes").where("id IS NOT NULL").select("id", "status", "version_hash", "delivered_at", "change_seq", F.coalesce("updated_at", "delivered_at").alias("at")))
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), "id string, version_hash string, change_seq long")
    before = datetime(2026, 2, 1, tzinfo=timezone.utc)
    for step in range(12):
        until = datetime(2026, 3, 3, tzinfo=timezone.utc) + timedelta(days=3 * step) if step < 11 else datetime(2999, 1, 1, tzinfo=timezone.utc)
        came = rows.where((F.col("delivered_at") > F.lit(before)) & (F.col("delivered_at") <= F.lit(until))).select("id").distinct()
        now = crawl.latest_versions(rows.where(F.col("delivered_at") <= F.lit(until)).join(came, "id", "left_semi"), "id", F.col("at"), F.col("change_seq"))
        now = checkpointed(now)
        index.apply(now.where("status = 'ok'").select("id", "version_hash", "change_seq"), now.where("status <> 'ok'").select("id"), str(until))
        before = until
    return index.live()


def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the states of each shard have been read, and how many changes the next refresh of each would read with two seconds of overlap."""
    from larkspur.functions.hashing import shard, url_hash

    rows = table(spark, sf_dir, "page_changes").select("change_seq", "updated_at", "delivered_at", shard(url_hash("url"), 2).alias("shard"))
    marks = rows.where(F.col("delivered_at") <= F.lit(CUT)).groupBy("shard").agg(F.max("updated_at").alias("mark"))
    since = F.timestamp_micros(F.unix_micros("mark") - 2_000_000)
    later = rows.join(marks, "shard").where(F.col("updated_at") > since)  # one row a shard
    return later.groupBy("shard").agg(F.unix_micros(F.max("mark")).alias("mark_us"), F.count(F.lit(1)).alias("changes"))


QUERIES = {
    f.__name__: f
    for f in (
        fetch_dispatch, page_upsert, page_touch, page_gone, retry_or_keep, link_replace, follow_ups, crawl_counters, host_counts_after, page_lookup, shard_scan, segment_status, frontier_enqueue, frontier_claim, frontier_release,
        frontier_takeover, recrawl, scheduler_tick, seed_list, seed_scope, active_workers, segment_refresh, watermark,
    )
}

_HOUR_US = lambda x: f"CAST(round({x} * 1000000.0::DOUBLE) AS BIGINT)"
_JITTER = f"(0.9::DOUBLE + 0.2::DOUBLE * CAST({duck.mix(duck.fnv('url'))} % 1048576::UHUGEINT AS DOUBLE) / 1048576.0::DOUBLE)"
_NOW_US = f"epoch_us({NOW_SQL})"
_BATCH = f"""
{_CHANGES.replace('SELECT id, change_seq', 'SELECT id, url, host, change_seq')},
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c WHERE delivered_at <= {CUT_SQL}) WHERE n = 1),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c WHERE delivered_at > {CUT_SQL}) WHERE n = 1),
more AS (SELECT id, any_value(depth) AS depth, any_value(revisit_interval) AS revisit_interval, any_value(duplicate_of) AS duplicate_of FROM pages WHERE id IS NOT NULL GROUP BY id),
full_hosts AS (SELECT DISTINCT origin FROM hosts WHERE page_count >= 60),
f AS (
  SELECT w.id, w.url, w.change_seq, w.status AS state, w.version_hash, m.depth AS own_depth, m.depth + w.change_seq % 3 - 1 AS depth, w.change_seq % 5 AS retries, m.revisit_interval, m.duplicate_of,
    o.id IS NOT NULL AND om.id IS NOT NULL AS known, o.id AS old_id, o.version_hash AS old_hash, o.status AS old_status, o.fetch_count AS old_count, o.seen_at AS old_at,
    CASE WHEN w.status = 'gone' THEN CASE w.change_seq % 4 WHEN 0 THEN NULL WHEN 1 THEN 503 WHEN 2 THEN 301 ELSE 404 END WHEN w.status = 'ok' AND w.version_hash = o.version_hash THEN 304 ELSE 200 END AS code,
    regexp_extract(w.url, '^(https?://[^/?#]+)', 1) AS origin
  FROM w JOIN more m USING (id) LEFT JOIN o ON o.url = w.url LEFT JOIN more om ON om.id = o.id
), b AS MATERIALIZED (
  SELECT *, CASE WHEN NOT known AND origin IN (SELECT origin FROM full_hosts) THEN 'full' WHEN code IS NULL OR code = 503 THEN CASE WHEN retries < 3 THEN 'retry' WHEN known THEN 'keep' ELSE 'drop' END
    WHEN code = 200 THEN 'save' WHEN code = 304 THEN CASE WHEN known THEN 'touch' ELSE 'skip' END WHEN code = 301 THEN 'redirect' ELSE 'gone' END AS action FROM f
)"""
_STEP = lambda changed: f"CASE WHEN NOT known THEN 604800.0::DOUBLE WHEN revisit_interval IS NULL OR isnan(revisit_interval) OR revisit_interval <= 0 THEN 604800.0::DOUBLE WHEN {changed} AND old_count > 0 THEN revisit_interval / 2 ELSE revisit_interval * 1.5::DOUBLE END"
_BOUND = lambda changed: f"least(greatest({_STEP(changed)}, 86400.0::DOUBLE), 7776000.0::DOUBLE)"
_CHANGED = "(NOT known OR old_hash IS DISTINCT FROM version_hash)"
_LINKS = """
l AS (SELECT id, any_value(source_url) AS source_url, any_value(source_host) AS source_host, any_value(target_url) AS target_url, any_value(target_host) AS target_host, any_value(anchor_text) AS anchor_text FROM links WHERE id IS NOT NULL GROUP BY id),
nth AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY id) AS n FROM l WHERE source_url IS NOT NULL)"""
_QUEUED = f"""
q0 AS (
  SELECT target_url AS url, b.depth + 1 AS depth FROM nth JOIN b ON b.url = nth.source_url AND action = 'save' WHERE n <= 500
  UNION ALL SELECT b.origin || '/moved/' || version_hash, depth FROM b WHERE action = 'redirect'
), queued AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, url, CAST(min(depth) AS BIGINT) AS depth FROM q0 WHERE {duck.in_scope('url', 'depth')} GROUP BY url)"""
_ACCEPTED = f"""
e AS (SELECT DISTINCT {duck.normalize_url('url')} AS url, depth, retries, kind, seq FROM frontier),
s AS (SELECT DISTINCT {duck.normalize_url('url')} AS url FROM pages),
x AS (SELECT url, arg_min({{'depth': depth, 'retries': retries, 'kind': kind, 'seq': seq}}, seq) AS e FROM e WHERE url IS NOT NULL AND seq IS NOT NULL AND (retries > 0 OR url NOT IN (SELECT url FROM s WHERE url IS NOT NULL)) GROUP BY url),
y AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, url, e.depth AS depth, e.retries AS retries, e.kind AS kind, e.seq AS seq FROM x),
queue AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq, url) AS nth FROM y) WHERE nth <= {CAPACITY}),
times AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, max(next_allowed_at) AS ready_at FROM (SELECT {duck.normalize_url('url')} AS url, next_allowed_at FROM frontier) GROUP BY 1),
ready AS MATERIALIZED (SELECT o.origin, ready_at FROM (SELECT DISTINCT origin FROM queue) o LEFT JOIN times USING (origin)),
best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY {_PRIORITY}, seq, url) AS k, count(*) OVER (PARTITION BY origin) AS waiting FROM queue),
leases AS MATERIALIZED (SELECT origin, url, seq, waiting FROM best JOIN ready USING (origin) WHERE k = 1 AND (ready_at IS NULL OR ready_at <= {CLAIM_SQL}) ORDER BY ready_at NULLS FIRST, origin LIMIT {CLAIMS})"""

ORACLE = {
    "fetch_dispatch": f"WITH {_BATCH} SELECT url, action, CASE WHEN action IN ('retry', 'keep', 'drop') THEN CASE WHEN code IS NULL THEN 4.0::DOUBLE ELSE 8.0::DOUBLE END ELSE 1.0::DOUBLE END AS pause FROM b",
    "page_upsert": f"""
WITH {_BATCH}
SELECT url, CASE state WHEN 'noindex' THEN 'noindex' WHEN 'duplicate' THEN 'duplicate' ELSE 'ok' END AS status, CAST(CASE WHEN known THEN least(own_depth, depth) ELSE depth END AS INTEGER) AS depth,
  CASE WHEN state = 'duplicate' THEN coalesce(duplicate_of, 'unknown') END AS duplicate_of, CAST(CASE WHEN known THEN old_count ELSE 0 END + 1 AS INTEGER) AS fetch_count,
  CAST(CASE WHEN known THEN 1 ELSE 0 END + CASE WHEN {_CHANGED} THEN 1 ELSE 0 END AS INTEGER) AS change_count, {_CHANGED} AS changed, NOT known AS is_new,
  round({_BOUND(_CHANGED)}, 6) AS revisit_interval, {_NOW_US} + {_HOUR_US(_BOUND(_CHANGED) + ' * ' + _JITTER)} AS next_us
FROM b WHERE action = 'save'
""",
    "page_touch": f"WITH {_BATCH} SELECT old_id AS id, CAST(old_count + 1 AS INTEGER) AS fetch_count, 1 AS change_count, round({_BOUND('false')}, 6) AS revisit_interval, {_NOW_US} + {_HOUR_US(_BOUND('false') + ' * ' + _JITTER)} AS next_us FROM b WHERE action = 'touch'",
    "page_gone": f"WITH {_BATCH} SELECT old_id AS id, 'gone' AS status, CASE WHEN old_status = 'gone' THEN epoch_us(old_at) ELSE {_NOW_US} END AS changed_us, {_NOW_US} + 7776000000000 AS next_us, old_status <> 'gone' AS first FROM b WHERE known AND action IN ('gone', 'redirect')",
    "retry_or_keep": f"WITH {_BATCH} SELECT url, CAST(CASE WHEN action = 'retry' THEN retries + 1 END AS BIGINT) AS retries, CASE WHEN action = 'keep' THEN {_NOW_US} + 86400000000 END AS next_us FROM b WHERE action IN ('retry', 'keep')",
    "link_replace": f"""
WITH {_BATCH}, {_LINKS}, mine AS (SELECT url FROM b WHERE action = 'save' OR (known AND action IN ('gone', 'redirect')))
SELECT source_url, source_host, target_url, target_host, anchor_text FROM l WHERE source_url IS NULL OR source_url NOT IN (SELECT url FROM mine)
UNION ALL SELECT source_url, {duck.url_host('source_url')}, target_url, {duck.url_host('target_url')}, substring(anchor_text, 1, 20) FROM nth WHERE n <= 3 AND source_url IN (SELECT url FROM b WHERE action = 'save') AND target_url <> source_url
""",
    "follow_ups": f"WITH {_BATCH}, {_LINKS}, {_QUEUED} SELECT origin, url, depth FROM queued",
    "crawl_counters": f"""
WITH {_BATCH}, {_LINKS}, {_QUEUED}
SELECT 'enqueued' AS event, count(*) AS n FROM queued WHERE url NOT IN (SELECT url FROM page_changes WHERE url IS NOT NULL)
UNION ALL SELECT 'fetched', count(*) FROM b WHERE action <> 'full' AND code IS NOT NULL UNION ALL SELECT 'notModified', count(*) FROM b WHERE action = 'touch'
UNION ALL SELECT 'indexed', count(*) FROM b WHERE action = 'save' AND state NOT IN ('noindex', 'duplicate') UNION ALL SELECT 'duplicate', count(*) FROM b WHERE action = 'save' AND state = 'duplicate'
UNION ALL SELECT 'skipped', count(*) FROM b WHERE action IN ('full', 'redirect', 'skip') UNION ALL SELECT 'gone', count(*) FROM b WHERE action = 'gone'
UNION ALL SELECT 'error', count(*) FROM b WHERE action IN ('retry', 'keep', 'drop') UNION ALL SELECT 'retried', count(*) FROM b WHERE action = 'retry' UNION ALL SELECT 'sitemap', 0
""",
    "host_counts_after": f"WITH {_BATCH}, n AS (SELECT origin, count(*) AS n FROM b WHERE action = 'save' AND NOT known GROUP BY origin) SELECT id, CAST(page_count + coalesce(n, 0) AS BIGINT) AS page_count FROM (SELECT DISTINCT id, origin, page_count FROM hosts) LEFT JOIN n USING (origin)",
    "page_lookup": "SELECT url, p.id AS id, p.etag AS etag FROM (SELECT DISTINCT target_url AS url FROM links WHERE target_url IS NOT NULL) LEFT JOIN (SELECT url, any_value(id) AS id, first(etag) AS etag FROM pages GROUP BY url) p USING (url)",
    "shard_scan": "SELECT DISTINCT id, CAST(shard_bucket AS BIGINT) AS bucket FROM pages WHERE status = 'ok' AND shard_bucket % 3 = 1",
    "segment_status": "SELECT count(*) AS documents, 3::BIGINT AS segments FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_seq DESC) AS n FROM page_changes WHERE id IS NOT NULL) WHERE n = 1 AND status = 'ok'",
    "frontier_enqueue": f"WITH {_ACCEPTED} SELECT origin, url, seq FROM queue",
    "frontier_claim": f"WITH {_ACCEPTED} SELECT origin, url, seq, epoch_us({CLAIM_SQL}) + 60000000 AS until_us FROM leases",
    "frontier_release": f"""
WITH {_ACCEPTED} SELECT r.origin, CASE WHEN l.origin IS NOT NULL THEN epoch_us({CLAIM_SQL}) + 2000000 ELSE epoch_us(ready_at) END AS ready_us FROM ready r LEFT JOIN leases l ON l.origin = r.origin WHERE l.origin IS NULL OR l.waiting > 1
""",
    "frontier_takeover": f"""
WITH {_ACCEPTED} SELECT b.origin, b.url, b.seq FROM best b JOIN ready r USING (origin) LEFT JOIN leases l ON l.origin = b.origin
WHERE k = CASE WHEN l.origin IS NULL THEN 1 ELSE 2 END AND (l.origin IS NOT NULL OR ready_at IS NULL OR ready_at <= {CLAIM_SQL} + INTERVAL 60 SECOND)
""",
    "recrawl": f"SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, url, CAST(coalesce(depth, 0) AS BIGINT) AS depth, true AS force FROM (SELECT DISTINCT {duck.normalize_url('url')} AS url FROM search_clicks) LEFT JOIN (SELECT url, min(depth) AS depth FROM pages GROUP BY url) USING (url) WHERE url IS NOT NULL",
    "scheduler_tick": f"""
WITH d AS (SELECT id, any_value(url) AS url, any_value(next_crawl_at) AS due_at, any_value(revisit_interval) AS i FROM pages WHERE next_crawl_at <= {NOW_SQL} GROUP BY id ORDER BY due_at, id LIMIT 5000)
SELECT 'seed' AS step, url, NULL::BIGINT AS next_us FROM (SELECT DISTINCT {duck.normalize_url('url')} AS url FROM seeds WHERE enabled) WHERE url IS NOT NULL
UNION ALL SELECT 'due', url, {_NOW_US} + {_HOUR_US("CASE WHEN i IS NULL OR isnan(i) OR i <= 0 THEN 604800.0::DOUBLE ELSE i END")} FROM d WHERE regexp_matches(url, '^https?://[^/?#]+')
UNION ALL SELECT 'purge', url, NULL FROM (SELECT id, any_value(url) AS url FROM pages WHERE status = 'gone' AND changed_at < {NOW_SQL} - INTERVAL 180 DAY GROUP BY id)
""",
    "seed_list": "SELECT id, any_value(url) AS url FROM seeds WHERE enabled GROUP BY id",
    "seed_scope": f"""
WITH h AS (SELECT DISTINCT {duck.url_host(duck.normalize_url('url'))} AS domain FROM seeds WHERE enabled UNION SELECT unnest(['example.org', 'www.lantern-harbor.example'])),
f AS (SELECT DISTINCT seq, {duck.normalize_url('url')} AS url FROM frontier)
SELECT seq, url FROM f WHERE url IS NOT NULL AND EXISTS (SELECT 1 FROM h WHERE {duck.url_host('url')} = domain OR ends_with({duck.url_host('url')}, '.' || domain))
""",
    "active_workers": f"SELECT {duck.host_key('host')} AS worker, epoch_us(max(delivered_at)) AS seen_us FROM page_changes WHERE host IS NOT NULL GROUP BY 1 HAVING max(delivered_at) > (SELECT max(delivered_at) FROM page_changes) - INTERVAL 1 DAY",
    "segment_refresh": "SELECT id, version_hash, change_seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, delivered_at) DESC, change_seq DESC) AS n FROM page_changes WHERE id IS NOT NULL) WHERE n = 1 AND status = 'ok'",
    "watermark": f"""
WITH r AS (SELECT updated_at, delivered_at, {duck.shard('url', 2)} AS shard FROM page_changes WHERE url IS NOT NULL), m AS (SELECT shard, max(updated_at) AS mark FROM r WHERE delivered_at <= {CUT_SQL} GROUP BY shard)
SELECT shard, epoch_us(max(mark)) AS mark_us, count(*) AS changes FROM r JOIN m USING (shard) WHERE updated_at > mark - INTERVAL 2 SECOND GROUP BY shard
""",
}
