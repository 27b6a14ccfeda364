"""The crawl as a loop of batches: claim, fetch, take in, give back. All state is tables in one folder, published whole after each cycle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.hashing import content_hash, simhash_of
from larkspur.functions.text import tokenize
from larkspur.functions.urls import normalize_url, origin
from larkspur.operators import crawl, frontier, ingest
from larkspur.operators.incremental import VersionLog
from larkspur.schema import DEFAULTS, SCHEMAS, Settings
from larkspur.session import checkpointed
from larkspur.sources import web

TABLES = {n: SCHEMAS[n] for n in ("pages", "links", "hosts")} | {
    "queue": "origin string, url string, depth int, retries int, kind string, seq long", "seen": "url string", "ready": "origin string, ready_at timestamp", "counters": "cycle int, event string, n long",
}


class CrawlLoop:
    """Runs cycles over the tables under ``path``. ``fetch`` answers a table of ``url, etag, last_modified`` with ``url, status, content_type, location, etag, last_modified, body``.

    A cycle claims one entry of every origin that may be asked (at most ``batch``), the origins side by side in as many tasks as the session has; its result is
    published as one version, so that a cycle that failed is simply run again. robots.txt and sitemaps are fetched like pages.
    """

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame], agent: str = "larkspur", settings: Settings = DEFAULTS, block: list[str] | None = None, batch: int = 10_000):
        self.spark, self.fetch, self.agent, self.settings, self.block, self.batch = spark, fetch, agent, settings, block, batch
        self.log = VersionLog(spark, path)

    def state(self) -> dict:
        """Newest version: its number and the folder of each table."""
        return self.log.latest() or {"version": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        """A table of the newest version."""
        folder = self.state()["tables"].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(folder) if folder else self.spark.createDataFrame([], TABLES[name])

    def _publish(self, changed: dict[str, DataFrame]) -> None:
        now, folders = self.state(), {}
        for name, df in changed.items():
            folders[name] = f"{self.log.path}/data/{uuid.uuid4().hex}"
            kinds = [x.strip().split() for x in TABLES[name].split(", ")]
            have = set(df.columns)
            df.select(*[F.col(n).cast(k).alias(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in kinds]).write.parquet(folders[name])
        self.log.publish(now["version"] + 1, {"version": now["version"] + 1, "tables": now["tables"] | folders})

    def add(self, urls: list[str], force: bool = False) -> None:
        """Queue addresses to begin with."""
        rows = self.spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "raw string, seq long").select(normalize_url(F.col("raw")).alias("url"), "seq")
        self._queue(rows.where("url IS NOT NULL").select(origin(F.col("url")).alias("origin"), "url", F.lit(0).alias("depth"), F.lit(0).alias("retries"), F.lit("page").alias("kind"), "seq", F.lit(force).alias("force")))

    def _queue(self, entries: DataFrame) -> None:
        queue, seen, ready = frontier.enqueue(self.table("queue"), self.table("seen"), self.table("ready"), entries, self.settings.max_queue_per_host)
        self._publish({"queue": queue, "seen": seen, "ready": ready})

    def _robots(self, origins: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
        """Hosts after robots.txt was read for the origins that need it, and the sitemaps that follow from those."""
        hosts = self.table("hosts")
        known = web.robots_policy(hosts, now, self.settings).withColumnRenamed("origin", "_o")
        need = checkpointed(origins.join(known, origins["origin"] == known["_o"], "left").where(F.coalesce("policy", F.lit("fetch")) == "fetch").select("origin").distinct())
        asked = need.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
        said = web.robots_status(F.col("status"))
        got = checkpointed(self.fetch(asked).select(origin(F.col("url")).alias("_o"), said.alias("_status"), F.when(said == "ok", F.coalesce("body", F.lit(""))).alias("_txt")))
        old = hosts.join(got, hosts["origin"] == got["_o"], "left")
        mine = F.col("_o").isNotNull()
        read = old.withColumn("robots_status", F.coalesce("_status", "robots_status")).withColumn("robots_txt", F.when(mine, F.col("_txt")).otherwise(F.col("robots_txt"))).withColumn("robots_fetched_at", F.when(mine, F.lit(now)).otherwise(F.col("robots_fetched_at")))
        new = got.join(hosts, got["_o"] == hosts["origin"], "left_anti").select(
            F.sha2("_o", 256).alias("id"), F.col("_o").alias("origin"), F.regexp_extract("_o", "^https?://([^/:]+)", 1).alias("host"), F.col("_txt").alias("robots_txt"), F.col("_status").alias("robots_status"),
            F.lit(now).alias("robots_fetched_at"), F.lit(0).alias("page_count"), F.lit(None).cast("double").alias("host_rank"), F.lit(False).alias("blocked"), F.lit(now).alias("created_at"),
        )
        hosts = checkpointed(read.select(*hosts.columns).unionByName(new.select(*hosts.columns)))
        listed = web.robots_rules(hosts.join(need, "origin", "left_semi"), "origin", "robots_txt", self.agent).select(F.col("origin").alias("_o"), "sitemaps").dropDuplicates(["_o"])
        maps = need.join(listed, need["origin"] == listed["_o"], "left").select("origin", F.explode(web.sitemaps_to_read(F.col("origin"), F.col("sitemaps"), self.settings)).alias("url"))
        return hosts, checkpointed(maps.select("origin", "url", F.lit(0).alias("depth"), F.lit(0).alias("retries"), F.lit("sitemap").alias("kind"), F.lit(True).alias("force")))

    def cycle(self, now: datetime) -> int:
        """One cycle at ``now``; gives the number of leases it has handled, 0 if no origin may be asked."""
        queue, seen, ready, pages = (self.table(n) for n in ("queue", "seen", "ready", "pages"))
        leases = checkpointed(frontier.claims(queue, ready, now, self.batch, self.settings.lease))
        handled = leases.count()
        if not handled:
            return 0
        queue, ready = frontier.claimed(queue, ready, leases)
        hosts, maps = self._robots(leases.select("origin"), now)
        path = leases.select("*", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))
        verdict = web.robots_verdict(path.select("origin", "path"), hosts, now, self.agent, self.settings).select(F.col("origin").alias("_o"), F.col("path").alias("_p"), "allowed")
        rules = web.robots_rules(hosts, "origin", "robots_txt", self.agent).groupBy(F.col("origin").alias("_d")).agg(F.max("delay").alias("delay"))
        asked = path.join(verdict, (path["origin"] == verdict["_o"]) & (path["path"] == verdict["_p"])).join(rules, path["origin"] == rules["_d"], "left").drop("_o", "_p", "_d", "path")
        asked = checkpointed(asked.withColumn("allowed", F.coalesce("allowed", F.lit(False))))
        old = ingest.lookup(asked.where("allowed").select("url"), pages.select("url", "etag", "last_modified"))
        answers = checkpointed(self.fetch(old.select("url", F.col("old.etag").alias("etag"), F.col("old.last_modified").alias("last_modified"))))
        found = answers.where(F.col("status").between(200, 299) & web.is_html(F.col("content_type")))
        parsed = checkpointed(web.extract_pages(found, "url", "body"))
        hashed = checkpointed(parsed.select(F.col("url").alias("_u"), content_hash(F.col("title"), F.col("content")).alias("content_hash"), tokenize(F.concat("title", F.lit("\n"), "content")).alias("t"), "title", "description", "headings", "content", "language", "canonical", "links", "noindex", "nofollow"))
        hashed = checkpointed(hashed.withColumn("simhash", simhash_of("t")).drop("t"))
        # a page repeats the first live one within three bits, of this cycle or before
        live = pages.where("status IN ('ok', 'duplicate')").select("url", "simhash", "fetched_at").join(hashed.select(F.col("_u").alias("url")), "url", "left_anti")
        every = live.unionByName(hashed.where("NOT noindex").select(F.col("_u").alias("url"), "simhash", F.lit(now).cast("timestamp").alias("fetched_at")))
        original = crawl.near_duplicate_pages(every, "url").where("leader <> url").select(F.col("url").alias("_r"), F.col("leader").alias("original"))
        answered = asked.where("kind <> 'sitemap'").join(answers.select(F.col("url").alias("_a"), "status", "content_type", F.col("location").alias("_to"), "etag", "last_modified"), F.col("url") == F.col("_a"), "left")
        fetches = answered.join(hashed, F.col("url") == F.col("_u"), "left").join(original, F.col("url") == F.col("_r"), "left")
        target = F.when(F.col("_to").startswith("/"), F.concat("origin", "_to")).otherwise(F.col("_to"))
        fetches = fetches.withColumn("html", F.coalesce(web.is_html(F.col("content_type")), F.lit(False))).withColumn("location", normalize_url(target)).drop("_a", "_u", "_r", "_to", "content_type", "origin", "kind", "seq", "lease_until")
        rows = checkpointed(ingest.decided(fetches, pages, hosts, self.settings, None, self.block))
        saved = checkpointed(ingest.saved(rows, now, self.settings))
        last = queue.agg(F.max("seq").alias("s")).first().s or 0
        body = answers.where(F.col("status").between(200, 299)).join(asked.where("kind = 'sitemap'").select(F.col("url").alias("_m"), "origin", "depth"), F.col("url") == F.col("_m"))
        listed = web.sitemap_entries(body.select("origin", "depth", "body"), "body", self.settings)
        listed = listed.where((F.col("kind") == "sitemap") | crawl.in_scope(F.col("url"), F.col("depth"), None, self.block, self.settings)).select("origin", "url", "depth", F.lit(0).alias("retries"), "kind", F.lit(False).alias("force"))
        links = ingest.queued(rows, self.settings, None, self.block).select("origin", "url", "depth", F.lit(0).alias("retries"), F.lit("page").alias("kind"), F.lit(False).alias("force"))
        again = ingest.retried(rows).select("origin", "url", "depth", "retries", F.lit("page").alias("kind"), "force")
        entries = checkpointed(maps.unionByName(again).unionByName(links).unionByName(listed).withColumn("seq", F.monotonically_increasing_id() + last + 1))
        seen = seen.unionByName(leases.select("url")).distinct()
        queue = checkpointed(queue)
        new = checkpointed(frontier.accepted(queue, seen, entries, self.settings.max_queue_per_host))
        queue, seen, ready = frontier.enqueue(queue, seen, ready, entries, self.settings.max_queue_per_host)
        wait = asked.join(rows.select(F.col("url").alias("_w"), "action", "status"), F.col("url") == F.col("_w"), "left")
        seconds = ingest.pause(F.col("delay"), F.coalesce("action", F.lit("save")), F.col("status"), self.settings)
        free = wait.select("origin", F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + (seconds * 1e6).cast("long")).alias("next_allowed_at"))
        times = ingest.touched(rows, now, self.settings).drop("url").unionByName(ingest.kept(rows, now, self.settings).drop("url"), allowMissingColumns=True)
        times = times.unionByName(ingest.gone(rows, now, self.settings).drop("url", "first"), allowMissingColumns=True)
        counts = ingest.counters(rows, saved, new, body.count()).select(F.lit(self.state()["version"] + 1).alias("cycle"), "event", "n")
        self._publish({
            "pages": _merged(pages, saved, times), "links": ingest.replaced_links(self.table("links"), rows, self.settings), "hosts": ingest.counted_hosts(hosts, saved), "queue": queue, "seen": seen,
            "ready": frontier.released(queue, ready, free), "counters": self.table("counters").unionByName(counts, allowMissingColumns=True),
        })
        return handled

    def run(self, start: datetime, cycles: int, idle: timedelta = timedelta(seconds=1)) -> int:
        """Cycles one ``idle`` apart until there is nothing left to ask or ``cycles`` are done; gives the number of leases handled."""
        done = 0
        for i in range(cycles):
            done += self.cycle(start + i * idle)
            if not self.table("queue").limit(1).count():
                break
        return done


def _merged(pages: DataFrame, saved: DataFrame, times: DataFrame) -> DataFrame:
    """Pages after a batch: saved rows replace or add to them, ``times`` (by id) change single columns."""
    change = times.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in times.columns if c != "id"])
    kept = pages.join(saved.select("url"), "url", "left_anti").join(change, F.col("id") == F.col("_id"), "left")
    kept = kept.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in kept.columns and c != "id" else F.col(c) for c in pages.columns])
    old = pages.select(F.col("id").alias("_id"), *[c for c in pages.columns if c not in saved.columns])
    return kept.unionByName(saved.join(old, saved["id"] == old["_id"], "left").select(*pages.columns))
