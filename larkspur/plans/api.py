"""The service's calls as one object over tables: search, click, suggest, status, pages, seeds and hosts."""

from __future__ import annotations

import hashlib
import hmac
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.hashing import shard, url_hash
from larkspur.functions.urls import host_key, normalize_url, origin
from larkspur.operators import crawl, graph, index, learning, logs, search
from larkspur.plans.query import Synonyms, parse
from larkspur.schema import DEFAULTS, FEATURES, SCHEMAS, WEIGHTS, Settings
from larkspur.session import written


class Engine:
    """Search and administration over a set of tables; every call gives a DataFrame or plain values."""

    def __init__(
        self, spark: SparkSession, tables: dict[str, DataFrame], settings: Settings = DEFAULTS, synonyms: Synonyms | None = None, cache_seconds: float = 300.0, clock: Callable[[], datetime] | None = None,
        cache_entries: int = 1000, reload_seconds: float = 600.0, token: str | None = None,
    ):
        self.spark, self.tables, self.settings, self.synonyms = spark, dict(tables), settings, synonyms
        self.cache_seconds, self.cache_entries, self._cache = cache_seconds, cache_entries, OrderedDict()
        self.reload_seconds, self._model = reload_seconds, None
        self.token = token
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self._index: index.Index | None = None
        self._writer = ThreadPoolExecutor(1)
        self._totals: dict = {}

    def authorised(self, header: str | None) -> bool:
        """Whether an Authorization header carries the administrator's token; compared in constant time. Without a token nobody is."""
        given = (header or "").removeprefix("Bearer ")
        return bool(self.token) and hmac.compare_digest(hashlib.sha256(given.encode()).digest(), hashlib.sha256(self.token.encode()).digest())

    def root(self) -> dict:
        """What the service is and the calls that it has."""
        return {"name": "larkspur", "calls": ["search", "click", "suggest", "status", "pages", "page", "seeds", "add_seed", "remove_seed", "recrawl", "block", "rebuild", "shard_status", "health"]}

    def health(self) -> dict:
        """Whether the session answers."""
        return {"status": "ok" if self.spark.range(1).count() == 1 else "failing"}

    def rebuild(self) -> None:
        """Build the index anew and swap it in when it is whole."""
        self._index = index.write_index(index.index_sources(self.tables["pages"], self.tables["links"], self.tables["hosts"]))
        self._cache.clear()
        self._totals.clear()

    def weights(self) -> tuple[int, list[float]]:
        """Version and weights of the newest stored model that fits our features, else the first model's; read anew every ``reload_seconds``."""
        if self._model and time.monotonic() - self._model[0] < self.reload_seconds:
            return self._model[1]
        models = self.tables.get("ranking_models")
        row = models.orderBy(F.col("version").desc()).limit(1).select("version", "model").first() if models is not None else None
        fits = row and list(row.model.featureNames) == FEATURES and len(row.model.weights) == len(FEATURES)
        self._model = (time.monotonic(), (row.version, list(row.model.weights)) if fits else (0, WEIGHTS))
        return self._model[1]

    def reload(self) -> None:
        """Forget the model that was read, and the results made with it."""
        self._model = None
        self._cache.clear()

    def search(self, text: str, page: int = 1, per: int = 10) -> list[dict]:
        """One page of results as rows (at most 50); kept for ``cache_seconds``. Blank or overlong queries are refused."""
        if not text.strip() or len(text) > 200:
            raise ValueError("a query has 1 to 200 characters")
        if self._index is None:
            self.rebuild()
        query = parse(text, self.synonyms)
        version, weights = self.weights()
        key = (version, query.cache_key, page, per)
        hit = self._cache.get(key)
        if hit and time.monotonic() - hit[0] < self.cache_seconds:
            self._cache.move_to_end(key)
            return hit[1]
        ix = self._index
        rows = [r.asDict() for r in search.search(ix.sources, None, query, self.clock(), page, per, weights, self.settings, ix.postings, ix.stats).orderBy("rank").collect()]
        self._cache[key] = (time.monotonic(), rows)
        while len(self._cache) > self.cache_entries:
            self._cache.popitem(last=False)
        return rows

    def respond(self, text: str, page: int = 1, per: int = 10, explain: bool = False, log: bool = True) -> dict:
        """A page of results as the service answers it: the parsed query, ``total``, results with click addresses, and how long it took.

        With ``log``, the impression is appended to the log in the background; its id is in the answer and in the click addresses.
        """
        began = time.perf_counter()
        text = text.strip()
        query = parse(text, self.synonyms)
        version, _ = self.weights()
        before = len(self._cache), next(reversed(self._cache), None)
        rows = self.search(text, page, per)
        cached = before == (len(self._cache), next(reversed(self._cache), None)) and before[1] is not None
        ident = str(uuid.uuid4()) if log and rows else None
        if ident:
            self._writer.submit(self._log, ident, text, page, version, rows)
        key = ("total", query.cache_key)
        if key not in self._totals:
            if len(self._totals) >= self.cache_entries:
                self._totals.clear()
            self._totals[key] = search.total(self._index.sources, None, query, self._index.postings, self._index.stats).first().total
        results = []
        for r in rows:
            item = {k: r[k] for k in ("rank", "url", "title", "description", "snippet", "score")} | {"changedAt": r["changed_at"].strftime("%Y-%m-%dT%H:%M:%SZ") if r["changed_at"] else None}
            if ident:
                item["clickURL"] = "/click?" + urlencode({"i": ident, "p": r["rank"], "u": r["url"]})
            if explain:
                item["explain"] = {"features": dict(zip(FEATURES, r["features"], strict=True)), "matchedTerms": r["terms"], "shardID": r["shard"]}
            results.append(item)
        return {
            "query": text, "terms": query.terms, "phrases": query.phrases, "excluded": query.excluded, "site": query.site, "language": query.language, "total": self._totals[key], "page": page, "per": per,
            "partial": False, "cached": cached, "modelVersion": version, "impressionID": ident, "tookMs": round((time.perf_counter() - began) * 1000, 3), "results": results,
        }

    def _log(self, ident: str, text: str, page: int, version: int, rows: list[dict]) -> None:
        shown = self.spark.createDataFrame([(r["rank"], r["url"], r["features"]) for r in rows], "rank int, url string, features array<double>")
        new = logs.impression_rows(shown, ident, text, page, version, self.clock())
        old = self.tables["search_impressions"]
        self.tables["search_impressions"] = old.unionByName(written(new, "impression").select(*old.columns))

    def flush(self) -> None:
        """Wait until all impressions are logged."""
        self._writer.submit(lambda: None).result()

    def click(self, impression_id: str | None, position: int, url: str) -> bool:
        """Whether such a click may be followed; it is logged if its impression shows the URL at this position."""
        row = self.spark.createDataFrame([(str(uuid.uuid4()), impression_id, position, url, self.clock())], SCHEMAS["search_clicks"])
        if impression_id is None:
            return self.tables["pages"].where(F.col("url") == url).limit(1).count() > 0
        shown = self.tables["search_impressions"].where(F.col("id") == impression_id)
        if logs.loggable_clicks(row, shown).count():
            self.tables["search_clicks"] = self.tables["search_clicks"].unionByName(row.select(*self.tables["search_clicks"].columns))
            return True
        return logs.valid_clicks(row, shown, self.tables["pages"].where(F.col("url") == url)).count() > 0

    def suggest(self, prefix: str, limit: int = 10) -> list[str]:
        if len(prefix) > 100:
            raise ValueError("a prefix has at most 100 characters")
        return [r.normalized_query for r in logs.suggest(self.tables["search_impressions"], prefix, limit).collect()]

    def status(self) -> dict[str, int]:
        """Counts of pages by status, due pages, hosts and links, and the frontier's."""
        rows = {r.name: r.n for r in crawl.status_rows(self.tables["pages"], self.tables["hosts"], self.tables["links"], self.clock()).collect()}
        return rows | crawl.frontier_stats(self.tables["frontier"], self.clock()).first().asDict() | {"model": self.weights()[0]}

    def shard_status(self) -> list[dict]:
        """Documents and terms of each shard of the index, and the words' document frequencies are those of all shards together."""
        ix = self._index
        if ix is None:
            return [{"shard": n, "available": False, "documents": 0, "terms": 0} for n in range(self.settings.shards)]
        where = ix.sources.select("page_id", shard(url_hash("url"), self.settings.shards).alias("shard"))
        docs = where.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"))
        terms = ix.postings.select("page_id", "term").join(where, "page_id").select("shard", "term").distinct().groupBy("shard").agg(F.count(F.lit(1)).alias("terms"))
        found = {r.shard: r for r in docs.join(terms, "shard").collect()}
        return [{"shard": n, "available": True, "documents": found[n].documents if n in found else 0, "terms": found[n].terms if n in found else 0} for n in range(self.settings.shards)]

    def pages(self, host: str | None = None, page: int = 1, per: int = 20) -> DataFrame:
        """Pages by rank, of one host or all."""
        if not 1 <= page <= 100 or not 1 <= per <= 100:
            raise ValueError("page and per must be 1 to 100")
        rows = self.tables["pages"].dropDuplicates(["id"]).withColumn("page_rank", F.when(~F.isnan("page_rank"), F.col("page_rank")))
        if host:
            rows = rows.where(host_key(F.col("host")) == host.lower())
        return rows.orderBy(F.col("page_rank").desc_nulls_last(), "url", "id").offset((page - 1) * per).limit(per)

    def page(self, page_id: str) -> dict | None:
        """A page with its headings as a list and up to 200 links either way."""
        row = self.tables["pages"].where(F.col("id") == page_id).limit(1).first()
        if row is None:
            return None
        links = self.tables["links"]
        take = lambda side: [r.asDict() for r in links.where(F.col(side) == row.url).dropDuplicates(["id"]).orderBy("id").limit(200).collect()]
        hours = (row.revisit_interval or 0) / 3600 if "revisit_interval" in row else None
        home = self.tables["pages"].where(F.col("id") == page_id).limit(1).select(shard(url_hash("url"), self.settings.shards).alias("s")).first().s
        return row.asDict() | {"headings": [h for h in (row.headings or "").split("\n") if h], "revisitHours": hours, "shard": home, "outgoing": take("source_url"), "incoming": take("target_url")}

    def seeds(self) -> DataFrame:
        return self.tables["seeds"].orderBy("created_at")

    def add_seed(self, seed_id: str, url: str) -> None:
        """Add a seed or enable the one with this URL."""
        new = self.spark.createDataFrame([(seed_id, url, self.clock())], "id string, url string, created_at timestamp").select("id", normalize_url(F.col("url")).alias("url"), F.lit(True).alias("enabled"), "created_at")
        if not new.where("url IS NOT NULL").count():
            raise ValueError("a seed is a web URL")
        old = self.tables["seeds"]
        known = old.join(new.select(F.col("url").alias("_u")), old["url"] == F.col("_u"), "left").withColumn("enabled", F.col("enabled") | F.col("_u").isNotNull()).drop("_u")
        self.tables["seeds"] = known.unionByName(new.join(old.select("url"), "url", "left_anti").select(*old.columns))

    def remove_seed(self, seed_id: str) -> None:
        self.tables["seeds"] = self.tables["seeds"].where(F.col("id") != seed_id)

    def recrawl(self, url: str) -> dict:
        """Queue a URL to be fetched at once, at its stored depth or 0."""
        row = self.spark.createDataFrame([(url,)], "url string").select(normalize_url(F.col("url")).alias("url")).first()
        if row.url is None:
            raise ValueError("not a web URL")
        known = self.tables["pages"].where(F.col("url") == row.url).agg(F.min("depth").alias("depth")).first().depth if "depth" in self.tables["pages"].columns else None
        last = self.tables["frontier"].agg(F.max("seq").alias("s")).first().s or 0
        new = self.spark.createDataFrame([(row.url, known or 0, 0, "page", last + 1)], "url string, depth int, retries int, kind string, seq long")
        new = new.select(origin(F.col("url")).alias("origin"), "*", F.lit(None).cast("timestamp").alias("next_allowed_at"))
        self.tables["frontier"] = self.tables["frontier"].unionByName(new.select(*self.tables["frontier"].columns))
        return new.first().asDict()

    def block(self, host: str, blocked: bool = True) -> None:
        """Block or unblock all origins of a host; its robots.txt is fetched anew. A host that was never met is refused."""
        mine = host_key(F.col("host")) == host.lower()
        hosts = self.tables["hosts"]
        if not hosts.where(mine).limit(1).count():
            raise LookupError(f"{host} was never met")
        self.tables["hosts"] = hosts.withColumn("blocked", F.when(mine, F.lit(blocked)).otherwise(F.col("blocked"))).withColumn("robots_fetched_at", F.when(mine, F.lit(None).cast("timestamp")).otherwise(F.col("robots_fetched_at")))

    def link_analysis(self) -> dict[str, int]:
        """Compute and store page ranks (those that differ) and host ranks (all); tells how many pages and hosts were ranked and changed."""
        pages, links, hosts = (self.tables[t] for t in ("pages", "links", "hosts"))
        ranks = written(graph.pagerank(*graph.page_graph(pages, links)), "ranks")
        old = pages.where("url IS NOT NULL").groupBy(F.col("url").alias("id")).agg(F.max("page_rank").alias("old_rank"))
        new = graph.changed_ranks(old, ranks).select(F.col("id").alias("_url"), F.col("rank").alias("_rank"))
        self.tables["pages"] = pages.join(new, pages["url"] == new["_url"], "left").withColumn("page_rank", F.coalesce("_rank", "page_rank")).select(*pages.columns)
        of_hosts = written(graph.pagerank(*graph.host_graph(hosts, links)), "ranks").select(F.col("id").alias("_host"), F.col("rank").alias("_rank"))
        self.tables["hosts"] = hosts.join(of_hosts, host_key(hosts["host"]) == of_hosts["_host"], "left").withColumn("host_rank", F.coalesce("_rank", "host_rank")).select(*hosts.columns)
        return {"pages": ranks.count(), "updatedPages": new.count(), "hosts": of_hosts.count()}

    def train_ranker(self, days: int | None = None, minimum: int | None = None, dry_run: bool = False) -> learning.Training:
        """Learn a model from the log and store it as the newest version; the click counts of the pages are written back in any case."""
        impressions, clicks, pages = (self.tables[t] for t in ("search_impressions", "search_clicks", "pages"))
        days, minimum = self.settings.training_days if days is None else days, self.settings.minimum_pairs if minimum is None else minimum
        got = learning.train_run(impressions, clicks, self.clock(), self.weights()[1], days, minimum)
        counts = learning.url_counts(learning.recent(impressions, self.clock(), days), learning.recent(clicks, self.clock(), days))
        counts = written(counts, "counts").select(F.col("url").alias("_url"), F.col("impressions").cast("int").alias("_i"), F.col("clicks").cast("int").alias("_c"))
        joined = pages.join(counts, pages["url"] == counts["_url"], "left")
        joined = joined.withColumn("impressions", F.coalesce("_i", "impressions")).withColumn("clicks", F.when(F.col("_i").isNotNull(), F.col("_c")).otherwise(F.col("clicks")))
        self.tables["pages"] = joined.select(*pages.columns)
        if got.weights and not dry_run:
            models = self.tables.get("ranking_models", self.spark.createDataFrame([], SCHEMAS["ranking_models"]))
            self.tables["ranking_models"] = learning.appended_model(models, str(uuid.uuid4()), got.weights, got.pairs, self.clock())
            self.reload()
        return got
