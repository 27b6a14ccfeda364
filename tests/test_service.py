"""The service calls, the jobs, the web source and the crawl's tables in small worked cases."""

import json
import math
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.functions.hashing import blocks
from larkspur.operators import crawl, frontier, ingest, learning
from larkspur.operators.segments import SegmentedIndex
from larkspur.plans.api import Engine
from larkspur.schema import FEATURES, SCHEMAS, WEIGHTS, Settings
from larkspur.session import scratch_path
from larkspur.sources import http, tables, web
from larkspur.streaming import refresh

NOW = datetime(2026, 4, 1, tzinfo=timezone.utc)


def _rows(spark, schema, rows):
    names = [c.split()[0] for c in schema.replace("array<struct<url:string,text:string,nofollow:boolean>>", "x").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def engine(spark):
    data = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    pages = [
        {"id": str(i), "url": f"https://{h}.example/p{i}", "host": f"{h}.example", "status": "ok", "title": t, "headings": "one\n\ntwo", "content": f"{t} and more words", "depth": i, "page_rank": 0.1, "changed_at": NOW, "revisit_interval": 7200.0}
        for i, (h, t) in enumerate([("a", "Swift guide"), ("a", "Swift notes"), ("b", "Python guide")])
    ]
    data["pages"] = _rows(spark, SCHEMAS["pages"], pages)
    data["links"] = _rows(spark, SCHEMAS["links"], [{"id": "l", "source_url": pages[0]["url"], "source_host": "a.example", "target_url": pages[2]["url"], "target_host": "b.example", "anchor_text": "x"}])
    data["hosts"] = _rows(spark, SCHEMAS["hosts"], [{"id": h, "origin": f"https://{h}.example", "host": f"{h}.example", "page_count": 1, "blocked": False} for h in "ab"])
    return Engine(spark, data, clock=lambda: NOW, token="secret", cache_entries=2)


def test_answer_and_its_log(engine):
    got = engine.respond("swift", explain=True)
    assert got["total"] == 2 and not got["cached"] and got["terms"] == ["swift"] and got["modelVersion"] == 0 and got["tookMs"] > 0
    first = got["results"][0]
    assert first["rank"] == 1 and first["changedAt"] == "2026-04-01T00:00:00Z" and set(first["explain"]["features"]) == set(FEATURES) and first["explain"]["matchedTerms"] == ["swift"]
    assert first["clickURL"].startswith(f"/click?i={got['impressionID']}&p=1&u=https")
    engine.flush()
    row = engine.tables["search_impressions"].first()
    assert row.id == got["impressionID"] and [r.position for r in row.payload.results] == [1, 2]
    assert engine.respond("swift", log=False)["cached"] and engine.respond("nothing")["impressionID"] is None
    assert engine.click(got["impressionID"], 1, first["url"]) and not engine.click(got["impressionID"], 2, first["url"]) and not engine.click(None, 1, "https://evil.example/")
    assert engine.tables["search_clicks"].count() == 1
    json.dumps(got)


def test_administration(engine):
    assert engine.authorised("Bearer secret") and not engine.authorised("Bearer other") and not engine.authorised(None)
    assert engine.health() == {"status": "ok"} and "search" in engine.root()["calls"]
    assert engine.recrawl("HTTPS://A.example/p1?utm_source=x") == {"origin": "https://a.example", "url": "https://a.example/p1", "depth": 1, "retries": 0, "kind": "page", "seq": 1, "next_allowed_at": None}
    with pytest.raises(ValueError):
        engine.recrawl("mailto:x")
    engine.block("B.example")
    assert {r.host: r.blocked for r in engine.tables["hosts"].collect()} == {"a.example": False, "b.example": True}
    with pytest.raises(LookupError):
        engine.block("c.example")
    detail = engine.page("0")
    assert detail["headings"] == ["one", "two"] and detail["revisitHours"] == 2 and detail["shard"] in (0, 1) and len(detail["outgoing"]) == 1
    engine.rebuild()
    status = engine.shard_status()
    assert sum(s["documents"] for s in status) == 3 and [s["shard"] for s in status] == [0, 1]
    for text in ("a", "b", "c"):
        engine.search(text)
    assert len(engine._cache) == 2
    assert engine.link_analysis()["hosts"] == 2


def test_jobs(spark, engine, tmp_path):
    folder = str(tmp_path)
    for name in ("pages", "links", "hosts"):
        engine.tables[name].write.parquet(f"{folder}/{name}.parquet")
    assert set(tables.create(spark, folder)) == set(SCHEMAS) - {"pages", "links", "hosts"} and tables.create(spark, folder) == []
    assert cli.main([folder, "link-analysis"], spark)["pages"] == 3
    assert sum(r.page_rank for r in spark.read.parquet(f"{folder}/pages.parquet").collect()) == pytest.approx(1)
    assert cli.main([folder, "seed", "https://New.example"], spark)["url"] == "https://new.example/"
    assert spark.read.parquet(f"{folder}/seeds.parquet").first().url == "https://new.example/" and spark.read.parquet(f"{folder}/frontier.parquet").count() == 1
    results = [("u1", 1, [0.0] * 12), ("u2", 2, [1.0] + [0.0] * 11)]
    log = spark.createDataFrame([(str(i), "q", "q", 1, (results,), 0, NOW) for i in range(6)], SCHEMAS["search_impressions"])
    log.write.mode("overwrite").parquet(f"{folder}/search_impressions.parquet")
    recent = datetime.now(timezone.utc)
    clicks = [(f"c{i}", str(i), 2, "u2", recent if i < 4 else recent - timedelta(days=40)) for i in range(6)]
    spark.createDataFrame(clicks, SCHEMAS["search_clicks"]).write.mode("overwrite").parquet(f"{folder}/search_clicks.parquet")
    assert cli.main([folder, "train-ranker"], spark)["weights"] is None
    assert cli.main([folder, "train-ranker", "--min-pairs", "4", "--dry-run"], spark)["pairs"] == 4
    assert cli.main([folder, "train-ranker", "--min-pairs", "4", "--days", "60"], spark)["pairs"] == 6 and cli.main([folder, "train-ranker", "--min-pairs", "1"], spark)["weights"][0] > WEIGHTS[0]
    assert sorted(r.version for r in spark.read.parquet(f"{folder}/ranking_models.parquet").collect()) == [1, 2]
    tables.drop(spark, folder, ["seeds"])
    assert tables.create(spark, folder) == ["seeds"]
    assert tables.jdbc_options("postgres://u:p@db:99/search?sslmode=require") == {"url": "jdbc:postgresql://db:99/search", "driver": "org.postgresql.Driver", "user": "u", "password": "p", "sslmode": "require"}


def test_training_goes_where_single_steps_go(spark):
    import random

    rng = random.Random(3)
    truth = [rng.gauss(0, 1) for _ in range(12)]
    diffs = []
    for _ in range(600):
        d = [rng.gauss(0, 0.5) for _ in range(12)]
        good = sum(a * b for a, b in zip(truth, d, strict=True)) + rng.gauss(0, 0.3) > 0
        diffs.append(d if good else [-x for x in d])
    pairs = spark.createDataFrame([(d,) for d in diffs], "difference array<double>")
    mean = learning.train(pairs)
    w = list(WEIGHTS)
    for epoch in range(20):  # one step a pair, in random order
        rate = 0.05 / (1 + 0.1 * epoch)
        rng.shuffle(diffs)
        for d in diffs:
            s = 1 / (1 + math.exp(sum(a * b for a, b in zip(w, d, strict=True))))
            w = [a + rate * (s * x - 0.01 * (a - a0)) for a, x, a0 in zip(w, d, WEIGHTS, strict=True)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    right = lambda m: sum(dot(m, d) > 0 for d in diffs) / len(diffs)
    assert dot(mean, w) / math.sqrt(dot(mean, mean) * dot(w, w)) > 0.97 and abs(right(mean) - right(w)) < 0.02 and right(mean) > right(WEIGHTS) + 0.1


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/page")
            self.end_headers()
        elif self.headers.get("If-None-Match") == "v1":
            self.send_response(304)
            self.end_headers()
        else:
            body = ("x" * 5000 if self.path == "/large" else "<title>Hi</title>").encode()
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("ETag", "v1")
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_web_pages(spark):
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    http.register(spark)
    asked = [f"{base}/page", f"{base}/moved", f"{base}/none", f"{base}/large", {"url": f"{base}/same", "etag": "v1"}, "http://127.0.0.1:1/off"]
    df = spark.read.format("web_pages").option("urls", json.dumps(asked)).option("most_bytes", 1000).option("pause", 0).load()
    got = {r.url.rsplit("/", 1)[1]: r for r in df.collect()}
    assert (got["page"].status, got["page"].body, got["page"].etag) == (200, "<title>Hi</title>", "v1") and got["moved"].status == 301 and got["moved"].location == "/page"
    assert got["none"].status == 404 and got["same"].status == 304 and got["large"].status is None and "large" in got["large"].error and got["off"].error
    kinds = {r.url.rsplit("/", 1)[1]: (r.o, r.h) for r in df.select("url", web.outcome(F.col("status")).alias("o"), web.is_html(F.col("content_type")).alias("h")).collect()}
    assert kinds["page"] == ("parse", True) and kinds["moved"][0] == "redirect" and kinds["off"] == ("retry", None)
    server.shutdown()


FETCH = (
    "url string, depth int, retries int, status int, html boolean, allowed boolean, location string, canonical string, noindex boolean, nofollow boolean, title string, description string, content string, language string, "
    "etag string, last_modified string, content_hash string, simhash long, headings array<string>, links array<struct<url:string,text:string,nofollow:boolean>>, original string"
)


def test_a_batch_of_fetches(spark):
    u = lambda n, h="a": f"https://{h}.example/{n}"
    ok = {"status": 200, "html": True, "depth": 1, "retries": 0, "content_hash": "new", "headings": ["h"], "links": []}
    fetches = _rows(spark, FETCH, [
        ok | {"url": u("new"), "links": [(u("x"), "t" * 300, False), (u("new"), "self", False), (u("y"), "no", True), (u("file.zip"), "f", False)]},
        ok | {"url": u("old"), "depth": 5}, ok | {"url": u("same"), "content_hash": "h"}, ok | {"url": u("noidx"), "noindex": True, "original": u("z")}, ok | {"url": u("dup"), "original": u("z")},
        ok | {"url": u("canon"), "canonical": u("real")}, ok | {"url": u("pdf"), "html": False}, ok | {"url": u("full", "b")}, ok | {"url": u("quiet"), "nofollow": True, "links": [(u("w"), "w", False)]},
        ok | {"url": u("not"), "status": 304}, ok | {"url": u("moved"), "status": 301, "location": u("to")}, ok | {"url": u("err"), "status": None}, ok | {"url": u("busy"), "status": 429, "retries": 3},
        ok | {"url": u("lost"), "status": 500, "retries": 3}, ok | {"url": u("dead"), "status": 410}, ok | {"url": u("deny"), "allowed": False},
    ])
    stored = ["old", "same", "canon", "pdf", "not", "moved", "busy", "dead", "deny"]
    page = {"host": "a.example", "status": "ok", "content_hash": "h", "depth": 2, "fetch_count": 3, "change_count": 1, "revisit_interval": 864000.0, "changed_at": NOW - timedelta(days=9)}
    pages = _rows(spark, SCHEMAS["pages"], [page | {"id": n, "url": u(n), "status": "gone" if n == "dead" else "ok"} for n in stored])
    hosts = _rows(spark, SCHEMAS["hosts"], [{"id": h, "origin": f"https://{h}.example", "page_count": n} for h, n in (("a", 4), ("b", 9))])
    rows = ingest.decided(fetches, pages.union(pages), hosts, Settings(max_pages_per_host=9)).cache()
    name = lambda url: url.rsplit("/", 1)[1]
    assert {name(r.url): r.action for r in rows.collect()} == {
        "new": "save", "old": "save", "same": "save", "noidx": "save", "dup": "save", "quiet": "save", "canon": "canonical", "pdf": "gone", "full": "full", "not": "touch", "moved": "redirect", "err": "retry", "busy": "keep",
        "lost": "drop", "dead": "gone", "deny": "blocked",
    }
    saved = {name(r.url): r for r in ingest.saved(rows, NOW).collect()}
    assert (saved["old"].depth, saved["old"].fetch_count, saved["old"].change_count, saved["old"].revisit_interval, saved["old"].changed_at.day) == (2, 4, 2, 432000.0, 1) and not saved["same"].changed
    assert (saved["noidx"].status, saved["noidx"].duplicate_of, saved["dup"].status, saved["dup"].duplicate_of) == ("noindex", None, "duplicate", u("z")) and saved["new"].is_new and saved["new"].revisit_interval == 604800.0
    assert abs((saved["new"].next_crawl_at.timestamp() - NOW.timestamp()) / 604800 - 1) <= 0.1
    assert {name(r.url): r.first for r in ingest.gone(rows, NOW).collect()} == {"canon": True, "pdf": True, "moved": True, "dead": False, "deny": True}
    assert [(name(r.url), r.retries) for r in ingest.retried(rows).collect()] == [("err", 1)] and [name(r.url) for r in ingest.kept(rows, NOW).collect()] == ["busy"]
    old = _rows(spark, SCHEMAS["links"], [{"id": n, "source_url": u(n), "target_url": u("t")} for n in ("old", "dead", "not")])
    links = {(name(r.source_url), name(r.target_url), len(r.anchor_text or "")) for r in ingest.replaced_links(old, rows).collect()}
    assert links == {("not", "t", 0), ("new", "x", 200), ("new", "file.zip", 1)}
    queued = {name(r.url): r.depth for r in ingest.queued(rows).collect()}
    assert queued == {"x": 2, "new": 2, "to": 1, "real": 1}
    counts = {r.event: r.n for r in ingest.counters(rows, ingest.saved(rows, NOW), ingest.queued(rows), 2).collect()}
    assert counts == {"enqueued": 4, "fetched": 13, "notModified": 1, "indexed": 4, "duplicate": 1, "skipped": 5, "gone": 1, "error": 3, "retried": 1, "sitemap": 2}
    assert {r.id: r.page_count for r in ingest.counted_hosts(hosts, ingest.saved(rows, NOW)).collect()} == {"a": 8, "b": 9}


def test_frontier_steps(spark):
    q = spark.createDataFrame([], "origin string, url string, depth int, retries int, kind string, seq long")
    seen, ready = spark.createDataFrame([("o/seen",)], "url string"), spark.createDataFrame([], "origin string, ready_at timestamp")
    rows = [("o", "o/1", 1, 0, "page", 1, False), ("o", "o/1", 0, 0, "page", 2, False), ("o", "o/seen", 0, 0, "page", 3, False), ("o", "o/0", 0, 0, "page", 4, False), ("o", "o/late", 0, 0, "page", 5, False), ("p", "o/seen", 0, 1, "page", 6, True)]
    entries = spark.createDataFrame(rows, "origin string, url string, depth int, retries int, kind string, seq long, force boolean")
    q, seen, ready = frontier.enqueue(q, seen, ready, entries, capacity=2)
    assert sorted(r.url for r in q.collect()) == ["o/0", "o/1", "o/seen"] and {r.url for r in seen.collect()} == {"o/0", "o/1", "o/seen"}  # o/late found no room and is not remembered
    leases = frontier.claims(q, ready, NOW)
    assert sorted((r.origin, r.url) for r in leases.collect()) == [("o", "o/0"), ("p", "o/seen")] and frontier.claims(q, ready, NOW, limit=1).count() == 1
    q, ready = frontier.claimed(q, ready, leases)
    assert frontier.claims(q, ready, NOW).count() == 0 and [r.url for r in frontier.claims(q, ready, NOW + timedelta(seconds=60)).collect()] == ["o/1"]  # the lease has run out
    done = frontier.released(q, ready, spark.createDataFrame([("o", NOW + timedelta(seconds=5)), ("p", NOW)], "origin string, next_allowed_at timestamp"))
    assert [r.origin for r in done.collect()] == ["o"] and frontier.stats(q, done, NOW).first().asDict() == {"hosts": 1, "ready": 0, "queued": 1}


def test_streams_survive_a_second_run(spark, tmp_path):
    schema = "id string, status string, version_hash string, updated_at timestamp, delivered_at timestamp, change_seq long"
    at = lambda n: NOW + timedelta(hours=n)
    batches = [[("a", "ok", "a1", at(1), at(1), 1), ("b", "ok", "b1", None, at(1), 2)], [("a", "ok", "a0", at(0), at(2), 3), ("b", "gone", "b2", at(3), at(3), 4), ("c", "ok", "c1", at(3), at(3), 5)], [("b", "ok", "b3", at(4), at(4), 6)]]
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    want = [{"a1", "b1"}, {"a1", "c1"}, {"a1", "b3", "c1"}]
    for rows, live in zip(batches, want, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        refresh.refresh_stream(spark.readStream.schema(schema).parquet(src), state, str(tmp_path / "c")).awaitTermination()
        assert {r.version_hash for r in refresh.fresh_index(spark, state).collect()} == live
    urls, out = str(tmp_path / "urls"), str(tmp_path / "plan")
    for n, rows in enumerate([[("https://a.example/1", 1, 1), ("https://A.example/1", 0, 2), ("https://a.example/2", 0, 3), ("no url", 0, 4)], [("https://a.example/1#x", 0, 5), ("https://a.example/3", 0, 6), ("https://b.example/", 0, 7)]]):
        spark.createDataFrame(rows, "url string, priority long, seq long").coalesce(1).write.mode("append").parquet(urls)
        refresh.frontier_stream(spark.readStream.schema("url string, priority long, seq long").parquet(urls), out, str(tmp_path / "d"), lambda n=n: NOW + timedelta(seconds=n), delay=10).awaitTermination()
    got = sorted((r.url, (r.lease_at.replace(tzinfo=timezone.utc) - NOW).total_seconds()) for r in refresh.planned(spark, out).collect())
    assert got == [("https://a.example/1", 10.0), ("https://a.example/2", 0.0), ("https://a.example/3", 20.0), ("https://b.example/", 1.0)]


def test_segments(spark):
    index = SegmentedIndex(spark, scratch_path(spark, "seg"), "id string, v int", max_segments=3)
    make = lambda rows: spark.createDataFrame(rows, "id string, v int")
    for n in range(6):
        index.apply(make([("a", n), (f"k{n}", n), (None, 1)]), make([(f"k{n - 1}", 0)]))
        index.apply(make([("a", n), (f"k{n}", n)]), make([]))
        assert sorted((r.id, r.v) for r in index.live().collect()) == sorted([("a", n), (f"k{n}", n)])
        assert index.status().first().segments <= 3
    assert index.vacuum(older_than=-60) > 0 and index.live().count() == 2


def test_blocks_miss_no_pair_of_three_bits(spark):
    import itertools

    base = 0x9E3779B97F4A7C15
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in itertools.islice(itertools.combinations(range(64), 3), 0, None, 97)]
    df = spark.createDataFrame([(signed(x),) for x in [base, *near]], "h long").select("h", F.inline(blocks(F.col("h"), 3)))
    mine = df.where(F.col("h") == signed(base)).select("block", "bits")
    assert df.join(mine, ["block", "bits"], "left_semi").select("h").distinct().count() == len(near) + 1


def test_scope_and_robots_policy(spark):
    seeds = spark.createDataFrame([("1", "https://www.a.example/x", True), ("2", "https://b.example", False), ("3", None, True)], "id string, url string, enabled boolean")
    rows = spark.createDataFrame([("www.a.example",), ("x.www.a.example",), ("a.example",), ("b.example",), ("sub.own.example",), (None,)], "host string")
    assert {r.host for r in crawl.within_hosts(rows, "host", crawl.scope_hosts(seeds, ["own.example"])).collect()} == {"www.a.example", "x.www.a.example", "sub.own.example"}
    hour = timedelta(hours=1)
    hosts = spark.createDataFrame(
        [("blocked", "ok", NOW, True), ("fresh", "ok", NOW - 23 * hour, False), ("old", "ok", NOW - 25 * hour, False), ("none", "missing", NOW, False), ("err", "error", NOW, False), ("err2", "error", NOW - 2 * hour, False), ("never", "unknown", None, False)],
        "origin string, robots_status string, robots_fetched_at timestamp, blocked boolean",
    )
    got = {r.origin: r.policy for r in web.robots_policy(hosts, NOW).collect()}
    assert got == {"blocked": "none", "fresh": "rules", "old": "fetch", "none": "all", "err": "none", "err2": "fetch", "never": "fetch"}
    said = spark.createDataFrame([(200,), (404,), (503,), (None,)], "s int").select(web.robots_status(F.col("s")).alias("x")).collect()
    assert [r.x for r in said] == ["ok", "missing", "error", "error"]


SITE = {
    "https://a.example/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret\nCrawl-delay: 2\nSitemap: https://a.example/map.xml"),
    "https://a.example/map.xml": (200, "application/xml", "<urlset><url><loc>https://a.example/mapped</loc></url></urlset>"),
    "https://a.example/": (200, "text/html", "<title>Home</title><p>words of the first page that are many enough<a href='/two'>two</a><a href='/secret/x'>no</a><a href='https://b.example/far'>far</a><a href='/moved'>m</a>"),
    "https://a.example/two": (200, "text/html", "<title>Two</title><p>another text with quite other words in it, and a link <a href='/'>home</a>"),
    "https://a.example/mapped": (200, "text/html", "<title>Mapped</title><p>found by the map alone, nothing links here at all"),
    "https://b.example/far": (200, "text/html", "<title>Two</title><p>another text with quite other words in it, and a link <a href='/'>home</a>"),
}


def test_the_loop_crawls_a_small_web(spark):
    def fetch(asked):
        rows = []
        for r in asked.collect():
            status, kind, body = SITE.get(r.url, (404, None, None))
            if r.url.endswith("/moved"):
                status, body = 301, None
            rows.append((r.url, status, kind, "/two" if status == 301 else None, None, None, body))
        return spark.createDataFrame(rows, "url string, status int, content_type string, location string, etag string, last_modified string, body string")

    from larkspur.operators.cycle import CrawlLoop

    loop = CrawlLoop(spark, scratch_path(spark, "loop"), fetch)
    loop.add(["https://A.example", "mailto:nobody"])
    assert loop.cycle(NOW) == 1
    assert {r.url for r in loop.table("queue").collect()} == {"https://a.example/map.xml", "https://a.example/two", "https://a.example/secret/x", "https://b.example/far", "https://a.example/moved"}
    assert loop.cycle(NOW + timedelta(seconds=1)) == 1  # b only: a has to rest for two seconds
    assert loop.run(NOW + timedelta(seconds=3), 8, timedelta(seconds=3)) >= 5
    pages = {r.url: r for r in loop.table("pages").collect()}
    assert {u: p.status for u, p in pages.items()} == {"https://a.example/": "ok", "https://b.example/far": "ok", "https://a.example/two": "duplicate", "https://a.example/mapped": "ok"}
    assert pages["https://a.example/two"].duplicate_of == "https://b.example/far" and pages["https://a.example/mapped"].depth == 1 and pages["https://a.example/"].fetch_count == 1
    assert {(r.source_url[-8:], r.target_url[-8:]) for r in loop.table("links").collect()} >= {(".example"[1:] + "/", "mple/two")}
    hosts = {r.host: r for r in loop.table("hosts").collect()}
    assert hosts["a.example"].page_count == 3 and hosts["a.example"].robots_status == "ok" and hosts["b.example"].robots_status == "missing"
    events = loop.table("counters").groupBy("event").agg(F.sum("n").alias("n")).collect()
    assert {r.event: r.n for r in events}["indexed"] == 3 and loop.table("queue").count() == 0
