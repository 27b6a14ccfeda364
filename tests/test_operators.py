"""Core operators against brute force and small worked cases."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import crawl, graph, index, learning, logs, search
from larkspur.operators.incremental import IncrementalTarget
from larkspur.operators.ranking import ranked
from larkspur.operators.skew import spread_join, spread_semi_join
from larkspur.plans.api import Engine
from larkspur.plans.query import parse
from larkspur.schema import SCHEMAS, WEIGHTS
from larkspur.session import scratch_path
from larkspur.sources import web

NOW = datetime(2026, 4, 1, tzinfo=timezone.utc)


def test_ranked_is_a_row_number_of_any_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"), (F.col("id") * 7 % 100).alias("v"))
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    want = rows.select("id", F.row_number().over(w).cast("long").alias("rank"), F.sum("id").over(w).alias("upto"))
    got = ranked(rows, ["g"], [F.col("v").desc(), F.col("id").asc()], running={"upto": "id"}).select("id", "rank", "upto")
    assert got.count() == 3000 and not got.exceptAll(want).count()
    assert ranked(rows.where("false"), ["g"], [F.col("id").asc()]).count() == 0


def test_spread_joins_are_joins(spark):
    rows = spark.createDataFrame([(i, ["hot", "a", "b", None][min(i % 7, 3)] if i % 7 < 4 else "hot", "x") for i in range(700)], "i int, k string, _salt string")
    table = spark.createDataFrame([("hot", 400, 1.5), ("a", 100, 2.5), ("none", 9, 3.5), (None, 5, 4.5)], "k string, n int, v double")
    got = sorted((r.i, r.k, r._salt, r.v) for r in spread_join(rows, table, ["k"], "n", "i", piece=30).collect())
    want = sorted((r.i, r.k, r._salt, r.v) for r in rows.join(table, "k").collect())
    assert got == want and len(got) == 500
    assert spread_semi_join(rows, table, ["k"], "n", "i", piece=30).count() == 500 and spread_semi_join(rows, table.where("false"), ["k"], "n", "i").count() == 0


def _changes(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, v_extra string")


def test_incremental_takes_each_state_once(spark):
    t = IncrementalTarget(spark, scratch_path(spark, "inc"), "k", "v")
    t.run(_changes(spark, [("a", 1, ""), ("b", 1, ""), ("b", 1, ""), (None, 5, ""), ("c", None, "")]), 1)
    with pytest.raises(RuntimeError):
        t.run(_changes(spark, [("a", 2, ""), ("d", 1, "")]), 2, before_publish=lambda: (_ for _ in ()).throw(RuntimeError("lost")))
    assert t.manifest().version == 1
    t.run(_changes(spark, [("a", 2, ""), ("d", 1, ""), ("b", 0, "late"), ("b", 1, "again")]), 3)
    t.run(_changes(spark, []), 4)
    got = sorted((r.run_id, r.key, r.version) for r in t.rows().collect())
    assert got == [(1, "a", 1), (1, "b", 1), (3, "a", 2), (3, "d", 1)]


def test_incremental_refuses_a_second_publisher(spark):
    path = scratch_path(spark, "inc")
    one, two = (IncrementalTarget(spark, path, "k", "v") for _ in range(2))
    with pytest.raises(Exception, match="exist|another run"):
        one.run(_changes(spark, [("a", 1, "")]), 1, before_publish=lambda: two.run(_changes(spark, [("b", 1, "")]), 2))
    assert [r.key for r in one.rows().collect()] == ["b"]


def test_incremental_takes_what_turns_up_late(spark):
    day = lambda n: datetime(2026, 1, n, tzinfo=timezone.utc)
    rows = [("a", 1, day(1)), ("b", 1, day(5))]
    make = lambda x: spark.createDataFrame(x, "k string, v int, at timestamp")
    t = IncrementalTarget(spark, scratch_path(spark, "inc"), "k", "v", compact_after=2)
    t.run(make(rows), 1, "at", day(5))
    t.run(make([*rows, ("late", 1, day(4)), ("next", 1, day(7))]), 2, "at", day(6))
    for n in (3, 4):
        t.run(make([*rows, ("late", 1, day(4)), ("next", 1, day(7))]), n, "at", day(n + 4))
    got = sorted((r.run_id, r.key) for r in t.rows().collect())
    assert got == [(1, "a"), (1, "b"), (2, "late"), (3, "next")] and len(t.manifest().parts) <= 2
    left = t.vacuum(older_than=-60)
    assert left >= 1 and sorted((r.run_id, r.key) for r in t.rows().collect()) == got and t.vacuum(older_than=-60) == 0


PAGES = [
    ("1", "https://a.example/swift", "a.example", "Swift guide", "intro", "Swift", "Swift server side programming with Vapor", "en"),
    ("2", "https://a.example/python", "a.example", "Python", "", "", "Python and Swift compared", "en"),
    ("3", "https://b.example/ja", "b.example", "検索エンジン", "", "", "async await Swift で検索", "ja"),
    ("4", "https://c.example/x", "c.example", "Other", "", "", "nothing here; SwiftUI", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    pages = spark.createDataFrame(PAGES, "id string, url string, host string, title string, description string, headings string, content string, language string")
    for c, v, k in (("status", "ok", "string"), ("page_rank", 0.25, "double"), ("clicks", 1, "int"), ("impressions", 5, "int"), ("changed_at", "2026-03-31", "timestamp"), ("next_crawl_at", "2026-03-31", "timestamp")):
        pages = pages.withColumn(c, F.lit(v).cast(k))
    links = spark.createDataFrame([("l1", "https://b.example/ja", "b.example", "https://a.example/swift", "a.example", "great tutorial"), ("l2", "https://a.example/swift", "a.example", "https://a.example/swift", "a.example", "self")], SCHEMAS["links"])
    return empty | {"pages": pages.unionByName(pages.limit(1)), "links": links}


def find(tables, text, **kw):
    src = index.index_sources(tables["pages"], tables["links"], tables["hosts"])
    rows = search.search(src, index.tokenized(src), parse(text), NOW, **kw).orderBy("rank").collect()
    return [r.page_id for r in rows]


def test_search_filters(tables):
    assert set(find(tables, "swift")) == {"1", "2", "3", "4"}  # SwiftUI is also swift and ui
    assert set(find(tables, "swift -SwiftUI")) == {"1", "2", "3"}
    assert set(find(tables, "swift -python")) == {"1", "3", "4"}
    assert set(find(tables, "swift site:a.example")) == {"1", "2"}
    assert set(find(tables, "swift lang:en")) == {"1", "2"}
    assert find(tables, '"async await"') == ["3"]
    assert find(tables, "検索エンジン")[0] == "3"
    assert find(tables, "tutorial") == ["1"]  # by anchor text only
    assert find(tables, "-swift site:a.example") == []
    assert find(tables, "swift", page=2, per=2) == find(tables, "swift")[2:]


def test_scores_do_not_depend_on_partitions(spark, tables):
    src = index.index_sources(tables["pages"], tables["links"], tables["hosts"])
    tok = index.tokenized(src)
    q = parse("swift server")
    posts = index.postings(tok)
    some = [sorted((r.page_id, round(r.bm25, 12)) for r in search.bm25(p, index.corpus_stats(t, s), q).collect()) for p, t, s in ((posts, tok, src), (posts.repartition(7), tok.repartition(3), src.repartition(5)), (index.matching_postings(tok, q.terms), tok, src))]
    assert some[0] == some[1] == some[2] and len(some[0]) == 4


def test_crowding(spark):
    rows = spark.createDataFrame([("a1", "a", 5.0), ("a2", "a", 4.0), ("a3", "a", 3.0), ("b1", "b", 2.0)], "url string, host string, score double")
    assert [r.url for r in search.diversified(rows).orderBy("rank").collect()] == ["a1", "a2", "b1", "a3"]


def test_pagerank(spark):
    nodes = spark.createDataFrame([(x,) for x in ("home", "a", "b", "c")], "id string")
    edges = spark.createDataFrame([("home", "a"), ("home", "b"), ("home", "c"), ("a", "home"), ("b", "home"), ("c", "home"), ("a", "b"), ("a", "b"), ("a", "a"), ("x", "a"), (None, "a")], "src string, dst string")
    got = {r.id: r.rank for r in graph.pagerank(nodes, edges, iterations=60).collect()}
    assert got == pytest.approx({"home": 0.4423239584, "b": 0.2320257983, "a": 0.1628251217, "c": 0.1628251217}, abs=1e-7)
    assert graph.pagerank(nodes.where("false"), edges).count() == 0


def _impression(spark, n, features):
    rows = [("i", {"results": [(f"u{p}", p, f) for p, f in zip(range(1, n + 1), features, strict=True)]})]
    return spark.createDataFrame(rows, "id string, payload struct<results:array<struct<url:string,position:int,features:array<double>>>>")


def test_skip_above(spark):
    shown = _impression(spark, 4, [[float(p)] * 12 for p in range(1, 5)])
    clicks = spark.createDataFrame([("c", "i", 3, "u3"), ("c", "i", 3, "u3"), ("d", "other", 1, "u1")], "id string, impression_id string, position int, url string")
    got = sorted(r.difference[0] for r in learning.skip_above_pairs(shown.union(shown), clicks).collect())
    assert got == [-1.0, 1.0, 2.0]
    broken = _impression(spark, 3, [None, [1.0] * 12, [float("nan")] * 12])
    assert learning.skip_above_pairs(broken, clicks).count() == 0


def test_training_improves(spark):
    pairs = spark.createDataFrame([([-0.5] + [0.0] * 9 + [1.0, 0.0],)] * 200, "difference array<double>")
    after = learning.train(pairs)
    assert after[10] > WEIGHTS[10] and learning.pair_accuracy(pairs, after).first().accuracy == 1.0
    assert learning.train(pairs.where("false")) == WEIGHTS and learning.pair_accuracy(pairs.where("false")).first().accuracy == 0.0


def test_suggest_and_clicks(spark):
    rows = spark.createDataFrame([(str(i), "50%_off" if i < 6 else "other") for i in range(9)], "id string, normalized_query string")
    assert [r.normalized_query for r in logs.suggest(rows, "50%").collect()] == ["50%_off"]
    assert logs.suggest(rows, " ").count() == 0 and logs.suggest(rows, "oth").count() == 0


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: nobody\nDisallow: /private/ # secret\nAllow: /private/public.html\nDisallow: /*.pdf$\nDisallow:\nCrawl-delay: 2\nSitemap: https://a.example/map.xml"


def test_robots(spark):
    hosts = spark.createDataFrame([("o", ROBOTS), ("named", "User-agent: larkspur\nDisallow: /x\nUser-agent: *\nDisallow: /"), ("empty", ""), ("none", None)], "origin string, txt string")
    rules = web.robots_rules(hosts, "origin", "txt")
    assert {r.origin: r.delay for r in rules.collect()}["o"] == 2.0
    cases = {"/": True, "/private/secret.html": False, "/private/public.html": True, "/docs/file.pdf": False, "/docs/file.pdf?download=1": True, "/robots.txt": True}
    paths = spark.createDataFrame([("o", p) for p in cases] + [("named", "/x1"), ("named", "/y"), ("empty", "/"), ("unknown", "/")], "origin string, path string")
    got = {(r.origin, r.path): r.allowed for r in web.robots_allowed(paths, rules).collect()}
    assert {p: got["o", p] for p in cases} == cases
    assert (got["named", "/x1"], got["named", "/y"], got["empty", "/"], got["unknown", "/"]) == (False, True, True, True)


@pytest.mark.parametrize(("pattern", "path", "hit"), [("/a*b", "/a/x/b/c", True), ("/a*b$", "/a/x/b/c", False), ("/a*b$", "/a/x/b", True), ("/b", "/a/b", False), ("/a.b", "/aXb", False), ("/\\E", "/\\E", True)])
def test_robots_patterns(spark, pattern, path, hit):
    row = spark.createDataFrame([(pattern, path)], "p string, x string").select(F.regexp_like("x", web.pattern_regex(F.col("p"))).alias("y")).first()
    assert row.y == hit


HTML = """<html lang="en"><head><title> A &amp; B </title><meta name="description" content=" about "><meta name="robots" content="noindex">
<link rel="canonical" href="/canon"><base href="/base/"></head><body><nav>menu <a href="/nav">nav</a></nav><main><h1>Head</h1><p>One<p><b>two &lt;3<script>no()</script><a href="x">x</a>
<a href="x">more</a> <a rel="nofollow" href="https://b.example/#f">b</a><a href="mailto:q@b.example">m</a></main><footer>foot</footer></body>"""


def test_html(spark):
    rows = spark.createDataFrame([("https://a.example/p", HTML), ("https://a.example/q", "<p>no title<h1>First</h1><header>gone</header>rest"), ("https://a.example/e", ""), ("https://a.example/n", None)], "u string, h string")
    got = {r.url[-1]: r for r in web.extract_pages(rows, "u", "h").collect()}
    p = got["p"]
    assert (p.title, p.description, p.language, p.headings, p.content, p.canonical, p.noindex, p.nofollow) == ("A & B", "about", "en", ["Head"], "Head One two <3x more bm", "https://a.example/canon", True, False)
    assert [(x.url, x.text, x.nofollow) for x in p.links] == [("https://a.example/nav", "nav", False), ("https://a.example/base/x", "x more", False), ("https://b.example/", "b", True)]
    assert (got["q"].title, got["q"].content) == ("First", "no title First rest")
    assert got["e"].title == "" and "n" not in got


def test_sitemap(spark):
    xml = "<sitemapindex><sitemap><loc> https://a.example/1 </loc></sitemap><sitemap><loc></loc></sitemap><loc>https://a.example/?a=1&amp;b=2</loc></sitemapindex>"
    locs, is_index = web.sitemap(F.col("x"))
    row = spark.createDataFrame([(xml,)], "x string").select(locs.alias("l"), is_index.alias("i")).first()
    assert row.l == ["https://a.example/1", "https://a.example/?a=1&b=2"] and row.i


def test_near_duplicates_have_one_leader(spark):
    base = 0b1011 << 40
    chain = [(base, 1), (base ^ 0b111, 2), (base ^ 0b111111, 3), (1 << 60, 4), (base, 9)]
    rows = spark.createDataFrame(chain, "simhash long, n int").withColumn("fetched_at", F.timestamp_seconds("n"))
    got = {r.simhash: r.original for r in crawl.near_duplicates(rows).collect()}
    assert got == {base ^ 0b111: base}  # the third is three bits from a duplicate, six from the original


def test_versions_and_refresh(spark):
    rows = spark.createDataFrame([("a", 1, 1, "ok"), ("a", 2, 1, "gone"), ("b", 1, 5, "ok"), ("b", 1, 4, "gone"), (None, 9, 9, "ok")], "id string, v int, seq int, status string")
    new = crawl.latest_versions(rows, "id", F.col("v"), F.col("seq"))
    assert sorted((r.id, r.v, r.status) for r in new.collect()) == [("a", 2, "gone"), ("b", 1, "ok")]
    old = spark.createDataFrame([("a", 1), ("c", 1)], "id string, v int")
    assert sorted(r.id for r in crawl.refreshed(old, new, "id", F.col("status") == "ok").collect()) == ["b", "c"]


def test_frontier(spark):
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    rows = spark.createDataFrame([("a", "a1", 1, 0, "page", 1), ("a", "a0", 0, 0, "page", 2), ("b", "b", 0, 0, "page", 3), ("c", "c", 5, 0, "sitemap", 4), ("c", "c2", 0, 0, "page", 5), (None, "n", 0, 0, "page", 6)], "origin string, url string, depth int, retries int, kind string, seq long")
    rows = rows.withColumn("next_allowed_at", F.when(F.col("origin") == "b", ts(4_000_000_000)))
    assert sorted((r.origin, r.url) for r in crawl.frontier_picks(rows, NOW).collect()) == [("a", "a0"), ("c", "c")]
    assert crawl.frontier_stats(rows, NOW).first().asDict() == {"origins": 3, "ready": 2, "queued": 5}


def test_engine(spark, tables):
    e = Engine(spark, tables, clock=lambda: NOW)
    assert e.search("swift server")[0]["page_id"] == "1" and e.search("swift server") is e.search("swift server")
    assert e.status()["pages_ok"] == 4 and e.page("1")["headings"] == ["Swift"] and e.page("zz") is None
    e.add_seed("s1", "https://A.example")
    e.add_seed("s2", "https://a.example/")
    assert [(r.id, r.url) for r in e.seeds().collect()] == [("s1", "https://a.example/")]
    e.remove_seed("s1")
    assert e.seeds().count() == 0 and e.pages("A.example").count() == 2
    with pytest.raises(ValueError):
        e.search(" ")
