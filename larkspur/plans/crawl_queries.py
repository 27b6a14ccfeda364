"""Queries over crawl state."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.urls import host_key, normalize_url, origin
from larkspur.operators import crawl
from larkspur.plans import duck
from larkspur.session import table
from larkspur.sources import web

NOW = datetime(2026, 4, 1, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMPTZ '2026-04-01 00:00:00+00'"
LATER, LATER_SQL = datetime(2026, 4, 1, 0, 9, tzinfo=timezone.utc), "TIMESTAMPTZ '2026-04-01 00:09:00+00'"
AGENT = "larkspur"
ROBOTS_AT, ROBOTS_AT_SQL = datetime(2026, 3, 20, tzinfo=timezone.utc), "TIMESTAMPTZ '2026-03-20 00:00:00+00'"


def revisit_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next interval of every page, had it changed and had it not."""
    p = table(spark, sf_dir, "pages").select("id", "revisit_interval").distinct()
    prev = F.col("revisit_interval")
    return p.select("id", F.round(crawl.next_interval(prev, F.lit(True)), 6).alias("if_changed"), F.round(crawl.next_interval(prev, F.lit(False)), 6).alias("if_same"))


def due_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that are due, at most 5000, the longest waiting first."""
    return crawl.due(table(spark, sf_dir, "pages"), NOW).select("id", "url")


def purge_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages gone for long and how many links go with each."""
    pages, links = crawl.purged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "links"), NOW)
    n = links.select("id", "source_url").dropDuplicates(["id"]).groupBy("source_url").agg(F.count(F.lit(1)).alias("links"))
    return pages.join(n, pages["url"] == n["source_url"], "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def host_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 pages of each host by fetch time."""
    rows = table(spark, sf_dir, "pages").select("id", host_key(F.col("host")).alias("host"), "fetched_at").dropDuplicates(["id"])
    return crawl.first_per_key(rows, "host", [F.col("fetched_at").asc_nulls_last(), F.col("id").asc()], 20).select("id", "host")


def host_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each host."""
    return table(spark, sf_dir, "pages").select("id", host_key(F.col("host")).alias("host")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("page_count"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivered state of each page."""
    rows = table(spark, sf_dir, "page_changes").select("id", "change_seq", "status", "fetch_count", F.coalesce("updated_at", "delivered_at").alias("at"))
    return crawl.latest_versions(rows, "id", F.col("at"), F.col("change_seq")).select("id", "change_seq", "status", F.col("fetch_count").cast("long").alias("fetch_count"))


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of early deliveries after the later ones were applied: replaced, or removed if no longer ok."""
    rows = table(spark, sf_dir, "page_changes").select("id", "change_seq", "status", "version_hash", "delivered_at", F.coalesce("updated_at", "delivered_at").alias("at"))
    cut = F.lit(datetime(2026, 3, 15, tzinfo=timezone.utc))
    old = crawl.latest_versions(rows.where(F.col("delivered_at") <= cut), "id", F.col("at"), F.col("change_seq")).where("status = 'ok'")
    new = crawl.latest_versions(rows.where(F.col("delivered_at") > cut), "id", F.col("at"), F.col("change_seq"))
    return crawl.refreshed(old.select("id", "version_hash"), new, "id", F.col("status") == "ok")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pages by status, pages due, hosts and links."""
    return crawl.status_rows(table(spark, sf_dir, "pages"), table(spark, sf_dir, "hosts"), table(spark, sf_dir, "links"), NOW)


def pages_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second twenty pages of a host by rank."""
    rows = table(spark, sf_dir, "pages").where(host_key(F.col("host")) == "www.lantern-harbor.example").select("id", "url", F.when(~F.isnan("page_rank"), F.col("page_rank")).alias("r"), "revisit_interval").dropDuplicates(["id"])
    return rows.orderBy(F.col("r").desc_nulls_last(), "url", "id").offset(20).limit(20).select("id", "url", F.round(F.col("revisit_interval") / 3600, 6).alias("hours"))


def page_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of every page as a list, with its number of outgoing and incoming links."""
    links = table(spark, sf_dir, "links").select("id", "source_url", "target_url").dropDuplicates(["id"])
    out, into = (links.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("url")).agg(F.least(F.count(F.lit(1)), F.lit(200)).alias(n)) for c, n in (("source_url", "outgoing"), ("target_url", "incoming")))
    pages = table(spark, sf_dir, "pages").select("id", "url", F.size(F.filter(F.split(F.coalesce("headings", F.lit("")), "\n"), lambda h: h != "")).cast("long").alias("headings")).distinct()
    return pages.join(out, "url", "left").join(into, "url", "left").select("id", "headings", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the content of an earlier page."""
    return crawl.exact_duplicates(table(spark, sf_dir, "pages"))


def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a text: its SimHash, the document that leads its class, the bits between and its links within three bits."""
    from larkspur.functions.hashing import simhash_of
    from larkspur.functions.text import tokenize
    from larkspur.session import written

    rows = written(table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "fetched_at", tokenize(F.col("text")).alias("t")), "tokens")
    hashed = written(rows.select("doc_id", "fetched_at", simhash_of("t").alias("simhash")), "simhash")
    return crawl.near_duplicate_pages(hashed, "doc_id")


def frontier_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each ready origin gives next."""
    return crawl.frontier_picks(table(spark, sf_dir, "frontier"), LATER).select("origin", "url", "seq", F.col("priority").cast("long").alias("priority"))


def frontier_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals of addresses that are no pages yet."""
    return crawl.frontier_new(table(spark, sf_dir, "frontier"), table(spark, sf_dir, "pages")).select("url", "seq", "origin")


def frontier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins, ready origins and queued entries."""
    return crawl.frontier_stats(table(spark, sf_dir, "frontier"), NOW)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.robots_rules(table(spark, sf_dir, "hosts"), "origin", "robots_txt", AGENT)


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that hold for us on every origin."""
    return _rules(spark, sf_dir).select("origin", "allow", "pattern", "delay", F.array_join("sitemaps", " ").alias("sitemaps"))


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether robots.txt lets us fetch each page."""
    url = F.col("u")
    rows = table(spark, sf_dir, "pages").select(normalize_url(F.col("url")).alias("u")).where("u IS NOT NULL").distinct()
    urls = rows.select(origin(url).alias("origin"), F.regexp_replace(url, "^https?://[^/]+", "").alias("path"))
    return web.robots_allowed(urls, _rules(spark, sf_dir))


def politeness_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between requests to each origin: plain, after a failed fetch and after a busy answer."""
    rows = _rules(spark, sf_dir).select("origin", "delay").distinct()
    return rows.select("origin", *[F.round(crawl.politeness(F.col("delay"), F.lit(float(x))), 6).alias(n) for n, x in (("plain", 1), ("failed", 4), ("busy", 8))])


def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to be tried again, with one retry more, up to three: all of the frontier that have retries left."""
    rows = table(spark, sf_dir, "frontier").select("seq", "retries", "depth", "kind").distinct()
    return rows.where(F.col("retries") < 3).select("seq", (F.col("retries") + 1).cast("long").alias("retries"), crawl.priority(F.col("kind"), F.col("depth"), F.col("retries") + 1).cast("long").alias("priority"))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a sitemap made from each host's first pages, read back."""
    rows = table(spark, sf_dir, "pages").select(host_key(F.col("host")).alias("host"), "url").where("url IS NOT NULL").distinct()
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    locs, is_index = web.sitemap(xml)
    return rows.select("host", F.explode(locs).alias("url"), is_index.alias("is_index"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as HTML and extracted again: title, language, number of headings and text."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, sf_dir, "pages").select("url", "title", "content", "language").where("url IS NOT NULL").dropDuplicates(["url"])
    html = F.concat(
        F.lit("<html lang='"), F.coalesce("language", F.lit("")), F.lit("'><head><title>"), esc(F.col("title")), F.lit("</title><script>var x = 1;</script></head><body><nav>Menu <a href='/'>home</a></nav><h1>"),
        esc(F.col("title")), F.lit("</h1><p>"), esc(F.col("content")), F.lit("<footer>foot</footer></body></html>"),
    )
    got = web.extract_pages(rows.select("url", html.alias("html")), "url", "html")
    return got.select("url", "title", "language", F.size("headings").cast("long").alias("headings"), F.md5("content").alias("content"), F.size("links").cast("long").alias("links"))


def _escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as HTML with description, robots, canonical address and headings, and extracted again."""
    rows = table(spark, sf_dir, "pages").select("url", "description", "status", "headings").where("url IS NOT NULL").dropDuplicates(["url"])
    heads = F.transform(F.split(F.coalesce("headings", F.lit("")), "\n", -1), lambda h: F.concat(F.lit("<h2>"), _escaped(h), F.lit("</h2>")))
    robots = F.when(F.col("status") == "noindex", "NoIndex").when(F.col("status") == "duplicate", "none").when(F.col("status") == "gone", "nofollow").otherwise("all")
    html = F.concat(
        F.lit("<html><head><title>t</title><meta name='description' content='"), _escaped(F.col("description")), F.lit("'><meta name='robots' content='"), robots, F.lit("'><link rel='canonical' href='"), _escaped(F.col("url")),
        F.lit("'></head><body><main>"), F.array_join(heads, ""), F.lit("</main></body></html>"),
    )
    got = web.extract_pages(rows.select("url", html.alias("html")), "url", "html")
    return got.select("url", "description", "canonical", "noindex", "nofollow", F.array_join("headings", " | ").alias("headings"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page written as HTML, extracted again: resolved, normalised and merged by target."""
    links = table(spark, sf_dir, "links").where("source_url IS NOT NULL AND target_url IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id"])
    rel = F.when(F.md5("id") < "4", F.lit(" rel='nofollow'")).otherwise(F.lit(""))
    anchor = F.concat(F.lit("<a href=' "), _escaped(F.col("target_url")), F.lit("'"), rel, F.lit(">"), _escaped(F.col("anchor_text")), F.lit("</a>"))
    pages = links.groupBy(F.col("source_url").alias("url")).agg(F.array_sort(F.collect_list(F.struct("id", anchor.alias("a")))).alias("all"))  # a page's links
    html = F.concat(F.lit("<base href='/'><body>"), F.array_join(F.transform("all", lambda x: x["a"]), " "))
    got = web.extract_pages(pages.select("url", html.alias("html")), "url", "html")
    return got.select(F.col("url").alias("page"), F.inline("links"))


def robots_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every origin at a moment, and until when."""
    rows = web.robots_policy(table(spark, sf_dir, "hosts"), ROBOTS_AT)
    return rows.select("origin", "policy", F.unix_micros("expires_at").alias("expires_us"))


def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page may be fetched at that moment, hosts that are blocked or could not be read included."""
    url = F.col("u")
    rows = table(spark, sf_dir, "pages").select(normalize_url(F.col("url")).alias("u")).where("u IS NOT NULL").distinct()
    urls = rows.select(origin(url).alias("origin"), F.regexp_replace(url, "^https?://[^/]+", "").alias("path"))
    return web.robots_verdict(urls, table(spark, sf_dir, "hosts"), ROBOTS_AT, AGENT)


def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sitemaps to read of every origin."""
    listed = _rules(spark, sf_dir).select(F.col("origin").alias("_o"), "sitemaps").dropDuplicates(["_o"])
    rows = table(spark, sf_dir, "hosts").select("origin").where("origin IS NOT NULL").distinct().join(listed, F.col("origin") == F.col("_o"), "left")
    return rows.select("origin", F.explode(web.sitemaps_to_read(F.col("origin"), F.col("sitemaps"))).alias("sitemap"))


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue entries from sitemaps that are made of the pages of each origin, 16 to an origin of which one is an index; in each the first 50 addresses count."""
    from larkspur.functions.hashing import bucket, url_hash
    from larkspur.schema import Settings

    rows = table(spark, sf_dir, "pages").select(normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    rows = rows.select(origin(F.col("url")).alias("origin"), "url", F.pmod(bucket(url_hash("url")), F.lit(16)).alias("part"))
    loc = F.concat(F.lit("<loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    parts = rows.groupBy("origin", "part").agg(F.array_join(F.array_sort(F.collect_list(loc)), "").alias("locs"))
    kind = F.when(F.col("part") == 0, "sitemapindex").otherwise("urlset")
    maps = parts.select("origin", F.pmod("part", F.lit(3)).alias("depth"), F.concat(F.lit("<"), kind, F.lit(">"), "locs", F.lit("</"), kind, F.lit(">")).alias("xml"))
    return web.sitemap_entries(maps, "xml", Settings(urls_per_sitemap=50)).select("origin", "url", F.col("depth").cast("long").alias("depth"), "kind")


def page_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the class of their title and content: the page that leads it, the bits between and the links within three bits."""
    from larkspur.functions.hashing import simhash_of
    from larkspur.functions.text import tokenize
    from larkspur.session import written

    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = table(spark, sf_dir, "pages").where("id IS NOT NULL AND status NOT IN ('gone', 'noindex')").dropDuplicates(["id"])
    rows = written(rows.select("id", "fetched_at", tokenize(text).alias("t")), "tokens")
    hashed = written(rows.select("id", "fetched_at", simhash_of("t").alias("simhash")), "simhash")
    return crawl.near_duplicate_pages(hashed, "id")


def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and URL of each page as one text and taken apart again."""
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL AND simhash IS NOT NULL").select("id", "url", "simhash").distinct()
    rows = rows.select("id", crawl.duplicate_member(F.col("simhash"), F.col("url")).alias("member"))
    return rows.select("id", "member", *[c.alias(n) for n, c in zip(("hash", "url"), crawl.parsed_member(F.col("member")), strict=True)])


QUERIES = {
    f.__name__: f
    for f in (
        revisit_interval, due_pages, purge_gone, host_page_cap, host_page_count, latest_version, incremental_refresh, status_counts, pages_list, page_detail, exact_dups, near_dups, frontier_pick,
        frontier_dedupe, frontier_stats, robots_rules, robots_allowed, politeness_delay, retry_queue, sitemap_urls, html_extract, html_meta, html_links, robots_policy, robots_verdict, sitemap_discovery, sitemap_entries, page_dups, duplicate_members,
    )
}

_H = duck.host_key("host")
_CHANGES = "c AS (SELECT id, change_seq, status, version_hash, fetch_count, delivered_at, coalesce(updated_at, delivered_at) AS seen_at FROM page_changes WHERE id IS NOT NULL)"
_NEW = "CASE WHEN {p} IS NULL OR isnan({p}) OR {p} <= 0 THEN 604800.0 ELSE {p} * {f} END"
_INTERVAL = lambda f: "round(least(greatest(" + _NEW.format(p="revisit_interval", f=f) + ", 86400.0), 7776000.0), 6)"
_PRIORITY = "CASE WHEN kind = 'sitemap' THEN -1 ELSE depth + 2 * retries END"
_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '" + duck.SPACES.replace("\\x{feff}", "\\x{1c}-\\x{1f}") + "+', ' ', 'g'))"

_FAR = "TIMESTAMPTZ '9999-12-31 00:00:00+00'"
# robots.txt line by line: groups are numbered, those that name the agent hold, else those for all
_RULES = f"""
txt AS (SELECT origin, any_value(robots_txt) AS txt FROM hosts WHERE robots_txt IS NOT NULL GROUP BY origin),
lines AS (SELECT origin, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT origin, list_transform(regexp_split_to_array(txt, '\\r\\n|\\n|\\r'), lambda l: split_part(l, '#', 1)) AS x FROM txt)),
pairs AS (SELECT origin, i, lower(trim(split_part(line, ':', 1))) AS k, trim(regexp_extract(line, '(?s):(.*)$', 1)) AS v FROM lines WHERE contains(line, ':')),
starts AS (SELECT *, k = 'user-agent' AND coalesce(lag(k) OVER (PARTITION BY origin ORDER BY i), '') <> 'user-agent' AS start FROM pairs),
grouped AS (SELECT *, sum(CAST(start AS INTEGER)) OVER (PARTITION BY origin ORDER BY i) AS grp FROM starts),
agents AS (SELECT origin, grp, bool_or(lower(v) = '{AGENT}') AS named, bool_or(v = '*') AS star FROM grouped WHERE k = 'user-agent' GROUP BY origin, grp),
held AS (SELECT origin, grp FROM (SELECT *, bool_or(named) OVER (PARTITION BY origin) AS any_named FROM agents) WHERE CASE WHEN any_named THEN named ELSE star END),
delays AS (SELECT origin, max(try_cast(v AS DOUBLE)) AS delay FROM grouped JOIN held USING (origin, grp) WHERE k = 'crawl-delay' GROUP BY origin),
own AS (SELECT origin, k = 'allow' AS allow, v AS pattern FROM grouped JOIN held USING (origin, grp) WHERE k IN ('allow', 'disallow') AND v <> ''),
maps AS (SELECT origin, string_agg(v, ' ' ORDER BY i) AS sitemaps FROM pairs WHERE k = 'sitemap' AND v <> '' GROUP BY origin),
rules AS (SELECT origin, allow, pattern, delay, coalesce(sitemaps, '') AS sitemaps FROM txt LEFT JOIN own USING (origin) LEFT JOIN delays USING (origin) LEFT JOIN maps USING (origin))"""
_PATTERN = r"'(?s)^' || replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([\\.^$+?()\[\]{}|])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END"

_EXPIRES = "(SELECT origin, any_value(blocked) AS blocked, any_value(robots_status) AS robots_status, any_value(robots_fetched_at) + CASE WHEN any_value(robots_status) = 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END AS e FROM hosts WHERE origin IS NOT NULL GROUP BY origin)"

_DOCUMENTS = f"SELECT doc_id, {duck.tokens('text')} AS t FROM (SELECT doc_id, any_value(text) AS text FROM documents WHERE text <> '' GROUP BY doc_id)"
_PAGES = f"SELECT id, {duck.tokens('text')} AS t FROM (SELECT id, any_value(coalesce(title, '') || chr(10) || coalesce(content, '')) AS text FROM pages WHERE id IS NOT NULL AND status NOT IN ('gone', 'noindex') GROUP BY id)"


def _classes(ident: str, source: str) -> str:
    """The classes of the SimHashes in ``sim``: leaders one after the other in order of first fetch, as far as a hash has neighbours at all."""
    return f"""
d AS (SELECT {ident}, h, coalesce(fetched_at, {_FAR}) AS seen_at FROM sim JOIN (SELECT {ident}, any_value(fetched_at) AS fetched_at FROM {source} GROUP BY {ident}) USING ({ident})),
g AS (SELECT h, min(seen_at) AS seen_at, count(*) AS copies, arg_min({ident}, {{'a': seen_at, 'b': {ident}}}) AS leader FROM d GROUP BY h),
near AS (SELECT x.h AS a, y.h AS b, y.copies AS copies FROM g x JOIN g y ON x.h <> y.h AND bit_count(xor(x.h, y.h)) <= 3),
o AS (SELECT h, row_number() OVER (ORDER BY seen_at, {duck.signed('h')}) AS n FROM g WHERE h IN (SELECT a FROM near)),
w(n, leads) AS (
  SELECT 0::BIGINT, CAST([] AS UBIGINT[]) UNION ALL
  SELECT o.n, CASE WHEN len(list_filter(leads, lambda l: bit_count(xor(l, h)) <= 3)) > 0 THEN leads ELSE list_append(leads, h) END FROM w JOIN o ON o.n = w.n + 1
), fin AS (SELECT arg_max(leads, n) AS leads FROM w),
c AS (SELECT h, leader, copies, coalesce(CASE WHEN h IN (SELECT a FROM near) THEN list_filter(leads, lambda l: bit_count(xor(l, h)) <= 3)[1] END, h) AS first FROM g, fin)
SELECT {ident}, {duck.signed('d.h')} AS simhash, l.leader AS leader, CAST(bit_count(xor(d.h, c.first)) AS INTEGER) AS bits, CAST(c.copies - 1 + coalesce(r.around, 0) AS BIGINT) AS links
FROM d JOIN c ON c.h = d.h JOIN g l ON l.h = c.first LEFT JOIN (SELECT a, sum(copies) AS around FROM near GROUP BY a) r ON r.a = d.h"""


ORACLE = {
    "revisit_interval": f"SELECT DISTINCT id, {_INTERVAL('0.5')} AS if_changed, {_INTERVAL('1.5')} AS if_same FROM pages",
    "due_pages": f"SELECT id, url FROM (SELECT id, any_value(url) AS url, any_value(next_crawl_at) AS seen_at FROM pages WHERE next_crawl_at <= {NOW_SQL} GROUP BY id) ORDER BY seen_at, id LIMIT 5000",
    "purge_gone": f"WITH d AS (SELECT id, any_value(url) AS url FROM pages WHERE status = 'gone' AND changed_at < {NOW_SQL} - INTERVAL 180 DAY GROUP BY id), n AS (SELECT source_url, count(DISTINCT id) AS links FROM links GROUP BY 1) SELECT id, coalesce(links, 0) AS links FROM d LEFT JOIN n ON n.source_url = d.url",
    "host_page_cap": f"SELECT id, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY fetched_at NULLS LAST, id) AS n FROM (SELECT id, any_value({_H}) AS host, any_value(fetched_at) AS fetched_at FROM pages GROUP BY id)) WHERE n <= 20",
    "host_page_count": f"SELECT {_H} AS host, count(DISTINCT id) AS page_count FROM pages GROUP BY 1",
    "latest_version": f"WITH {_CHANGES} SELECT id, change_seq, status, CAST(fetch_count AS BIGINT) AS fetch_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c) WHERE n = 1",
    "incremental_refresh": f"""
WITH {_CHANGES},
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c WHERE delivered_at <= TIMESTAMPTZ '2026-03-15 00:00:00+00') WHERE n = 1 AND status = 'ok'),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, change_seq DESC) AS n FROM c WHERE delivered_at > TIMESTAMPTZ '2026-03-15 00:00:00+00') WHERE n = 1)
SELECT id, version_hash FROM o WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, version_hash FROM w WHERE status = 'ok'
""",
    "status_counts": f"""
WITH p AS (SELECT id, any_value(status) AS status, any_value(next_crawl_at) AS seen_at FROM pages GROUP BY id)
SELECT 'pages_' || coalesce(status, 'null') AS name, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'due', count(*) FROM p WHERE seen_at <= {NOW_SQL}
UNION ALL SELECT 'hosts', count(DISTINCT id) FROM hosts UNION ALL SELECT 'links', count(DISTINCT id) FROM links
""",
    "pages_list": f"SELECT id, url, round(i / 3600, 6) AS hours FROM (SELECT id, any_value(url) AS url, any_value(CASE WHEN NOT isnan(page_rank) THEN page_rank END) AS r, any_value(revisit_interval) AS i FROM pages WHERE {_H} = 'www.lantern-harbor.example' GROUP BY id) ORDER BY r DESC NULLS LAST, url, id LIMIT 20 OFFSET 20",
    "page_detail": """
WITH l AS (SELECT id, any_value(source_url) AS s, any_value(target_url) AS t FROM links GROUP BY id), o AS (SELECT s, least(count(*), 200) AS n FROM l GROUP BY s), i AS (SELECT t, least(count(*), 200) AS n FROM l GROUP BY t),
p AS (SELECT DISTINCT id, url, len(list_filter(string_split(coalesce(headings, ''), chr(10)), lambda h: h <> '')) AS headings FROM pages)
SELECT id, headings, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM p LEFT JOIN o ON o.s = url LEFT JOIN i ON i.t = url
""",
    "exact_dups": """
WITH p AS (SELECT id, any_value(content_hash) AS h, any_value(fetched_at) AS seen_at FROM pages WHERE content_hash IS NOT NULL GROUP BY id), f AS (SELECT *, first_value(id) OVER (PARTITION BY h ORDER BY seen_at NULLS LAST, id) AS original FROM p)
SELECT id, original FROM f WHERE id <> original
""",
    "near_dups": f"WITH RECURSIVE {duck.simhashes(_DOCUMENTS, 'doc_id')}, {_classes('doc_id', 'documents')}",
    "page_dups": f"WITH RECURSIVE {duck.simhashes(_PAGES, 'id')}, {_classes('id', 'pages')}",
    "duplicate_members": "SELECT id, format('{:016x}', CASE WHEN simhash < 0 THEN CAST(simhash AS HUGEINT) + 18446744073709551616::HUGEINT ELSE CAST(simhash AS HUGEINT) END) || '|' || url AS member, simhash AS hash, url FROM (SELECT DISTINCT id, url, simhash FROM pages WHERE url IS NOT NULL AND simhash IS NOT NULL)",
    "robots_policy": f"""
SELECT origin, CASE WHEN blocked THEN 'none' WHEN e IS NULL OR e <= {ROBOTS_AT_SQL} THEN 'fetch' WHEN robots_status = 'ok' THEN 'rules' WHEN robots_status = 'missing' THEN 'all' ELSE 'none' END AS policy, epoch_us(e) AS expires_us FROM {_EXPIRES}
""",
    "robots_verdict": f"""
WITH {_RULES}, u AS (SELECT DISTINCT {duck.normalize_url('url')} AS u FROM pages), p AS (SELECT DISTINCT regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(u, '^https?://[^/]+', '') AS path FROM u WHERE u IS NOT NULL),
r AS (SELECT origin AS o, allow, pattern, {_PATTERN} AS regex FROM rules WHERE pattern IS NOT NULL),
h AS (SELECT origin, path, max(CASE WHEN regexp_matches(path, regex) THEN 2 * length(pattern) + CAST(allow AS INTEGER) END) AS best FROM p LEFT JOIN r ON r.o = origin GROUP BY origin, path),
q AS (SELECT origin, CASE WHEN blocked THEN 'none' WHEN e IS NULL OR e <= {ROBOTS_AT_SQL} THEN 'fetch' WHEN robots_status = 'ok' THEN 'rules' WHEN robots_status = 'missing' THEN 'all' ELSE 'none' END AS policy FROM {_EXPIRES})
SELECT h.origin, path, coalesce(policy, 'fetch') AS policy, CASE policy WHEN 'none' THEN false WHEN 'all' THEN true WHEN 'rules' THEN path = '/robots.txt' OR coalesce(best % 2 = 1, true) END AS allowed FROM h LEFT JOIN q ON q.origin = h.origin
""",
    "sitemap_discovery": f"""
WITH {_RULES}, s AS (SELECT origin, list({duck.normalize_url('v')} ORDER BY i) FILTER (WHERE {duck.normalize_url('v')} IS NOT NULL) AS l FROM pairs WHERE k = 'sitemap' AND v <> '' GROUP BY origin)
SELECT origin, unnest(CASE WHEN len(l) > 0 THEN l[1:10] ELSE [origin || '/sitemap.xml'] END) AS sitemap FROM (SELECT DISTINCT origin FROM hosts WHERE origin IS NOT NULL) LEFT JOIN s USING (origin)
""",
    "sitemap_entries": f"""
WITH u AS (SELECT DISTINCT {duck.normalize_url('url')} AS url FROM pages), o AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, url, CAST({duck.mix(duck.fnv('url'))} % 16::UHUGEINT AS INTEGER) AS part FROM u WHERE url IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY origin, part ORDER BY replace(url, '&', '&amp;') || '</loc>') AS nth FROM o)
SELECT origin, url, CAST(CASE WHEN part = 0 THEN 0 ELSE greatest(part % 3, 1) END AS BIGINT) AS depth, CASE WHEN part = 0 THEN 'sitemap' ELSE 'page' END AS kind FROM n WHERE nth <= 50
""",
    "robots_rules": f"WITH {_RULES} SELECT origin, allow, pattern, delay, sitemaps FROM rules",
    "robots_allowed": f"""
WITH {_RULES}, u AS (SELECT DISTINCT {duck.normalize_url('url')} AS u FROM pages), p AS (SELECT DISTINCT regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(u, '^https?://[^/]+', '') AS path FROM u WHERE u IS NOT NULL),
r AS (SELECT origin AS o, allow, pattern, {_PATTERN} AS regex FROM rules WHERE pattern IS NOT NULL),
h AS (SELECT origin, path, max(CASE WHEN regexp_matches(path, regex) THEN 2 * length(pattern) + CAST(allow AS INTEGER) END) AS best FROM p LEFT JOIN r ON r.o = origin GROUP BY origin, path)
SELECT origin, path, path = '/robots.txt' OR coalesce(best % 2 = 1, true) AS allowed FROM h
""",
    "politeness_delay": f"WITH {_RULES} SELECT origin, {', '.join(f'round(least(least(greatest(1.0, coalesce(delay, 0.0)), 30.0) * {x}.0, 30.0), 6) AS {n}' for n, x in (('plain', 1), ('failed', 4), ('busy', 8)))} FROM (SELECT DISTINCT origin, delay FROM rules)",
    "html_meta": f"""
WITH p AS (SELECT url, any_value(description) AS description, any_value(status) AS status, any_value(headings) AS headings FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT url, {duck.trim("coalesce(description, '')")} AS description, {duck.normalize_url('url')} AS canonical, status IN ('noindex', 'duplicate') AS noindex, status IN ('gone', 'duplicate') AS nofollow,
  array_to_string(list_filter(list_transform(string_split(coalesce(headings, ''), chr(10)), lambda h: {_SQUEEZE('h')}), lambda h: h <> ''), ' | ') AS headings FROM p
""",
    "html_links": f"""
WITH l AS (SELECT id, any_value(source_url) AS page, any_value(target_url) AS target, any_value(anchor_text) AS text FROM links WHERE source_url IS NOT NULL AND target_url IS NOT NULL AND id IS NOT NULL GROUP BY id),
g AS (SELECT page, {duck.trim('target')} AS target, list({_SQUEEZE("coalesce(text, '')")} ORDER BY id) AS texts, arg_min(md5(id) < '4', id) AS nofollow FROM l GROUP BY 1, 2)
SELECT page, {duck.normalize_url('target')} AS url, list_reduce(texts, lambda acc, t: CASE WHEN t = '' OR contains(acc, t) THEN acc ELSE acc || ' ' || t END) AS text, nofollow FROM g WHERE {duck.normalize_url('target')} IS NOT NULL
""",
    "html_extract": f"""
WITH p AS (SELECT url, any_value(title) AS title, any_value(content) AS content, any_value(language) AS language FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT url, {_SQUEEZE("coalesce(title, '')")} AS title, coalesce(language, '') AS language, CAST({_SQUEEZE("coalesce(title, '')")} <> '' AS BIGINT) AS headings,
  md5(substring({_SQUEEZE("coalesce(title, '') || ' ' || coalesce(content, '')")}, 1, 50000)) AS content, CAST({duck.normalize_url('url')} IS NOT NULL AS BIGINT) AS links FROM p
""",
    "frontier_pick": f"""
WITH f AS (SELECT origin, url, seq, next_allowed_at, {_PRIORITY} AS priority FROM frontier WHERE origin IS NOT NULL AND url IS NOT NULL),
o AS (SELECT origin FROM f GROUP BY origin HAVING max(next_allowed_at) IS NULL OR max(next_allowed_at) <= {LATER_SQL})
SELECT origin, url, seq, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY priority, seq, url) AS n FROM f WHERE origin IN (SELECT origin FROM o)) WHERE n = 1
""",
    "frontier_dedupe": f"""
WITH f AS (SELECT {duck.normalize_url('url')} AS url, seq FROM frontier), p AS (SELECT DISTINCT {duck.normalize_url('url')} AS url FROM pages)
SELECT url, min(seq) AS seq, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM f WHERE url IS NOT NULL AND seq IS NOT NULL AND url NOT IN (SELECT url FROM p WHERE url IS NOT NULL) GROUP BY url
""",
    "frontier_stats": f"WITH o AS (SELECT origin, count(*) AS n, max(next_allowed_at) AS seen_at FROM (SELECT DISTINCT * FROM frontier) WHERE origin IS NOT NULL GROUP BY origin) SELECT count(*) AS origins, count(*) FILTER (WHERE seen_at IS NULL OR seen_at <= {NOW_SQL}) AS ready, CAST(coalesce(sum(n), 0) AS BIGINT) AS queued FROM o",
    "retry_queue": "SELECT seq, CAST(retries + 1 AS BIGINT) AS retries, CAST(CASE WHEN kind = 'sitemap' THEN -1 ELSE depth + 2 * (retries + 1) END AS BIGINT) AS priority FROM (SELECT DISTINCT seq, retries, depth, kind FROM frontier) WHERE retries < 3",
    "sitemap_urls": f"SELECT DISTINCT {_H} AS host, {duck.trim('url')} AS url, false AS is_index FROM (SELECT DISTINCT host, url FROM pages WHERE url IS NOT NULL)",
}
