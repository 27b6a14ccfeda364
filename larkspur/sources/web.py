"""Web sources: HTML pages, sitemaps, robots.txt and fetch results."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.urls import normalize_url, trimmed
from larkspur.functions.urls import origin as url_origin
from larkspur.schema import DEFAULTS, Settings

# Elements without text of the page, elements around it, and elements that break lines of text.
DROPPED = frozenset(["script", "style", "noscript", "template", "svg", "iframe", "form"])
AROUND = frozenset(["nav", "header", "footer", "aside"])
BLOCKS = frozenset([
    "p", "div", "section", "article", "main", "aside", "header", "footer", "nav", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "blockquote", "pre", "dl", "dt", "dd", "figure",
    "body", "title",
])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
CONTENT_CHARS = 50_000

PAGE = "title string, description string, headings array<string>, content string, language string, canonical string, base string, links array<struct<href:string,text:string,nofollow:boolean>>, noindex boolean, nofollow boolean"


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Page(HTMLParser):
    """One pass over a page; every text goes to all the captures that are open where it stands."""

    def __init__(self, agent: str = "larkspur") -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.agent = agent
        self.meta: dict[str, str] = {}
        self.robots: list[str] = []
        self.lang = self.base = self.canonical = None
        self.heads: list[tuple[str, list[str]]] = []
        self.links: list[tuple[str, bool, list[str]]] = []
        self.title: list[str] | None = None
        self.body: list[str] = []
        self.main: list[str] | None = None
        self.main_depth = 0
        self.captures: list[tuple[int, list[str], bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and self.lang is None and "lang" in a:
            self.lang = a["lang"]
        elif tag == "base" and self.base is None and "href" in a:
            self.base = a["href"]
        elif tag == "meta":
            name = a.get("name", "").lower() or a.get("property", "").lower()
            if name in ("robots", self.agent):
                self.robots.append(a.get("content", "").lower())
            self.meta.setdefault(name, a.get("content", ""))
        elif tag == "link" and self.canonical is None and a.get("rel", "").lower() == "canonical" and "href" in a:
            self.canonical = a["href"]
        if tag in BLOCKS:
            self._text(" ")
        if tag in VOID:
            return
        self.open.append(tag)
        depth = len(self.open)
        if tag == "title" and self.title is None:
            self.title = []
            self.captures.append((depth, self.title, True))
        elif tag in ("h1", "h2", "h3"):
            self.heads.append((tag, []))
            self.captures.append((depth, self.heads[-1][1], False))
        elif tag == "a" and "href" in a:
            self.links.append((a["href"], "nofollow" in a.get("rel", "").lower(), []))
            self.captures.append((depth, self.links[-1][2], True))
        if self.main is None and (tag in ("main", "article") or a.get("role") == "main"):
            self.main, self.main_depth = [], depth

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open:
                got = self.open.pop()
                depth = len(self.open)
                self.captures = [c for c in self.captures if c[0] <= depth]
                if self.main_depth > depth:
                    self.main_depth = 0
                if got == tag:
                    break
        if tag in BLOCKS:
            self._text(" ")

    def handle_data(self, data: str) -> None:
        self._text(data)

    def _text(self, data: str) -> None:
        dropped = any(t in DROPPED for t in self.open)
        for _, parts, always in self.captures:
            if always or not dropped:
                parts.append(data)
        if not dropped and "title" not in self.open and "head" not in self.open:
            if self.main_depth:
                self.main.append(data)
            if not any(t in AROUND for t in self.open):
                self.body.append(data)


def parse_page(html: str, agent: str = "larkspur") -> dict:
    """Title, description, headings, main text, language, links and robots flags (for all and for ``agent``) of a page, however broken its markup."""
    p = _Page(agent)
    p.feed(html)
    p.close()
    robots = ",".join(p.robots)
    heads = [(t, _squeeze(x)) for t, x in p.heads]
    h1 = next((x for t, x in heads if t == "h1"), "")
    links = [{"href": h, "text": _squeeze(x), "nofollow": n} for h, n, x in p.links]
    content = _squeeze(p.main if p.main is not None else p.body)
    return {
        "title": _squeeze(p.title or []) or p.meta.get("og:title", "") or h1,
        "description": (p.meta.get("description", "") or p.meta.get("og:description", "")).strip(),
        "headings": [x for _, x in heads if x],
        "content": content[:CONTENT_CHARS],
        "language": p.lang,
        "canonical": p.canonical,
        "base": p.base,
        "links": links,
        "noindex": "noindex" in robots or "none" in robots,
        "nofollow": "nofollow" in robots or "none" in robots,
    }


def extract_pages(fetched: DataFrame, url: str, html: str) -> DataFrame:
    """``url`` and the fields of each page; links are resolved, normalised and merged by target, in order of first use.

    Rows with null HTML are left out; links that are not web links are dropped. Texts of further links to one target are appended unless they
    are part of the text so far; the first link's nofollow counts.
    """
    struct = pa.struct([("href", pa.string()), ("text", pa.string()), ("nofollow", pa.bool_())])
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(struct), pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in PAGE.replace("array<struct<href:string,text:string,nofollow:boolean>>", "x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                r = parse_page(h)
                base = urljoin(u, r["base"]) if r["base"] else u
                merged: dict[str, dict] = {}
                for x in r["links"]:
                    try:
                        target = urljoin(base, x["href"].strip())
                    except ValueError:
                        continue
                    old = merged.setdefault(target, dict(x, href=target))
                    if old["text"] != x["text"] and x["text"] and x["text"] not in old["text"]:
                        old["text"] += " " + x["text"]
                r["links"] = list(merged.values())
                if r["canonical"]:
                    r["canonical"] = urljoin(base, r["canonical"])
                rows.append(r)
            yield pa.RecordBatch.from_arrays([b.column("url"), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]], names=["url", *names])

    pages = fetched.where(F.col(html).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(html).alias("html"))
    out = pages.mapInArrow(run, "url string, " + PAGE)
    links = F.filter(F.transform("links", lambda x: F.struct(normalize_url(x["href"]).alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow"))), lambda x: x["url"].isNotNull())
    return out.withColumn("links", links).withColumn("canonical", normalize_url(F.col("canonical"))).drop("base")


def sitemap(xml: Column) -> tuple[Column, Column]:
    """All non-empty ``loc`` texts of a sitemap, and whether it is an index of sitemaps."""
    locs = F.transform(F.regexp_extract_all(xml, F.lit("(?is)<(?:\\w+:)?loc\\b[^>]*>(.*?)</(?:\\w+:)?loc>"), F.lit(1)), lambda x: trimmed(F.regexp_replace(F.replace(x, F.lit("&amp;"), F.lit("&")), "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")))
    return F.filter(locs, lambda x: x != ""), F.coalesce(xml.rlike("(?i)<(?:\\w+:)?sitemapindex\\b"), F.lit(False))


def sitemap_entries(sitemaps: DataFrame, xml: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Queue entries ``origin, url, depth, kind`` from sitemaps (``origin, depth`` and the text): the first ``urls_per_sitemap`` addresses of each.

    Those of an index are sitemaps of the same origin, as deep; those of a sitemap are pages, at least one deep. Addresses are normalised, others left out.
    """
    locs, is_index = sitemap(F.col(xml))
    rows = sitemaps.select("origin", "depth", is_index.alias("_index"), F.explode(F.slice(locs, 1, settings.urls_per_sitemap)).alias("_loc"))
    rows = rows.select("origin", "depth", "_index", normalize_url(F.col("_loc")).alias("url")).where("url IS NOT NULL")
    own = url_origin(F.col("url"))
    children = rows.where(F.col("_index") & (own == F.col("origin"))).select("origin", "url", "depth", F.lit("sitemap").alias("kind"))
    return children.unionByName(rows.where(~F.col("_index")).select(own.alias("origin"), "url", F.greatest("depth", F.lit(1)).alias("depth"), F.lit("page").alias("kind")))


def sitemaps_to_read(origin: Column, listed: Column, settings: Settings = DEFAULTS) -> Column:
    """The first ``sitemaps_per_host`` sitemaps that robots.txt lists, normalised, or ``/sitemap.xml`` if it lists none."""
    known = F.array_compact(F.transform(F.coalesce(listed, F.array().cast("array<string>")), normalize_url))
    return F.when(F.size(known) > 0, F.slice(known, 1, settings.sitemaps_per_host)).otherwise(F.array(F.concat(origin, F.lit("/sitemap.xml"))))


def is_redirect(status: Column) -> Column:
    """3xx but 304."""
    return status.between(300, 399) & (status != 304)


def is_html(content_type: Column) -> Column:
    """Whether the content type names HTML."""
    t = F.lower(content_type)
    return t.startswith("text/html") | t.startswith("application/xhtml+xml")


def outcome(status: Column) -> Column:
    """What to do with a fetch result: parse, touch, redirect, retry or gone; a null status is a failed fetch, to be tried again."""
    return (
        F.when(status.isNull(), "retry").when(status.between(200, 299), "parse").when(status == 304, "touch").when(is_redirect(status), "redirect")
        .when((status == 429) | (status >= 500), "retry").otherwise("gone")
    )


def robots_status(status: Column) -> Column:
    """What an answer to a request for robots.txt means: ok, missing, or error for everything else and for none."""
    return F.when(status.between(200, 299), "ok").when(status.between(400, 499), "missing").otherwise("error")


def robots_policy(hosts: DataFrame, now: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """``origin, policy, expires_at``: what holds for each origin at ``now``.

    none (blocked, or its robots.txt could not be read: nothing may be fetched), rules, all (it has none), or fetch: robots.txt is to be read anew, as it
    never was or its time is over, a day after it was read, an hour if that failed.
    """
    ttl = F.when(F.col("robots_status") == "error", F.lit(settings.robots_error_ttl)).otherwise(F.lit(settings.robots_ttl))
    expires = F.timestamp_micros(F.unix_micros("robots_fetched_at") + (ttl * 1e6).cast("long"))
    policy = (
        F.when(F.coalesce("blocked", F.lit(False)), "none").when(expires.isNull() | (expires <= F.lit(now)), "fetch")
        .when(F.col("robots_status") == "ok", "rules").when(F.col("robots_status") == "missing", "all").otherwise("none")
    )
    return hosts.where("origin IS NOT NULL").select("origin", policy.alias("policy"), expires.alias("expires_at")).dropDuplicates(["origin"])


def robots_verdict(urls: DataFrame, hosts: DataFrame, now: datetime, agent: str = "larkspur", settings: Settings = DEFAULTS) -> DataFrame:
    """``origin, path, policy, allowed``: whether each URL may be fetched at ``now``; null where robots.txt has to be read first, as for unknown origins."""
    rules = robots_rules(hosts, "origin", "robots_txt", agent)
    policy = robots_policy(hosts, now, settings).select(F.col("origin").alias("_p"), "policy")
    rows = robots_allowed(urls, rules).join(policy, F.col("origin") == F.col("_p"), "left")
    p = F.coalesce("policy", F.lit("fetch"))
    return rows.select("origin", "path", p.alias("policy"), F.when(p == "none", False).when(p == "all", True).when(p == "rules", F.col("allowed")).alias("allowed"))


def robots_rules(hosts: DataFrame, origin: str, robots_txt: str, agent: str = "larkspur") -> DataFrame:
    """``origin, allow, pattern, delay, sitemaps`` of the groups that hold for ``agent``: one row for each rule, or one with a null pattern.

    Groups that name the agent hold, else those for ``*``; groups of the same name are joined; the longest delay counts. Comments and
    empty rules are left out; consecutive User-agent lines share a group. All in the JVM: a window over the lines of one file.
    """
    rows = hosts.where(F.col(robots_txt).isNotNull()).select(F.col(origin).alias("origin"), F.col(robots_txt).alias("txt")).dropDuplicates(["origin"])
    lines = F.transform(F.split("txt", "\\r\\n|\\n|\\r", -1), lambda raw: F.substring_index(raw, "#", 1))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, "(?s):(.*)$", 1)).alias("v")))
    rows = rows.withColumn("pairs", pairs)
    # number the groups: a User-agent line after another kind of line begins one
    start = F.transform("pairs", lambda p, i: F.when((p["k"] == "user-agent") & ((i == 0) | (F.coalesce(F.get("pairs", i - 1)["k"], F.lit("")) != "user-agent")), i))
    rows = rows.withColumn("starts", F.array_compact(start))
    flat = rows.select(
        "origin", F.transform(F.filter("pairs", lambda p: (p["k"] == "sitemap") & (p["v"] != "")), lambda p: p["v"]).alias("sitemaps"), "starts",
        F.posexplode_outer("pairs").alias("at", "p"),
    )
    flat = flat.withColumn("group", F.size(F.filter("starts", lambda s: s <= F.col("at")))).drop("starts")
    per = flat.groupBy("origin", "group").agg(
        F.first("sitemaps").alias("sitemaps"),
        F.collect_set(F.when(F.col("p.k") == "user-agent", F.lower("p.v"))).alias("agents"),
        F.array_sort(F.collect_list(F.when(F.col("p.k").isin("allow", "disallow") & (F.col("p.v") != ""), F.struct("at", (F.col("p.k") == "allow").alias("allow"), F.col("p.v").alias("pattern"))))).alias("rules"),
        F.max(F.when(F.col("p.k") == "crawl-delay", F.col("p.v").try_cast("double"))).alias("delay"),
    )
    named, star = F.array_contains("agents", agent.lower()) & (F.col("group") > 0), F.array_contains("agents", "*") & (F.col("group") > 0)
    flagged = per.groupBy("origin").agg(
        F.first("sitemaps").alias("sitemaps"), F.max(named).alias("any_named"), F.collect_list(F.when(named, F.struct("rules", "delay"))).alias("own"), F.collect_list(F.when(star, F.struct("rules", "delay"))).alias("all")
    )
    held = F.when(F.col("any_named"), F.col("own")).otherwise(F.col("all"))
    return flagged.select("origin", "sitemaps", F.flatten(F.transform(held, lambda g: g["rules"])).alias("rules"), F.array_max(F.transform(held, lambda g: g["delay"])).alias("delay")).select(
        "origin", F.explode_outer("rules").alias("r"), "delay", "sitemaps"
    ).select("origin", F.col("r.allow").alias("allow"), F.col("r.pattern").alias("pattern"), "delay", "sitemaps")


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: ``*`` for any text, a final ``$`` for the end, else a prefix."""
    body = F.regexp_replace(pattern, "\\$$", "")
    quoted = F.concat(F.lit("\\Q"), F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?s)^"), quoted, F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``origin`` and ``path``, path and query) and ``allowed``: the longest matching rule decides, Allow among equals, no match allows.

    An origin's rules are one row (as long as its robots.txt), so that an origin with a third of the URLs is only a join with few rows on one side, which
    Spark broadcasts by size or splits where it is skewed; nothing is grouped after it. ``/robots.txt`` is always allowed; URLs of origins without
    rules are allowed. Repeated rows of a URL come back once.
    """
    rule = F.struct(F.char_length("pattern").alias("n"), "allow", pattern_regex(F.col("pattern")).alias("regex"))
    r = rules.where("pattern IS NOT NULL").groupBy(F.col("origin").alias("_o")).agg(F.collect_list(rule).alias("_rules"))
    joined = urls.select("origin", "path").dropDuplicates(["origin", "path"]).join(r, F.col("origin") == F.col("_o"), "left")
    best = F.array_max(F.transform(F.filter("_rules", lambda x: F.regexp_like(F.col("path"), x["regex"])), lambda x: F.struct(x["n"], x["allow"])))
    return joined.select("origin", "path", ((F.col("path") == "/robots.txt") | F.coalesce(best["allow"], F.lit(True))).alias("allowed"))
