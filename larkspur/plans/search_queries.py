"""Queries over the index: statistics, retrieval, ranking and snippets."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import snippet as snippet_of
from larkspur.operators import index, search
from larkspur.plans import duck
from larkspur.plans.query import Query, parse
from larkspur.schema import FIELD_B, FIELD_WEIGHTS, FIELDS, K1, SYNONYM_FACTOR, WEIGHTS
from larkspur.session import table

NOW = datetime(2026, 4, 1, tzinfo=timezone.utc)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_sources(*[table(spark, sf_dir, t) for t in ("pages", "links", "hosts")])


@lru_cache(maxsize=8)
def _built(app: str, sf_dir: str, files: tuple) -> index.Index:
    spark = SparkSession.getActiveSession()
    # taking texts apart is the costly part: as many pieces as there are cores, or more where the session asks for more
    return index.write_index(_sources(spark, sf_dir), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that the index is made of."""
    out = []
    for name in ("pages", "links", "hosts"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return tuple(sorted(out))


def indexed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the tables, written once a session as a search engine keeps its index, and anew when a file has changed; all searches read it."""
    return _built(spark.sparkContext.applicationId, sf_dir, _files(spark, sf_dir))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("page_id", F.round("bm25", 6).alias("bm25"), F.size("matched").cast("long").alias("matched"), "title_matches", "anchor_matches", "in_title", "in_body")


def _found(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
    """Every page that a query finds, with its parts of the score, before any limit."""
    ix = indexed(spark, sf_dir)
    return _shown(search.matched(ix.sources, None, q, ix.postings, ix.stats))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, postings and distinct terms of the index, after it was built if it has not been."""
    ix = indexed(spark, sf_dir)
    terms = ix.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return ix.stats.select("documents").join(terms.agg(F.sum("df").alias("postings"), F.count(F.lit(1)).alias("terms")), how="cross")  # one row each


def bm25f_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-weighted BM25 over all fields."""
    return _found(spark, sf_dir, parse("crawler waiting queue snapshot"))


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase that must occur."""
    return _found(spark, sf_dir, parse('"anchor texts" crawler'))


def search_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that must not occur."""
    return _found(spark, sf_dir, parse("tokenizer -scheduler"))


def search_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site with its subdomains."""
    return _found(spark, sf_dir, parse("snapshot site:lantern-harbor.example"))


def search_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in one language, Japanese terms."""
    return _found(spark, sf_dir, parse("巡回プログラム lang:ja"))


def search_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms count 0.7; here spider stands for crawler and db for database."""
    return _found(spark, sf_dir, parse("spider db archive", _book()))


def _book():  # noqa: ANN202
    from larkspur.plans.query import Synonyms

    return Synonyms([["spider", "crawler"], ["db", "database"]])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(raw, parse(raw)) for raw in b.column("raw").to_pylist()]
        columns = [[raw, " ".join(q.terms), " ".join(q.excluded), "|".join(q.phrases), q.site, q.language, q.text, q.has_cjk, q.cache_key] for raw, q in rows]
        kinds = [pa.string()] * 7 + [pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True) if columns else [()] * 9, kinds, strict=True)], names=PARSED)


PARSED = ["raw", "terms", "excluded", "phrases", "site", "language", "text", "has_cjk", "cache_key"]


def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged query, taken apart; those of even pages with filters added."""
    filters = F.when(F.col("page") % 2 == 0, F.lit(" site:Lantern-Harbor.example LANG:De")).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "search_impressions").where("query IS NOT NULL").select(F.concat("query", filters).alias("raw")).distinct()
    return rows.mapInArrow(_parsed, ", ".join(f"{n} {'boolean' if n == 'has_cjk' else 'string'}" for n in PARSED))


def empty_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and exclusions alone find nothing."""
    ix = indexed(spark, sf_dir)
    got = search.search(ix.sources, None, parse("-crawler site:lantern-harbor.example lang:en"), NOW, posts=ix.postings, stats=ix.stats)
    return got.agg(F.count(F.lit(1)).alias("results")).join(search.total(ix.sources, None, parse("-crawler lang:en"), ix.postings, ix.stats), how="cross")  # one row each


def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term, and its occurrences in titles and bodies."""
    return indexed(spark, sf_dir).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.get("tf", F.lit(0))).alias("in_titles"), F.sum(F.get("tf", F.lit(5))).alias("in_bodies"))


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per field of every page."""
    return indexed(spark, sf_dir).tokens.select("page_id", *[F.size(F.get("tokens", F.lit(i))).cast("long").alias(f) for i, f in enumerate(FIELDS)])


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, average field lengths and highest ranks."""
    return indexed(spark, sf_dir).stats.select("documents", *[F.round(F.get("average_lengths", F.lit(i)), 6).alias(f) for i, f in enumerate(FIELDS)], F.round("max_page_rank", 9).alias("max_page_rank"), F.round("max_host_rank", 9).alias("max_host_rank"))


def ranking_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve features, preliminary and model score of each shard's candidates."""
    ix = indexed(spark, sf_dir)
    rows = search.candidates(ix.sources, None, parse("crawler snapshot"), NOW, posts=ix.postings, stats=ix.stats)
    return rows.select("page_id", "shard", "place", F.round("preliminary", 6).alias("preliminary"), F.round(search.linear_score(F.col("features")), 6).alias("score"), *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i + 1}") for i in range(12)])


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of results, diversified by host, with snippets."""
    return _page(spark, sf_dir).select("rank", "page_id", "host", "snippet", "score")


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = indexed(spark, sf_dir)
    return search.search(ix.sources, None, parse("crawler snapshot"), NOW, page=2, per=10, posts=ix.postings, stats=ix.stats)


def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page as the service answers it: click address, time, terms and shard of each result, with the number of all pages found."""
    ix = indexed(spark, sf_dir)
    n = search.total(ix.sources, None, parse("crawler snapshot"), ix.postings, ix.stats)
    click = search.click_url(F.lit("i1"), F.col("rank"), F.col("url"))
    rows = _page(spark, sf_dir).select("rank", click.alias("click_url"), F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed_at"), F.array_join("terms", " ").alias("terms"), "shard")
    return rows.join(n, how="cross")  # one row


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's results as JSON and read back: rank, click address and matched terms."""
    rows = search.result_items(_page(spark, sf_dir), "i1", explain=True)
    got = F.from_json("item", "rank int, clickURL string, changedAt string, explain struct<matchedTerms:array<string>,shardID:int>")
    return rows.select(got.alias("x")).select("x.rank", F.col("x.clickURL").alias("click_url"), F.col("x.changedAt").alias("changed_at"), F.array_join("x.explain.matchedTerms", " ").alias("terms"), F.col("x.explain.shardID").alias("shard"))


def host_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best pages by rank, at most two a host before the rest."""
    rows = _sources(spark, sf_dir).select("page_id", "url", "host", F.col("page_rank").alias("score")).orderBy(F.col("score").desc(), "url").limit(200)
    return search.diversified(rows).select("page_id", "rank")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets around two terms of every page."""
    return _sources(spark, sf_dir).select("page_id", snippet_of(F.col("content"), F.col("description"), ["snapshot", "archive"]).alias("snippet"))


def anchor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 100 anchor texts of every link target."""
    return index.anchor_texts(table(spark, sf_dir, "links"))


def host_rank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rank and access counts of every indexed page."""
    return _sources(spark, sf_dir).select("page_id", "host", F.round("host_rank", 9).alias("host_rank"), F.col("clicks").cast("long").alias("clicks"), F.col("impressions").cast("long").alias("impressions"))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and terms of each shard."""
    from larkspur.functions.hashing import shard, url_hash

    ix = indexed(spark, sf_dir)
    where = ix.sources.select("page_id", shard(url_hash("url"), 2).alias("shard"))
    terms = ix.postings.select("page_id", "term").join(where, "page_id").select("shard", "term").distinct()
    return where.groupBy("shard").agg(F.count(F.lit(1)).alias("documents")).join(terms.groupBy("shard").agg(F.count(F.lit(1)).alias("terms")), "shard")


QUERIES = {
    f.__name__: f
    for f in (
        index_build, bm25f_search, search_phrase, search_exclude, search_site, search_lang, search_synonyms, parsed_queries, empty_search, term_postings, field_lengths, corpus_statistics, ranking_features, search_page, search_envelope, search_items, host_crowding,
        snippet, anchor_text, host_rank_join, index_status,
    )
}

_ANCHORS = """
anchors AS (
  SELECT url, string_agg(text, chr(10) ORDER BY id, text) AS anchor_text FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY id, text) AS n FROM (
      SELECT DISTINCT target_url AS url, coalesce(id, '') AS id, anchor_text AS text FROM links
      WHERE target_url IS NOT NULL AND trim(anchor_text) <> '' AND (source_host <> target_host OR source_url <> target_url)
    )) WHERE n <= 100 GROUP BY url)"""
_SOURCES = f"""
raw AS (
  SELECT id AS page_id, any_value(url) AS url, any_value({duck.host_key('host')}) AS host, coalesce(any_value(title), '') AS title, coalesce(any_value(description), '') AS description,
    coalesce(any_value(headings), '') AS headings, coalesce(any_value(content), '') AS content, any_value(language) AS language,
    coalesce(any_value(CASE WHEN NOT isnan(page_rank) THEN page_rank END), 0) AS page_rank, coalesce(any_value(clicks), 0) AS clicks, coalesce(any_value(impressions), 0) AS impressions, any_value(changed_at) AS changed_at
  FROM pages WHERE status = 'ok' AND id IS NOT NULL GROUP BY id
), {_ANCHORS}, ranks AS (
  SELECT {duck.host_key('host')} AS host, max(CASE WHEN NOT isnan(host_rank) THEN host_rank END) AS host_rank FROM hosts GROUP BY 1
), src AS (
  SELECT raw.*, coalesce(anchor_text, '') AS anchor_text, coalesce(host_rank, 0) AS host_rank FROM raw LEFT JOIN anchors USING (url) LEFT JOIN ranks ON raw.host = ranks.host
)"""
_TEXTS = {"title": "title", "headings": "headings", "description": "description", "anchor": "anchor_text", "url": duck.url_text(duck.normalize_url("url")), "body": "content"}
_TOKENS = "tok AS MATERIALIZED (SELECT page_id, " + ", ".join(f"{duck.tokens(_TEXTS[f])} AS t{i}" for i, f in enumerate(FIELDS)) + " FROM src)"
_ALL = "list_concat(" * 5 + "t0" + "".join(f", t{i})" for i in range(1, 6))
_COUNT = lambda i, w: f"len(list_filter(t{i}, lambda x: x = {w}))"


def _search_ctes(q: Query) -> tuple[str, str]:
    """CTEs of a search, and the condition on ``per JOIN docs``."""
    rows = [(t, i, 1.0, 0) for i, t in enumerate(q.terms)] + [(s, i, SYNONYM_FACTOR, k + 1) for i, t in enumerate(q.terms) for k, s in enumerate(q.synonyms.get(t, []))]
    words = ", ".join(f"({duck.text(t)}, {i}, {f}, {a})" for t, i, f, a in rows)
    weighted = " + ".join(f"{w} * tf{i} / (1 - {b} + {b} * l{i} / greatest(a{i}, 1))" for i, (w, b) in enumerate(zip(FIELD_WEIGHTS, FIELD_B, strict=True)))
    norm = f"lower({duck.nfkc('title')}) AS nt, lower({duck.nfkc('headings || chr(10) || description || chr(10) || content')}) AS nb"
    where = ["true"]
    if q.site:
        where.append(f"(host = {duck.text(q.site)} OR ends_with(host, {duck.text('.' + q.site)}))")
    if q.language:
        where.append(f"coalesce(starts_with(lower(language), {duck.text(q.language)}), false)")
    where += [f"(contains(nt, {duck.text(p)}) OR contains(nb, {duck.text(p)}))" for p in q.phrases]
    gone = "SELECT page_id FROM tok WHERE " + " OR ".join(f"list_contains({_ALL}, {duck.text(x)})" for x in q.excluded) if q.excluded else "SELECT page_id FROM tok WHERE false"
    return f"""
WITH {_SOURCES}, {_TOKENS},
stats AS (SELECT count(*) AS n, {', '.join(f'sum(len(t{i})) / count(*) AS a{i}' for i in range(6))} FROM tok),
words(w, ord, factor, alt) AS (VALUES {words}),
hits AS (SELECT page_id, w, ord, factor, alt, {', '.join(f'{_COUNT(i, "w")} AS tf{i}, len(t{i}) AS l{i}' for i in range(6))} FROM tok, words WHERE list_contains({_ALL}, w)),
df AS (SELECT w, count(DISTINCT page_id) AS df FROM hits GROUP BY w),
scored AS (SELECT page_id, ord, alt, tf0 > 0 AS ti, tf3 > 0 AS an, factor * ln(1 + (n - df + 0.5) / (df + 0.5)) * ({weighted}) / ({K1} + ({weighted})) AS s FROM hits JOIN df USING (w), stats),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, ord ORDER BY s DESC, alt) AS rn FROM scored),
per AS (SELECT page_id, sum(s) AS bm25, count(*) AS matched, count(*) FILTER (WHERE ti) AS title_matches, count(*) FILTER (WHERE an) AS anchor_matches FROM best WHERE rn = 1 GROUP BY page_id),
docs AS (SELECT *, {norm} FROM src)
""", f"{' AND '.join(where)} AND page_id NOT IN ({gone})"


def _search_sql(q: Query) -> str:
    ctes, where = _search_ctes(q)
    return f"""{ctes}
SELECT page_id, round(bm25, 6) AS bm25, matched, title_matches, anchor_matches, CAST(contains(nt, {duck.text(q.text)}) AS DOUBLE) AS in_title, CAST(contains(nb, {duck.text(q.text)}) AS DOUBLE) AS in_body
FROM per JOIN docs USING (page_id) WHERE {where}
"""


def _features_sql(q: Query) -> str:
    """CTEs up to ``cand``: the candidates of each shard with features f1 to f12, preliminary and model score."""
    ctes, where = _search_ctes(q)
    n = f"{max(1, len(q.terms))}::DOUBLE"
    text = duck.text(q.text)
    age = f"greatest(0, (epoch_us(TIMESTAMPTZ '2026-04-01 00:00:00+00') - epoch_us(changed_at)) / 86400000000.0::DOUBLE)"
    share = lambda x, m: f"CASE WHEN {m} > 0 THEN {x} / {m} ELSE 0 END"
    f = [
        "ln(1 + bm25)", f"matched / {n}", f"title_matches / {n}", f"anchor_matches / {n}", f"CAST(contains(nt, {text}) AS DOUBLE)", f"CAST(contains(nb, {text}) AS DOUBLE)", share("page_rank", "mp"), share("host_rank", "mh"),
        f"CASE WHEN changed_at IS NULL THEN 0 ELSE exp(-({age}) / 365) END", f"1.0::DOUBLE / (1 + len(list_filter(string_split({duck.url_path(duck.normalize_url('url'))}, '/'), lambda s: s <> '')))",
        "(clicks + 1.0::DOUBLE) / (impressions + 10)", f"CASE WHEN language IS NULL THEN 0.5 ELSE CAST(starts_with(lower(language), 'ja') = {str(q.has_cjk).lower()} AS DOUBLE) END",
    ]
    model = " + ".join(f"{w}::DOUBLE * f{i + 1}" for i, w in enumerate(WEIGHTS))
    return f"""{ctes.rstrip()},
tops AS (SELECT max(page_rank) AS mp, max(host_rank) AS mh FROM src),
feat AS (SELECT page_id, url, host, content, description, changed_at, bm25, {', '.join(f'CAST({x} AS DOUBLE) AS f{i + 1}' for i, x in enumerate(f))} FROM per JOIN docs USING (page_id), tops WHERE {where}),
pre AS (SELECT *, bm25 * f2 * f2 * (1 + 0.5::DOUBLE * f5 + 0.2::DOUBLE * f6) * (1 + 0.5::DOUBLE * f7) AS preliminary, {model} AS score, {duck.shard('url', 2)} AS shard FROM feat),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY round(preliminary, 12) DESC, url) AS place FROM pre) WHERE place <= 200),
nth AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY round(score, 12) DESC, url) AS nth FROM cand),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN nth > 2 THEN 1 ELSE 0 END, round(score, 12) DESC, url) AS rank FROM nth),
shown AS (SELECT * FROM ranked WHERE rank BETWEEN 11 AND 20)"""


def _snippet_sql(rows: str, terms: list[str]) -> str:
    """CTEs after which ``snip`` has ``page_id`` and ``snippet`` of ``rows`` (page_id, content, description)."""
    hits = ", ".join(f"coalesce(nullif(instr(folded, {duck.text(t)}), 0), 1000000000)" for t in terms)
    return f"""
f AS (SELECT page_id, content, description, length(content) AS n, lower(translate(content, {duck.text(duck.FROM)}, {duck.text(duck.TO)})) AS folded FROM {rows}),
p AS (SELECT *, least({hits}) - 1 AS hit FROM f),
s AS (SELECT *, greatest(0, least(hit - 40, n - 160)) AS b FROM p),
snip AS (SELECT page_id, CASE WHEN content = '' THEN description WHEN hit >= 999999999 THEN CASE WHEN description <> '' THEN description ELSE substring(content, 1, 160) || CASE WHEN n > 160 THEN '…' ELSE '' END END
  ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(substring(content, b + 1, least(n, b + 160) - b), '^[\\s\\x{{0b}}]+|[\\s\\x{{0b}}]+$', '', 'g') || CASE WHEN least(n, b + 160) < n THEN '…' ELSE '' END END AS snippet
FROM s)"""


_CRAWLER = parse("crawler snapshot")
_HAS = [f"(SELECT len({_ALL}) > 0 AND list_contains({_ALL}, {duck.text(t)}) FROM tok WHERE tok.page_id = shown.page_id)" for t in _CRAWLER.terms]
_CLICK = "replace(url_encode(url), '%2A', '*')"
for _code, _sign in search.OPEN:
    _CLICK = f"replace({_CLICK}, '{_code}', {duck.text(_sign)})"
_ITEM = f"rank, '/click?i=i1&p=' || rank || '&u=' || {_CLICK} AS click_url, strftime(changed_at, '%Y-%m-%dT%H:%M:%SZ') AS changed_at, array_to_string(list_filter([{', '.join(f'CASE WHEN {h} THEN {duck.text(t)} END' for h, t in zip(_HAS, _CRAWLER.terms, strict=True))}], lambda w: w IS NOT NULL), ' ') AS terms, shard"
_WHITE = r"'[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{3000}]+'"
_QUOTED, _UNQUOTED = "regexp_extract(raw, '\"([^\"]*)\"', 1)", "regexp_replace(raw, '\"[^\"]*\"', '', 'g')"
_PHRASE = lambda x: f"trim(regexp_replace(lower({duck.nfkc(x)}), {_WHITE}, ' ', 'g'))"

ORACLE = {
    "bm25f_search": _search_sql(parse("crawler waiting queue snapshot")),
    "search_phrase": _search_sql(parse('"anchor texts" crawler')),
    "search_exclude": _search_sql(parse("tokenizer -scheduler")),
    "search_site": _search_sql(parse("snapshot site:lantern-harbor.example")),
    "search_lang": _search_sql(parse("巡回プログラム lang:ja")),
    "search_synonyms": _search_sql(parse("spider db archive", _book())),
    # queries of the log have one phrase at most
    "parsed_queries": f"""
WITH q AS (SELECT DISTINCT query || CASE WHEN page % 2 = 0 THEN ' site:Lantern-Harbor.example LANG:De' ELSE '' END AS raw FROM search_impressions WHERE query IS NOT NULL),
o AS (SELECT raw, {_PHRASE(_QUOTED)} AS phrase, list_filter(regexp_split_to_array({_UNQUOTED}, {_WHITE}), lambda w: w <> '') AS words FROM q),
e AS (
  SELECT *, flatten(list_transform(list_filter(words, lambda w: starts_with(w, '-') AND length(w) > 1), lambda w: CASE WHEN list_contains({duck.tokens('substring(w, 2)')}, lower(substring(w, 2))) THEN [lower(substring(w, 2))] ELSE {duck.tokens('substring(w, 2)')} END)) AS gone,
    array_to_string(list_concat(list_filter(words, lambda w: NOT (starts_with(w, '-') AND length(w) > 1) AND NOT starts_with(lower(w), 'site:') AND NOT starts_with(lower(w), 'lang:')), CASE WHEN phrase = '' THEN CAST([] AS VARCHAR[]) ELSE [phrase] END), ' ') AS free FROM o
), t AS (SELECT *, {_PHRASE('free')} AS text, list_filter({duck.tokens('free')}, lambda x: NOT list_contains(gone, x)) AS found, CASE WHEN contains(raw, ' site:') THEN 'lantern-harbor.example' END AS site, CASE WHEN contains(raw, ' LANG:') THEN 'de' END AS language FROM e)
SELECT raw, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' ') AS terms, array_to_string(list_sort(list_distinct(gone)), ' ') AS excluded, phrase AS phrases, site, language, text,
  regexp_matches(text, '[\\x{{3041}}-\\x{{9fff}}]') AS has_cjk,
  text || ' p=' || phrase || ' x=' || array_to_string(list_sort(list_distinct(gone)), '|') || ' s=' || coalesce(site, '') || ' l=' || coalesce(language, '') AS cache_key FROM t
""",
    "empty_search": "SELECT 0::BIGINT AS results, 0::BIGINT AS total",
    "term_postings": f"""
WITH {_SOURCES}, {_TOKENS}, flat AS (
  SELECT page_id, unnest(t0) AS term, 0 AS f FROM tok {' '.join(f'UNION ALL SELECT page_id, unnest(t{i}), {i} FROM tok' for i in range(1, 6))}
)
SELECT term, count(DISTINCT page_id) AS df, CAST(count(*) FILTER (WHERE f = 0) AS BIGINT) AS in_titles, CAST(count(*) FILTER (WHERE f = 5) AS BIGINT) AS in_bodies FROM flat GROUP BY term
""",
    "field_lengths": f"WITH {_SOURCES}, {_TOKENS} SELECT page_id, {', '.join(f'CAST(len(t{i}) AS BIGINT) AS {chr(34)}{f}{chr(34)}' for i, f in enumerate(FIELDS))} FROM tok",
    "corpus_statistics": f"""
WITH {_SOURCES}, {_TOKENS}
SELECT (SELECT count(*) FROM tok) AS documents, {', '.join(f'(SELECT round(greatest(sum(len(t{i})) / count(*), 1), 6) FROM tok) AS {chr(34)}{f}{chr(34)}' for i, f in enumerate(FIELDS))},
  round(max(page_rank), 9) AS max_page_rank, round(max(host_rank), 9) AS max_host_rank FROM src
""",
    "host_crowding": f"""
WITH {_SOURCES}, top AS (SELECT page_id, url, host, page_rank AS score FROM src ORDER BY score DESC, url LIMIT 200),
nth AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, url) AS nth FROM top)
SELECT page_id, CAST(row_number() OVER (ORDER BY CASE WHEN nth > 2 THEN 1 ELSE 0 END, score DESC, url) AS INTEGER) AS rank FROM nth
""",
    "snippet": f"WITH {_SOURCES}, {_snippet_sql('src', ['snapshot', 'archive'])} SELECT page_id, snippet FROM snip",
    "ranking_features": _features_sql(_CRAWLER) + f" SELECT page_id, shard, CAST(place AS INTEGER) AS place, round(preliminary, 6) AS preliminary, round(score, 6) AS score, {', '.join(f'round(f{i}, 6) AS f{i}' for i in range(1, 13))} FROM cand",
    "search_page": _features_sql(_CRAWLER) + f", {_snippet_sql('shown', _CRAWLER.terms)} SELECT CAST(rank AS INTEGER) AS rank, page_id, host, snippet, round(score, 3) AS score FROM shown JOIN snip USING (page_id)",
    "search_envelope": _features_sql(_CRAWLER) + f" SELECT CAST(rank AS INTEGER) AS rank, click_url, changed_at, terms, shard, (SELECT count(*) FROM pre) AS total FROM (SELECT {_ITEM} FROM shown)",
    "search_items": _features_sql(_CRAWLER) + f" SELECT CAST(rank AS INTEGER) AS rank, click_url, changed_at, terms, shard FROM (SELECT {_ITEM} FROM shown)",
    "index_status": f"""
WITH {_SOURCES}, {_TOKENS}, w AS (SELECT page_id, {duck.shard('url', 2)} AS shard FROM src), t AS (SELECT shard, count(DISTINCT term) AS terms FROM (SELECT page_id, unnest({_ALL}) AS term FROM tok) JOIN w USING (page_id) GROUP BY shard)
SELECT shard, count(*) AS documents, any_value(terms) AS terms FROM w JOIN t USING (shard) GROUP BY shard
""",
    "index_build": f"WITH {_SOURCES}, {_TOKENS}, t AS (SELECT DISTINCT page_id, unnest({_ALL}) AS term FROM tok) SELECT (SELECT count(*) FROM tok) AS documents, count(*) AS postings, count(DISTINCT term) AS terms FROM t",
    "anchor_text": f"WITH {_ANCHORS.strip()} SELECT * FROM anchors",
    "host_rank_join": f"WITH {_SOURCES} SELECT page_id, host, round(host_rank, 9) AS host_rank, CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions FROM src",
}
