"""Queries over text and URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import hashing, text, urls
from larkspur.operators import crawl
from larkspur.plans import duck
from larkspur.session import table, written


def _url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "frontier").select("url", "seq", "depth").distinct()
    return rows.select("seq", "depth", F.col("url").alias("raw"), urls.normalize_url(F.col("url")).alias("url"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel-case parts of part names written together."""
    word = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.col("p_partkey").cast("string"), F.lit("XMLFile"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.camel_parts(word), " ").alias("parts"))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character pairs of page titles without spaces."""
    rows = table(spark, sf_dir, "pages").select("id", F.regexp_replace("title", "\\s", "").alias("t")).where("t <> ''").distinct()
    return rows.select("id", F.array_join(text.bigrams(F.col("t")), " ").alias("pairs"))


def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of token shingles of each document and its first."""
    s = text.shingles(F.col("t"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.size(s).cast("long").alias("n"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first"))


def normalize_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged queries as phrases."""
    return table(spark, sf_dir, "search_impressions").select("id", text.normalize_phrase(F.col("query")).alias("phrase")).distinct()


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frontier address in its normal form."""
    return _url(spark, sf_dir).select("seq", "url")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin, host, depth and words of the normal addresses."""
    u = F.col("url")
    return _url(spark, sf_dir).where("url IS NOT NULL").select("seq", urls.origin(u).alias("origin"), urls.url_host(u).alias("host"), urls.path_depth(u).cast("long").alias("path_depth"), urls.url_text(u).alias("words"))


def crawl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses may be crawled, with one host blocked, and which look like traps or files."""
    u = F.col("url")
    return _url(spark, sf_dir).select("seq", crawl.in_scope(u, F.col("depth"), block=["lantern-harbor.example"]).alias("allowed"), F.coalesce(urls.looks_like_trap(u), F.lit(False)).alias("trap"), F.coalesce(urls.is_non_html(u), F.lit(False)).alias("file"))


def url_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, bucket and shard of page addresses."""
    rows = table(spark, sf_dir, "pages").select("id", "url").where("url IS NOT NULL").distinct().withColumn("hash", hashing.url_hash("url"))
    return rows.select("id", "hash", hashing.bucket(F.col("hash")).alias("bucket"), hashing.shard(F.col("hash"), 2).alias("shard"))


def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven positions of page addresses in a filter of 2^30 bits."""
    return table(spark, sf_dir, "pages").select("id", "url").where("url IS NOT NULL").distinct().select("id", F.array_join(hashing.bloom_positions()("url"), " ").alias("positions"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of title and content."""
    rows = table(spark, sf_dir, "pages").select("id", hashing.content_hash(F.col("title"), F.col("content")).alias("hash"))
    return rows.distinct()


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each document with its bands."""
    # written first: one Arrow step inside another's argument cannot be planned
    rows = written(table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("t")), "tokens")
    rows = rows.select("doc_id", hashing.simhash_of("t").alias("simhash"))
    return rows.select("doc_id", "simhash", F.array_join(hashing.bands(F.col("simhash")), " ").alias("bands"))


QUERIES = {
    f.__name__: f
    for f in (tokenize, camel_split, bigrams, shingles, normalize_phrase, url_normalize, url_parts, crawl_scope, url_hash_bucket, bloom_positions, content_hash, simhash)
}

_CAMEL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{N}})', '\\1 \\2', 'g'), '(\\p{{N}})(\\p{{L}})', '\\1 \\2', 'g')"
_URLS = f"u AS (SELECT DISTINCT seq, depth, {duck.normalize_url('url')} AS url FROM (SELECT DISTINCT url, seq, depth FROM frontier))"
_SEGMENTS = f"list_filter(string_split({duck.url_path('url')}, '/'), lambda s: s <> '')"


ORACLE = {
    "tokenize": f"SELECT doc_id, CAST(CASE WHEN t IS NULL THEN NULL ELSE len(t) END AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {duck.tokens('text')} AS t FROM documents)",
    "camel_split": "SELECT p_partkey, " + _CAMEL.format(x="array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || p_partkey || 'XMLFile'") + " AS parts FROM part",
    "bigrams": "SELECT id, CASE WHEN length(t) < 2 THEN t ELSE array_to_string(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), ' ') END AS pairs FROM (SELECT DISTINCT id, regexp_replace(title, '[\\s\\x{0b}]', '', 'g') AS t FROM pages) WHERE t <> ''",
    "shingles": f"SELECT doc_id, CAST(CASE WHEN len(t) = 0 THEN 0 ELSE greatest(len(t) - 2, 1) END AS BIGINT) AS n, array_to_string(t[1:3], ' ') AS first FROM (SELECT doc_id, {duck.tokens(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents)",
    "normalize_phrase": f"SELECT DISTINCT id, trim(regexp_replace(lower({duck.nfkc('query')}), '[\\s\\x{{0b}}]+', ' ', 'g')) AS phrase FROM search_impressions",
    "url_normalize": f"WITH {_URLS} SELECT seq, url FROM u",
    "url_parts": f"WITH {_URLS} SELECT seq, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, {duck.url_host('url')} AS host, CAST(len({_SEGMENTS}) AS BIGINT) AS path_depth, {duck.url_text('url')} AS words FROM u WHERE url IS NOT NULL",
    "url_hash_bucket": f"""
WITH g AS (SELECT id, {duck.mix(duck.fnv('url'))} AS z FROM (SELECT DISTINCT id, url FROM pages WHERE url IS NOT NULL))
SELECT id, {duck.signed('z')} AS hash, CAST(z % 1024::UHUGEINT AS INTEGER) AS bucket, CAST(z % 2::UHUGEINT AS INTEGER) AS shard FROM g
""",
    "bloom_positions": f"""
WITH g AS (SELECT id, {duck.mix(duck.fnv('url'))} AS a, {duck.mix(duck.fnv('url', hashing.SECOND_SEED))} AS b FROM (SELECT DISTINCT id, url FROM pages WHERE url IS NOT NULL)),
o AS (SELECT id, a, CASE WHEN b % 2::UHUGEINT = 0::UHUGEINT THEN b + 1::UHUGEINT ELSE b END AS b FROM g)
SELECT id, array_to_string(list_transform(range(0, 7), lambda i: CAST((a + i::UHUGEINT * b) % {duck.U64} % 1073741824::UHUGEINT AS BIGINT)), ' ') AS positions FROM o
""",
    "simhash": f"""
WITH {duck.simhashes('SELECT doc_id, ' + duck.tokens("coalesce(text, '')") + ' AS t FROM documents', 'doc_id')}
SELECT doc_id, {duck.signed('h')} AS simhash, array_to_string(list_transform(range(0, 4), lambda i: CAST((h >> (16 * i)::UBIGINT) & 65535::UBIGINT AS INTEGER)), ' ') AS bands FROM sim
""",
    "crawl_scope": f"""
WITH {_URLS}, s AS (SELECT *, {_SEGMENTS} AS parts, regexp_extract(url, '\\?([^#]*)', 1) AS q, {duck.url_host('url')} AS host, lower(regexp_extract({duck.url_path('url')}, '[^/]\\.([^./]+)/?$', 1)) AS ext FROM u),
t AS (SELECT *, coalesce(len(parts) > 20 OR coalesce(list_max(list_transform(parts, lambda a: len(list_filter(parts, lambda b: b = a)))), 0) > 3 OR (q <> '' AND len(string_split(q, '&')) > 10), false) AS trap,
  coalesce(ext IN ('{"', '".join(urls.NON_HTML)}'), false) AS file FROM s)
SELECT seq, coalesce(url IS NOT NULL AND depth <= 10 AND octet_length(encode(url)) <= 2048 AND NOT file AND NOT trap AND NOT (host = 'lantern-harbor.example' OR ends_with(host, '.lantern-harbor.example')), false) AS allowed, trap, file FROM t
""",
    "content_hash": "SELECT DISTINCT id, sha256(coalesce(title, '') || chr(10) || coalesce(content, '')) AS hash FROM pages",
}
