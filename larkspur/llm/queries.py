"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.urls import host_key, normalize_url
from larkspur.llm import boilerplate, capping, language, mixing, packing, score_fusion, seen_keys, site_lines, tokens, truncation
from larkspur.plans import duck
from larkspur.session import checkpointed, table

SCORES = {"bm25": 0, "page_rank": 6, "freshness": 8, "click_through_rate": 10}


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that take part: one row each with the four scores, impressions without their repeats."""
    rows = table(spark, sf_dir, "search_impressions").select(
        "id",
        F.transform(
            F.filter("payload.results", lambda r: (F.size(r["features"]) == 12) & ~F.exists(r["features"], lambda x: x.isNull() | F.isnan(x))),
            lambda r: F.struct(r["position"].alias("position"), *[r["features"][i].alias(s) for s, i in SCORES.items()]),
        ).alias("results"),
    )
    return rows.where(F.col("id").isNotNull()).dropDuplicates(["id"]).select("id", F.inline("results"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fusion.net_flow(_results(spark, sf_dir), "id", "position", list(SCORES))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First by net flow, checked: alone at the top of three scores and second to exactly one in the other."""
    top = _flows(spark, sf_dir).groupBy("grp").agg(F.max(F.struct("flow", (-F.col("item")).alias("minus"), "item", "above", "equal", "members")).alias("t"))
    alone = F.size(F.filter(F.arrays_zip("t.above", "t.equal"), lambda x: (x["above"] == 0) & (x["equal"] == 0)))
    second = F.exists(F.arrays_zip("t.above", "t.equal"), lambda x: (x["above"] == 1) & (x["equal"] == 0))
    return top.where((F.col("t.members") >= 4) & (alone == 3) & second).select(F.col("grp").alias("id"), F.col("t.item").alias("position"))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of each impression's results over all four scores."""
    return score_fusion.fused_rank(_flows(spark, sf_dir)).select(F.col("grp").alias("id"), F.col("item").alias("position"), (F.round("flow", 9) + 0.0).alias("flow"), "rank")


def _ok_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where("status = 'ok'").select("id", host_key(F.col("host")).alias("host"), "page_rank")
    return rows.dropDuplicates(["id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages beyond the cap of 2 % (at least 3) of their host."""
    pages = _ok_pages(spark, sf_dir)
    counts = capping.sizes(pages, "host")
    cap = capping.share_cap(counts, 0.02, 3)
    return capping.over_cap(pages, "host", "page_rank", "id", cap, counts).where(F.col("rank") > cap).select("id")


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages kept under the same cap."""
    pages = _ok_pages(spark, sf_dir)
    counts = capping.sizes(pages, "host")
    return capping.capped(pages, "host", "page_rank", "id", capping.share_cap(counts, 0.02, 3), counts).select("id", "host")


def p3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each host and how many of them are kept."""
    pages = _ok_pages(spark, sf_dir)
    counts = capping.sizes(pages, "host")
    kept = capping.capped(pages, "host", "page_rank", "id", capping.share_cap(counts, 0.02, 3), counts).groupBy("host").agg(F.count(F.lit(1)).alias("kept"))
    return counts.join(kept, counts["contributor"].eqNullSafe(kept["host"])).select(F.col("contributor").alias("host"), F.col("records").alias("pages"), "kept")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    known = table(spark, sf_dir, "pages").select(normalize_url(F.col("url")).alias("key"))
    arrivals = table(spark, sf_dir, "frontier").select(normalize_url(F.col("url")).alias("key"), "seq")
    # a shard holds about a million keys; no fewer shards than the session shuffles to
    return known, arrivals, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // (1 << 20)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals whose address is known from the pages or an earlier arrival, as the Bloom chains say (bound: 1e-6 wrong)."""
    return seen_keys.seen_before(*_keys(spark, sf_dir))


def p4_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains held against exact sets, a row for the setting of ``p4_found`` and one for a coarse one: arrivals, wrong answers, their rate, its bound and the most layers."""
    known, arrivals, shards = _keys(spark, sf_dir)
    arrivals = arrivals.where(F.col("key").isNotNull() & F.col("seq").isNotNull())
    first = arrivals.groupBy("key").agg(F.min("seq").alias("seq"))
    new = first.join(known.where("key IS NOT NULL").select("key"), "key", "left_anti").select("seq", F.lit(True).alias("new"))
    truth = checkpointed(arrivals.select("seq").dropDuplicates(["seq"]).join(new, "seq", "left"))
    wrong_yes, wrong_no = F.col("fresh").isNull() & F.col("new").isNotNull(), F.col("fresh").isNotNull() & F.col("new").isNull()
    out = None
    for setting, capacity, error in (("p4_found", 1 << 14, 5e-7), ("coarse", 1 << 10, 0.005)):
        chain = checkpointed(seen_keys.first_arrivals(known, arrivals, shards, capacity, error))
        each = truth.join(chain.where("NOT seen").select("seq", F.lit(True).alias("fresh")).dropDuplicates(["seq"]), "seq", "left")
        counts = each.agg(F.count(F.lit(1)).alias("arrivals"), F.count_if(F.col("new").isNotNull()).alias("new_keys"), F.count_if(wrong_yes).alias("wrong_yes"), F.count_if(wrong_no).alias("wrong_no"))
        layers = chain.agg(F.coalesce(F.max("layers"), F.lit(0)).alias("layers"))
        row = counts.join(layers, how="cross").select(F.lit(setting).alias("setting"), *counts.columns, (F.col("wrong_yes") / F.greatest("new_keys", F.lit(1))).alias("rate"), F.lit(2 * error).alias("bound"), "layers")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("id", "content", "language")
    label = language.first_subtag(F.col("language"))
    model = language.train(pages, "id", "content", label)
    return language.detect(pages, "id", "content", label, model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose label isn't their language, and lines in another language than their page's."""
    rows = _languages(spark, sf_dir)
    wrong = (F.col("line_no") > 0) | ~F.col("given").eqNullSafe(F.col("lang"))
    return rows.where(wrong).select("id", "line_no", "lang").dropDuplicates()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each page and foreign line, with its confidence."""
    rows = _languages(spark, sf_dir)
    return rows.groupBy("id", "line_no").agg(F.first("lang").alias("lang"), F.round(F.first("confidence"), 6).alias("confidence"), F.first("ambiguous").alias("ambiguous"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of pages that are not part of the article."""
    pages = table(spark, sf_dir, "pages").select("id", "host", "title", "headings", "content")
    return boilerplate.boilerplate_lines(pages, "id", host_key(F.col("host")), "title", "headings", "content")


def p6_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page: its length and digest."""
    pages = table(spark, sf_dir, "pages").select("id", "content")
    return boilerplate.main_text(pages, "id", "content", p6_found(spark, sf_dir)).select("id", F.char_length("body").alias("chars"), F.md5("body").alias("digest"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("id", "host", "content")
    return site_lines.line_sequences(pages, "id", host_key(F.col("host")), "content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in occurrences of the sequences that PrefixSpan finds on at least 6 pages of their host."""
    found = site_lines.PrefixSpan(_sequences(spark, sf_dir), 6).deletions()
    return found.select(F.col("doc").alias("id"), F.col("line_no").cast("int").alias("line_no"))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences of repeated lines, single lines among them, of any length and with any others between, with the number of pages that have them."""
    return site_lines.PrefixSpan(_sequences(spark, sf_dir), 6, gap=None).patterns()


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each page without the repeated lines: its length and digest."""
    pages = table(spark, sf_dir, "pages").select("id", "content")
    gone = site_lines.PrefixSpan(_sequences(spark, sf_dir), 6).deletions()
    return site_lines.without_lines(pages, "id", "content", gone).select(F.col("doc").alias("id"), F.char_length("text").alias("chars"), F.md5("text").alias("digest"))


def _windows(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r.window_name: r.capacity_tokens for r in table(spark, sf_dir, "context_windows").collect()}  # 3 rows


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = packing.sized(tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.pack(sizes, _windows(spark, sf_dir))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container each document, or piece of a document larger than the window, is in."""
    return _packs(spark, sf_dir).withColumnRenamed("doc", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each window are."""
    return packing.fill_rates(_packs(spark, sf_dir), _windows(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Goal]]:
    source = F.lower(F.trim("source"))
    goals = [mixing.Goal(r.s, r.target_share, r.max_repeats) for r in table(spark, sf_dir, "source_targets").withColumn("s", source).collect()]  # 12 rows
    wanted = table(spark, sf_dir, "documents").where(source.isin([g.source for g in goals]))
    sizes = packing.sized(tokens.token_counts(wanted, "doc_id", "text", {"source": source}))
    return mixing.mix(sizes.withColumn("weight", F.lit(1.0)), goals), goals


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their number of copies."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source that was reached."""
    return mixing.shares(*_mixed(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select(F.col("doc").alias("doc_id"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts off."""
    return truncation.truncation_rates(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_ranking, p3_found, p3_kept, p3_hosts, p4_found, p4_error_rate, p5_found, p5_languages, p6_found, p6_body, p7_found, p7_sequences, p7_cleaned, p8_packs, p8_fill, p9_mix, p9_shares, p10_found, p10_rates)
}

_HOST = r"regexp_replace(regexp_replace(lower(trim(host)), ':(80|443)$', ''), '\.$', '')"
_RESULTS = """
taking AS (
  SELECT id, r.position AS position, r.features[1] AS a, r.features[7] AS b, r.features[9] AS c, r.features[11] AS d
  FROM (SELECT id, unnest(results) AS r FROM (SELECT id, any_value(payload.results) AS results FROM search_impressions WHERE id IS NOT NULL GROUP BY id))
  WHERE len(r.features) = 12 AND len(list_filter(r.features, lambda x: x IS NULL OR isnan(x))) = 0
)"""

_REPEATED = f"""
WITH p AS (SELECT id, any_value({_HOST}) AS host, any_value(content) AS content FROM pages WHERE content IS NOT NULL GROUP BY id),
l AS (SELECT id, host, generate_subscripts(string_split(content, chr(10)), 1) AS line_no, unnest(string_split(content, chr(10))) AS line FROM p),
k AS (
  SELECT id, host, line_no,
    trim(regexp_replace(lower(line), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g')) AS line
  FROM l
), f AS (SELECT host, line FROM k WHERE length(line) >= 16 GROUP BY 1, 2 HAVING count(DISTINCT id) >= 6)"""

_BLANKS = duck.text(" \t\n\r\x0b\x0c\ufffd")
_CLOSERS = duck.text(" \t\n\r\x0b\x0c\ufffd)]}»”’」』）】\"'")
# apostrophes between letters are put aside as two private characters while signs are parted
_ASIDE = "body"
for _ in range(2):
    for _sign, _private in (("\\x27", "\ue000"), ("’", "\ue001")):
        _ASIDE = f"regexp_replace({_ASIDE}, '([\\p{{L}}\\p{{M}}]){_sign}([\\p{{L}}\\p{{M}}])', '\\1{_private}\\2', 'g')"
_CJK = r"\x{3005}-\x{3007}\x{3041}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_CUT = rf"""
texts AS (SELECT md5(text) AS k, min(text) AS text, min(lower(trim(source))) AS source FROM documents WHERE text IS NOT NULL AND rtrim(text, {_BLANKS}) <> '' GROUP BY md5(text)),
ended AS (SELECT k, source, length(text) AS chars, octet_length(encode(text)) AS bytes, right(rtrim(text), 1) = chr(65533) AS torn, rtrim(text, {_BLANKS}) AS body FROM texts),
unmarked AS (
  SELECT *, CASE WHEN right(body, 1) IN ('…', ']', ')') OR right(body, 3) = '...'
    THEN rtrim(regexp_replace(body, '(\s*(\[\s*(\.\.\.|…)\s*\]|\(\s*(\.\.\.|…)\s*\)|…+|\.\.\.+))+$', ''), {_BLANKS}) ELSE body END AS bare FROM ended
), closed AS (
  SELECT k, source, chars, bytes, bare, length(bare) < length(body) AS marked, right(rtrim(bare, {_CLOSERS}), 1) IN ('.', '!', '?', '。', '！', '？') AS stopped,
    torn OR regexp_matches(right(body, 12), '(^|\s)&#?\w{{0,8}}$') OR (contains(body, '<') AND regexp_matches(string_split(body, '<')[-1], '^[a-zA-Z/!][^>]*$')) AS broken FROM unmarked
), parted AS (
  SELECT k, source, chars, bytes, marked, broken, stopped AND NOT regexp_matches(right(bare, 2), '\d[.]') AND NOT marked AS whole, regexp_extract(right(bare, 60), '(\S)\S*$', 1) AS head,
    regexp_replace(lower(regexp_replace(translate(bare, chr(9) || chr(13) || chr(11) || chr(12), '    '), '(\p{{Lu}}\p{{L}}+)(\s\d)', '№\2', 'g')), '\d+(?:[.,:]\d+)*', ' 0 ', 'g') AS body FROM closed
), spaced AS (
  SELECT * EXCLUDE body, translate(regexp_replace({_ASIDE}, '([{_CJK}]|[^\s\p{{L}}\p{{M}}\p{{N}}\x{{e000}}\x{{e001}}])', ' \1 ', 'g'), chr(57344) || chr(57345), chr(39) || '’') AS body FROM parted
), lined AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l, {_BLANKS})), lambda l: l <> '') AS lines, trim(string_split(body, chr(10))[-1], {_BLANKS}) AS last FROM spaced),
flat AS (SELECT len(lines) AS m, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line FROM lined),
words AS (SELECT m, n, regexp_split_to_array(line, ' +') AS w FROM flat),
grams AS (SELECT m, n, len(w) AS size, i, w[i] AS c, CASE WHEN i < 2 THEN '^' ELSE w[i - 1] END AS b, CASE WHEN i < 3 THEN '^' ELSE w[i - 2] END AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
counted AS MATERIALIZED (SELECT a, b, c, count(*) FILTER (WHERE i < size) AS go, count(*) FILTER (WHERE i = size AND n < m) AS inner_end, count(*) FILTER (WHERE i = size AND n = m) AS text_end FROM grams GROUP BY a, b, c),
finals AS MATERIALIZED (
  SELECT k, marked, broken, head, source, chars, bytes, w[-1] AS c, CASE WHEN len(w) < 2 THEN '^' ELSE w[-2] END AS b, CASE WHEN len(w) < 3 THEN '^' ELSE w[-3] END AS a
  FROM (SELECT *, regexp_split_to_array(last, ' +') AS w FROM lined WHERE (NOT whole OR broken) AND last <> '')
), lengths AS (SELECT source, kind, len, count(*) AS n FROM (SELECT source, 'c' AS kind, chars AS len FROM lined UNION ALL SELECT source, 'b', bytes FROM lined) GROUP BY source, kind, len),
limits AS (SELECT source, kind, len FROM (SELECT *, sum(n) OVER (PARTITION BY source, kind ORDER BY len RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - n AS near FROM lengths) WHERE n >= 5 AND n >= 4 * near / 20.0 + 3),
begun AS (SELECT a, b, p, sum(n) AS n FROM (SELECT a, b, go + inner_end AS n, unnest(list_transform(range(1, length(c)), lambda i: substring(c, 1, i))) AS p FROM counted WHERE length(c) > 1 AND go + inner_end > 0) GROUP BY a, b, p),
pairs AS MATERIALIZED (SELECT b, c, sum(go) AS go, sum(inner_end) AS inner_end, sum(text_end) AS text_end FROM counted GROUP BY b, c),
pairs_begun AS (SELECT b, p, sum(n) AS n FROM (SELECT b, go + inner_end AS n, unnest(list_transform(range(1, length(c)), lambda i: substring(c, 1, i))) AS p FROM pairs WHERE length(c) > 1 AND go + inner_end > 0) GROUP BY b, p),
judged AS (
  SELECT f.k, coalesce(t.go, 0) AS go, coalesce(t.inner_end, 0) + greatest(coalesce(t.text_end, 0) - 1, 0) AS ends, coalesce(p.n, 0) AS begun, coalesce(q.go, 0) AS pair_go,
    coalesce(q.inner_end, 0) + greatest(coalesce(q.text_end, 0) - 1, 0) AS pair_ends, coalesce(pb.n, 0) AS pair_begun, coalesce(m.go, 0) AS name_go, coalesce(m.inner_end, 0) AS name_ends, f.marked, f.broken, f.head,
    EXISTS (SELECT 1 FROM limits l WHERE l.source IS NOT DISTINCT FROM f.source AND ((l.kind = 'c' AND l.len = f.chars) OR (l.kind = 'b' AND l.len = f.bytes))) AS at_limit
  FROM finals f LEFT JOIN counted t ON f.a = t.a AND f.b = t.b AND f.c = t.c LEFT JOIN begun p ON f.a = p.a AND f.b = p.b AND f.c = p.p LEFT JOIN counted m ON f.a = m.a AND f.b = m.b AND m.c = '№'
  LEFT JOIN pairs q ON f.b = q.b AND f.c = q.c LEFT JOIN pairs_begun pb ON f.b = pb.b AND f.c = pb.p
), cut AS (
  SELECT k FROM judged WHERE broken OR (go >= 3 AND ends <= 0.1 * (go + ends)) OR ((marked OR at_limit) AND (go >= 1 OR ends = 0)) OR (begun >= 3 AND go + ends <= 0.1 * begun)
    OR (go + ends = 0 AND pair_go >= 5 AND pair_ends <= 0.02 * (pair_go + pair_ends)) OR (go + ends + begun = 0 AND pair_begun >= 5 AND pair_go + pair_ends <= 0.02 * pair_begun)
    OR (regexp_matches(head, '^\p{{Lu}}') AND go + ends = 0 AND name_go >= 3 AND name_ends <= 0.1 * (name_go + name_ends))
)"""

ORACLE = {
    "p10_found": f"WITH {_CUT} SELECT doc_id FROM documents WHERE md5(text) IN (SELECT k FROM cut)",
    "p10_rates": f"""
WITH {_CUT}, d AS (SELECT lower(trim(source)) AS source, CASE WHEN md5(text) IN (SELECT k FROM cut) THEN 1 ELSE 0 END AS c FROM documents)
SELECT source, count(*) AS documents, CAST(sum(c) AS BIGINT) AS cut_documents, round(sum(c) / count(*)::DOUBLE, 9) AS rate FROM d GROUP BY source
""",
    "p2_found": f"""
WITH {_RESULTS}, n AS (SELECT id, count(*) AS n FROM taking GROUP BY id HAVING count(*) >= 4),
r AS (
  SELECT t.id, t.position,
    (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.a > t.a) AS a1, (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.a = t.a) AS a2,
    (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.b > t.b) AS b1, (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.b = t.b) AS b2,
    (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.c > t.c) AS c1, (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.c = t.c) AS c2,
    (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.d > t.d) AS d1, (SELECT count(*) FROM taking o WHERE o.id = t.id AND o.d = t.d) AS d2
  FROM taking t JOIN n USING (id)
)
SELECT id, position FROM r WHERE a2 = 1 AND b2 = 1 AND c2 = 1 AND d2 = 1 AND a1 + b1 + c1 + d1 = 1
""",
    # all pairs of an impression: results are few there
    "p2_ranking": f"""
WITH {_RESULTS}, n AS (SELECT id, count(*) AS n FROM taking GROUP BY id),
long AS (SELECT id, position, unnest([1, 2, 3, 4]) AS k, unnest([a, b, c, d]) AS v FROM taking),
pct AS (SELECT x.id, x.position, x.k, (count(*) FILTER (WHERE y.v < x.v) + (count(*) FILTER (WHERE y.v = x.v) - 1) / 2.0::DOUBLE) / greatest(any_value(n) - 1, 1) AS r FROM long x JOIN long y ON y.id = x.id AND y.k = x.k JOIN n ON n.id = x.id GROUP BY x.id, x.position, x.k),
flows AS (
  SELECT x.id, x.position, sum(least(greatest((x.r - y.r) / 0.5, 0), 1) - least(greatest((y.r - x.r) / 0.5, 0), 1)) / 4 / greatest(any_value(n) - 1, 1) AS flow
  FROM pct x JOIN pct y ON y.id = x.id AND y.k = x.k JOIN n ON n.id = x.id GROUP BY x.id, x.position
)
SELECT id, position, round(flow, 9) + 0.0::DOUBLE AS flow, CAST(row_number() OVER (PARTITION BY id ORDER BY round(flow, 12) DESC, position) AS INTEGER) AS rank FROM flows
""",
    "p3_found": f"""
WITH p AS (SELECT id, any_value({_HOST}) AS host, any_value(page_rank) AS page_rank FROM pages WHERE status = 'ok' GROUP BY id),
r AS (
  SELECT id, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN isnan(page_rank) THEN NULL ELSE page_rank END DESC NULLS LAST, id) AS rank,
    greatest(3, floor(0.02 * (SELECT count(*) FROM p))) AS cap FROM p
)
SELECT id FROM r WHERE rank > cap
""",
    "p3_kept": f"""
WITH p AS (SELECT id, any_value({_HOST}) AS host, any_value(page_rank) AS page_rank FROM pages WHERE status = 'ok' GROUP BY id),
r AS (
  SELECT id, host, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN isnan(page_rank) THEN NULL ELSE page_rank END DESC NULLS LAST, id) AS rank,
    greatest(3, floor(0.02 * (SELECT count(*) FROM p))) AS cap FROM p
)
SELECT id, host FROM r WHERE rank <= cap
""",
    "p3_hosts": f"""
WITH p AS (SELECT id, any_value({_HOST}) AS host FROM pages WHERE status = 'ok' GROUP BY id)
SELECT host, count(*) AS pages, CAST(least(count(*), greatest(3, floor(0.02 * (SELECT count(*) FROM p)))) AS BIGINT) AS kept FROM p GROUP BY host
""",
    "p4_found": f"""
WITH f AS (SELECT seq, {duck.normalize_url('url')} AS key FROM frontier WHERE seq IS NOT NULL), p AS (SELECT DISTINCT {duck.normalize_url('url')} AS key FROM pages),
k AS (SELECT key, min(seq) AS seq FROM f WHERE key IS NOT NULL GROUP BY key)
SELECT DISTINCT f.seq FROM f JOIN k USING (key) WHERE f.seq > k.seq OR key IN (SELECT key FROM p WHERE key IS NOT NULL)
""",
    "p7_found": f"{_REPEATED} SELECT id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (host, line)",
    "p7_cleaned": f"""
{_REPEATED}, x AS (SELECT id, k.line_no AS line_no FROM k JOIN f USING (host, line)), o AS (SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body FROM l LEFT JOIN x ON x.id = l.id AND x.line_no = l.line_no WHERE x.id IS NULL GROUP BY l.id)
SELECT p.id AS id, CAST(length(coalesce(body, '')) AS INTEGER) AS chars, md5(coalesce(body, '')) AS digest FROM p LEFT JOIN o ON o.id = p.id
""",
}
