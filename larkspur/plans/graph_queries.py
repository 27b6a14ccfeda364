"""Queries over the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import crawl, graph
from larkspur.plans import duck
from larkspur.session import table


def _page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.page_graph(table(spark, sf_dir, "pages").select("url", "status"), table(spark, sf_dir, "links").select("source_url", "target_url"))


def _host_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.host_graph(table(spark, sf_dir, "hosts").select("host"), table(spark, sf_dir, "links").select("source_host", "target_host"))


def edge_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In- and out-degree of every page over distinct links between pages."""
    nodes, edges = _page_graph(spark, sf_dir)
    return graph.degrees(graph.clean_edges(graph.resolve_edges(edges, nodes)), nodes)


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of all pages, until it changes by less than 1e-9 in all."""
    return graph.pagerank(*_page_graph(spark, sf_dir)).select("id", F.round("rank", 12).alias("rank"))


def hostrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over distinct links between different hosts."""
    return graph.pagerank(*_host_graph(spark, sf_dir)).select("id", F.round("rank", 12).alias("rank"))


def page_rank_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranks to write back: those that differ from the stored ones."""
    nodes, edges = _page_graph(spark, sf_dir)
    stored = table(spark, sf_dir, "pages").where("status <> 'gone' AND url IS NOT NULL").groupBy(F.col("url").alias("id")).agg(F.max(F.when(~F.isnan("page_rank"), F.col("page_rank"))).alias("old_rank"))
    return graph.changed_ranks(stored, graph.pagerank(nodes, edges)).select("id", F.round("rank", 12).alias("rank"))


def rank_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host ranks that differ from the stored ones."""
    stored = table(spark, sf_dir, "hosts").groupBy(graph.host_key(F.col("host")).alias("id")).agg(F.max("host_rank").alias("old_rank"))
    return graph.changed_ranks(stored, graph.pagerank(*_host_graph(spark, sf_dir))).select("id", F.round("rank", 12).alias("rank"))


def host_rank_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the hosts with the rank of its host."""
    hosts = table(spark, sf_dir, "hosts").select("id", "origin", graph.host_key(F.col("host")).alias("host")).distinct()
    ranks = graph.pagerank(*_host_graph(spark, sf_dir)).select(F.col("id").alias("host"), F.round("rank", 12).alias("host_rank"))
    return hosts.join(ranks, "host", "left").select("id", "origin", "host_rank")


def out_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 200 outgoing links of every page."""
    return crawl.neighbours(table(spark, sf_dir, "links"), "source_url")


def in_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 200 incoming links of every page."""
    return crawl.neighbours(table(spark, sf_dir, "links"), "target_url")


QUERIES = {f.__name__: f for f in (edge_degrees, pagerank, hostrank, rank_writeback, page_rank_writeback, host_rank_writeback, out_links, in_links)}

_PAGES = """
nodes AS MATERIALIZED (SELECT DISTINCT url AS id FROM pages WHERE status <> 'gone' AND url IS NOT NULL),
edges AS MATERIALIZED (SELECT DISTINCT source_url AS src, target_url AS dst FROM links WHERE source_url <> target_url AND source_url IN (SELECT id FROM nodes) AND target_url IN (SELECT id FROM nodes))"""
_HOSTS = f"""
nodes AS MATERIALIZED (SELECT DISTINCT {duck.host_key('host')} AS id FROM hosts WHERE host IS NOT NULL),
pairs AS (SELECT DISTINCT {duck.host_key('source_host')} AS src, {duck.host_key('target_host')} AS dst FROM links),
edges AS MATERIALIZED (SELECT src, dst FROM pairs WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""


def _ranks(graph_sql: str) -> str:
    """Power iteration that stops as the query does; ``ranks`` has the last step."""
    return f"""
WITH RECURSIVE {graph_sql}, size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes),
step(i, id, rank, deg, delta) AS (
  SELECT 0, id, 1.0::DOUBLE / n, coalesce(d.out, 0), 1.0::DOUBLE FROM nodes LEFT JOIN (SELECT src, count(*) AS out FROM edges GROUP BY src) d ON d.src = id, size
  UNION ALL
  SELECT i + 1, id, new, deg, sum(abs(new - rank)) OVER () FROM (
    SELECT s.i, s.id, s.rank, s.deg, s.delta, 0.15 / n + 0.85 * coalesce(sum(CASE WHEN s.deg = 0 THEN s.rank END) OVER (), 0) / n + 0.85 * coalesce(g.got, 0) AS new
    FROM step s LEFT JOIN (SELECT e.dst, sum(o.rank / o.deg) AS got FROM edges e JOIN step o ON o.id = e.src GROUP BY e.dst) g ON g.dst = s.id, size
  ) WHERE i < 100 AND delta >= 1e-9
), ranks AS (SELECT id, rank FROM step WHERE i = (SELECT max(i) FROM step))"""


def _links(side: str) -> str:
    return f"""
SELECT id, source_url, target_url, anchor_text FROM (
  SELECT *, row_number() OVER (PARTITION BY {side} ORDER BY id) AS n FROM (SELECT id, any_value(source_url) AS source_url, any_value(target_url) AS target_url, any_value(anchor_text) AS anchor_text FROM links WHERE {side} IS NOT NULL GROUP BY id)
) WHERE n <= 200"""


ORACLE = {
    "edge_degrees": f"WITH {_PAGES} SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = id LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = id",
    "pagerank": _ranks(_PAGES) + " SELECT id, round(rank, 12) AS rank FROM ranks",
    "hostrank": _ranks(_HOSTS) + " SELECT id, round(rank, 12) AS rank FROM ranks",
    "rank_writeback": _ranks(_HOSTS)
    + f", old AS (SELECT {duck.host_key('host')} AS id, max(host_rank) AS old FROM hosts GROUP BY 1) SELECT id, round(rank, 12) AS rank FROM ranks JOIN old USING (id) WHERE old IS NULL OR isnan(old) OR abs(rank - old) > 1e-12",
    "page_rank_writeback": _ranks(_PAGES)
    + ", old AS (SELECT url AS id, max(CASE WHEN NOT isnan(page_rank) THEN page_rank END) AS old FROM pages WHERE status <> 'gone' AND url IS NOT NULL GROUP BY 1) SELECT id, round(rank, 12) AS rank FROM ranks JOIN old USING (id) WHERE old IS NULL OR abs(rank - old) > 1e-12",
    "host_rank_writeback": _ranks(_HOSTS)
    + f" SELECT h.id AS id, origin, round(rank, 12) AS host_rank FROM (SELECT DISTINCT id, origin, {duck.host_key('host')} AS host FROM hosts) h LEFT JOIN ranks r ON r.id = h.host",
    "out_links": _links("source_url"),
    "in_links": _links("target_url"),
}
