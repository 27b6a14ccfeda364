"""Queries do the whole job: nothing is sampled, cut at a length or left behind."""

import uuid

import pytest
from pyspark.sql import functions as F

from larkspur.operators import crawl, graph
from larkspur.plans import crawl_queries, graph_queries


def _frontier(spark, path, rows):
    df = spark.createDataFrame(rows, "origin string, url string, depth int, retries int, kind string, seq long")
    df.withColumn("next_allowed_at", F.lit(None).cast("timestamp")).coalesce(1).write.parquet(f"{path}/frontier.parquet")
    return str(path)


def test_retry_queue_takes_every_entry_with_retries_left(spark, tmp_path):
    rows = [("o", f"u{i}", i, i % 4, "sitemap" if i == 6 else "page", i) for i in range(12)]
    got = sorted(tuple(r) for r in crawl_queries.retry_queue(spark, _frontier(spark, tmp_path, [*rows, rows[1]])).collect())
    assert got == [(i, i % 4 + 1, -1 if i == 6 else i + 2 * (i % 4 + 1)) for i in range(12) if i % 4 < 3]


def _fixed_point(nodes, edges):
    out = {n: {b for a, b in edges if a == n and b != n} for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(500):
        spread = sum(rank[n] for n in nodes if not out[n])
        rank = {n: (0.15 + 0.85 * spread) / len(nodes) + 0.85 * sum(rank[m] / len(out[m]) for m in nodes if n in out[m]) for n in nodes}
    return rank


def test_ranks_are_those_that_stand(spark, tmp_path):
    # a ring with a tail: it converges slowly
    nodes = [f"h{i}.example" for i in range(8)]
    edges = [(nodes[i], nodes[(i + 1) % 7]) for i in range(7)] + [(nodes[0], nodes[7]), (nodes[3], nodes[0])]
    links = [(f"https://{a}/", a, f"https://{b}/", b) for a, b in edges]
    spark.createDataFrame([(f"https://{n}/", "ok") for n in nodes], "url string, status string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(links, "source_url string, source_host string, target_url string, target_host string").write.parquet(f"{tmp_path}/links.parquet")
    want = _fixed_point(nodes, edges)
    stored = [(n, want[n] if i == 2 else 0.5) for i, n in enumerate(nodes)]
    spark.createDataFrame(stored, "host string, host_rank double").write.parquet(f"{tmp_path}/hosts.parquet")
    got = {q: {r.id.removeprefix("https://").rstrip("/"): r["rank"] for r in graph_queries.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("pagerank", "hostrank", "rank_writeback")}
    assert got["pagerank"] == pytest.approx(want, abs=1e-8) and got["hostrank"] == pytest.approx(want, abs=1e-8)
    back = got["rank_writeback"]
    assert back == pytest.approx({n: want[n] for n in back}, abs=1e-8) and set(nodes) - set(back) <= {nodes[2]}


def _jobs(spark, run):
    """What ``run`` gives, and how many jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_page_ranks_are_written_back_in_few_jobs(spark, tmp_path):
    # a ring with a tail takes over 60 iterations; a job for each was what took the time
    nodes = [f"h{i}" for i in range(8)]
    edges = [(nodes[i], nodes[(i + 1) % 7]) for i in range(7)] + [(nodes[0], nodes[7]), (nodes[3], nodes[0])]
    want = _fixed_point(nodes, edges)
    pages = [(n, "ok", want[n] + 1e-3 if i else None) for i, n in enumerate(nodes)] + [("old", "gone", 0.5), (None, "ok", 0.5)]
    spark.createDataFrame(pages, "url string, status string, page_rank double").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([*edges, ("old", "h1"), ("h1", "old"), ("h2", "h2")], "source_url string, target_url string").write.parquet(f"{tmp_path}/links.parquet")
    got, jobs = _jobs(spark, lambda: {r.id: r["rank"] for r in graph_queries.page_rank_writeback(spark, str(tmp_path)).collect()})
    assert got == pytest.approx(want, abs=1e-8) and jobs < 60


def _power(nodes, edges, iterations, tolerance):
    """Ranks and the number of iterations, step by step."""
    out = {n: {b for a, b in edges if a == n and b in nodes and b != n} for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for i in range(iterations):
        old, spread = rank, sum(rank[n] for n in nodes if not out[n])
        rank = {n: (0.15 + 0.85 * spread) / len(nodes) + 0.85 * sum(old[m] / len(out[m]) for m in nodes if n in out[m]) for n in nodes}
        if sum(abs(rank[n] - old[n]) for n in nodes) < tolerance:
            break
    return rank, i + 1


@pytest.mark.parametrize(("iterations", "tolerance", "block"), [(0, 1e-9, 5), (13, 1e-9, 5), (13, 1e-9, 10**6), (100, 1e-7, 5), (100, 1e-7, 10**6)])
def test_pagerank_in_blocks(spark, iterations, tolerance, block):
    # slow to converge, with nodes that no edge leaves or reaches, in one block or in four that exchange sums
    nodes = [f"n{i}" for i in range(24)]
    edges = [(nodes[i], nodes[(i + 1) % 20]) for i in range(20)] + [("n0", "n20"), ("n3", "n20"), ("n4", "n0"), ("n20", "n1"), ("n21", "n5"), ("n7", "n22"), ("n5", "n6"), ("n6", "n6"), ("n6", "x"), ("x", "n6"), (None, "n6"), ("n6", None)]
    want, steps = _power(nodes, edges, iterations, tolerance) if iterations else (dict.fromkeys(nodes, 1 / 24), 0)
    frames = spark.createDataFrame([(n,) for n in [*nodes, "n3", None]], "id string"), spark.createDataFrame(edges, "src string, dst string")
    got, jobs = _jobs(spark, lambda: {r.id: r["rank"] for r in graph.pagerank(*frames, iterations=iterations, tolerance=tolerance, block=block).collect()})
    assert got == pytest.approx(want, abs=1e-14)
    assert steps < 20 or jobs < steps


def test_pagerank_takes_few_jobs_whatever_a_hub_links(spark, tmp_path):
    # a long ring, of which one page links to every page and a third of them link to it, some links told many times; a job for each iteration was what took the time
    nodes = [f"n{i:02}" for i in range(30)]
    edges = [(nodes[i], nodes[(i + 1) % 30]) for i in range(30)] + [("n00", n) for n in nodes] + [(n, "n00") for n in nodes[20:]]
    want, steps = _power(nodes, edges, 100, 1e-9)
    spark.createDataFrame([(n, "ok") for n in nodes] + [("old", "gone"), (None, "ok"), ("n07", "ok")], "url string, status string").write.parquet(f"{tmp_path}/pages.parquet")
    links = [*edges, *edges[:40] * 5, ("old", "n01"), ("n01", "old")]
    spark.createDataFrame(links, "source_url string, target_url string").write.parquet(f"{tmp_path}/links.parquet")
    got, jobs = _jobs(spark, lambda: {r.id: r["rank"] for r in graph_queries.pagerank(spark, str(tmp_path)).collect()})
    assert got == pytest.approx(want, abs=1e-12) and jobs < steps
    parts = graph.pagerank(*graph_queries._page_graph(spark, str(tmp_path)), block=20)
    assert {r.id: r["rank"] for r in parts.collect()} == pytest.approx(want, abs=1e-14)


def test_near_dups_give_every_document_its_class(spark, tmp_path):
    text = "one two three four five six seven eight"
    docs = [("c", text, 3), ("a", text, 1), ("b", text, 2), ("x", "quite another text stands here alone", 1), ("e", "", 1), ("c", text, 3)]
    df = spark.createDataFrame(docs, "doc_id string, text string, n int").withColumn("fetched_at", F.timestamp_seconds("n")).drop("n")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.leader, r.bits, r.links) for r in crawl_queries.near_dups(spark, str(tmp_path)).collect()}
    assert got == {"a": ("a", 0, 2), "b": ("a", 0, 2), "c": ("a", 0, 2), "x": ("x", 0, 0)}


def test_near_duplicate_pages_in_a_chain(spark):
    base = 0b1011 << 40
    rows = [("p", base, 1), ("q", base ^ 0b111, 2), ("r", base ^ 0b111111, 3), ("s", base, 9)]
    df = spark.createDataFrame(rows, "id string, simhash long, n int").withColumn("fetched_at", F.timestamp_seconds("n"))
    got = {r.id: (r.leader, r.bits, r.links) for r in crawl.near_duplicate_pages(df, "id").collect()}
    assert got == {"p": ("p", 0, 2), "q": ("p", 3, 3), "r": ("r", 0, 1), "s": ("p", 0, 2)}


def test_near_duplicates_settle_chains_of_any_length(spark):
    # each hash is two bits from the one before and four from the one before that: every second leads
    chain = [0]
    for i in range(69):
        a, b = (2 * i) % 64, (2 * i + 1) % 64
        chain.append(chain[-1] ^ (1 << a) ^ (1 << b) if i < 32 else chain[-1] ^ (1 << a) ^ (1 << ((b + 2) % 64)))
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(chain)], "simhash long, n int").withColumn("fetched_at", F.timestamp_seconds("n"))
    want, leaders = {}, []
    for x in dict.fromkeys(chain):
        near = [y for y in leaders if (x ^ y).bit_count() <= 3]
        if near:
            want[x] = near[0]
        else:
            leaders.append(x)
    got = {r.simhash % (1 << 64): r.original % (1 << 64) for r in crawl.near_duplicates(rows).collect()}
    assert got == want
