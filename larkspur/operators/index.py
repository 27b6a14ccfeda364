"""The inverted index as DataFrames: sources, postings, lengths and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import nfkc, normalize_text, tokens_of
from larkspur.functions.urls import host_key, normalize_url, path_depth, url_text
from larkspur.schema import DEFAULTS, FIELDS
from larkspur.session import written


def anchor_texts(links: DataFrame, cap: int = DEFAULTS.anchors_per_page) -> DataFrame:
    """``url, anchor_text``: up to ``cap`` anchors of links to the page, joined by newlines.

    A page's links to itself (same URL and host) and empty anchors are left out. The first anchors by link id are kept. Spark stops at ``cap`` rows of a page
    in every task before it shuffles by page, so that a page that a third of all links point to sends ``cap`` rows a task, and no list is longer than ``cap``.
    """
    ok = (F.col("target_url").isNotNull()) & (F.trim("anchor_text") != "") & ((F.col("source_host") != F.col("target_host")) | (F.col("source_url") != F.col("target_url")))
    rows = links.where(ok).select(F.col("target_url").alias("url"), F.coalesce("id", F.lit("")).alias("id"), F.col("anchor_text").alias("text")).distinct()
    w = Window.partitionBy("url").orderBy("id", "text")
    first = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)
    whole = first.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("all"))
    return whole.select("url", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("anchor_text"))


def host_ranks(hosts: DataFrame) -> DataFrame:
    """``host, host_rank``: the highest rank of a host name over its origins."""
    return hosts.groupBy(host_key(F.col("host")).alias("host")).agg(F.max(F.when(~F.isnan("host_rank"), F.col("host_rank"))).alias("host_rank"))


def index_sources(pages: DataFrame, links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages of status ok as the index takes them up, with anchors and host rank; repeated rows of an id count once."""
    rows = pages.where("status = 'ok' AND id IS NOT NULL").select(
        F.col("id").alias("page_id"), "url", host_key(F.col("host")).alias("host"), "title", "description", "headings", "content", "language",
        F.when(~F.isnan("page_rank"), F.col("page_rank")).alias("page_rank"), "clicks", "impressions", "changed_at",
    ).dropDuplicates(["page_id"])
    anchors = anchor_texts(links).withColumnRenamed("url", "_url")
    ranks = host_ranks(hosts).withColumnRenamed("host", "_host")
    joined = rows.join(anchors, F.col("url") == F.col("_url"), "left").join(ranks, F.col("host") == F.col("_host"), "left")
    return joined.select(
        "page_id", "url", normalize_url(F.col("url")).alias("norm_url"), "host", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "headings", "content", "anchor_text")], "language",
        F.coalesce("page_rank", F.lit(0.0)).alias("page_rank"), F.coalesce("host_rank", F.lit(0.0)).alias("host_rank"),
        F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), "changed_at",
    )


def field_texts() -> dict[str, Column]:
    """The text of each searchable field of a source row."""
    return {"title": F.col("title"), "headings": F.col("headings"), "description": F.col("description"), "anchor": F.col("anchor_text"), "url": url_text(F.col("norm_url")), "body": F.col("content")}


def tokenized(sources: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """``page_id`` and ``tokens``, an array of token arrays in the order of ``FIELDS``; fields not asked for are empty."""
    texts = field_texts()
    return sources.select("page_id", F.array(*[tokens_of(nfkc(texts[f])) if f in fields else F.array().cast("array<string>") for f in FIELDS]).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """``term, page_id, tf`` (a count per field) and ``lengths`` (tokens per field of the page).

    Counted page by page before the shuffle: all tokens of a page are one row, so each (page, term) is made where the page lies.
    """
    flat = tokens.select("page_id", F.transform("tokens", lambda t: F.size(t)).alias("lengths"), F.explode(F.flatten(F.transform("tokens", lambda t, i: F.transform(t, lambda w: F.struct(w.alias("term"), i.alias("field")))))).alias("x"))
    sums = [F.count_if(F.col("x.field") == i).cast("int").alias(f"f{i}") for i in range(len(FIELDS))]
    return flat.groupBy("page_id", F.col("x.term").alias("term")).agg(*sums, F.first("lengths").alias("lengths")).select("term", "page_id", F.array(*[f"f{i}" for i in range(len(FIELDS))]).alias("tf"), "lengths")


def matching_postings(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the given terms only, straight from the token arrays: nothing is exploded or shuffled but the hits."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    flat = F.flatten("tokens")
    return tokens.where(F.arrays_overlap(flat, wanted)).select(
        F.explode(F.array_intersect(wanted, flat)).alias("term"), "page_id", "tokens"
    ).select("term", "page_id", F.transform("tokens", lambda t: F.size(F.filter(t, lambda w: w == F.col("term")))).alias("tf"), F.transform("tokens", lambda t: F.size(t)).alias("lengths"))


def corpus_stats(tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: number of documents, average length of each field (at least 1), highest page and host rank."""
    lengths = tokens.agg(F.count(F.lit(1)).alias("documents"), *[F.sum(F.size(F.get("tokens", F.lit(i)))).alias(f"l{i}") for i in range(len(FIELDS))])
    ranks = sources.agg(F.coalesce(F.max("page_rank"), F.lit(0.0)).alias("max_page_rank"), F.coalesce(F.max("host_rank"), F.lit(0.0)).alias("max_host_rank"))
    average = F.array(*[F.greatest(F.coalesce(F.col(f"l{i}") / F.nullif("documents", F.lit(0)), F.lit(1.0)), F.lit(1.0)) for i in range(len(FIELDS))])
    return lengths.join(ranks, how="cross").select("documents", average.alias("average_lengths"), "max_page_rank", "max_host_rank")  # one row each


def normalized(sources: DataFrame) -> DataFrame:
    """With the texts that phrases are sought in: ``norm_title``, and ``norm_text`` of headings, description and content together."""
    return sources.withColumn("norm_title", normalize_text(F.col("title"))).withColumn("norm_text", normalize_text(F.concat_ws("\n", "headings", "description", "content")))


@dataclass(frozen=True)
class Index:
    """A written index: the pages with their texts as phrases are sought in them, their tokens by field, the postings in order of terms, and one row of corpus statistics."""

    sources: DataFrame
    tokens: DataFrame
    postings: DataFrame
    stats: DataFrame


def write_index(sources: DataFrame, pieces: int | None = None) -> Index:
    """Write the index of ``sources`` to the shared folder.

    Postings are range-partitioned and sorted by term and page: a query's ``term IN (...)`` is pushed to the files, whose statistics skip all but the few
    row groups that have the words, and a term on every page spreads over many files. ``pieces`` is the number of tasks that take texts apart.
    """
    src = written(normalized(sources.repartition(pieces, "page_id") if pieces else sources), "sources")
    tok = written(tokenized(src), "tokens")
    posts = written(postings(tok.repartition(pieces, "page_id") if pieces else tok).repartitionByRange("term", "page_id").sortWithinPartitions("term", "page_id"), "postings")
    return Index(src, tok, posts, written(corpus_stats(tok, src), "stats"))


def depth(sources: DataFrame) -> Column:
    """Path segments of the page's URL."""
    return path_depth(sources["norm_url"])
