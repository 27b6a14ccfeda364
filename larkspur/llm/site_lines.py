"""Problem 7: lines that come back on many documents of one site.

PrefixSpan over the documents' sequences of line identifiers, source by source. Its databases are tables of occurrences: level 1 has
those of the frequent lines, and each further level projects them: an occurrence of a frequent sequence is extended by the frequent lines
behind its end, as far as ``gap`` other frequent lines may stand between, and the extended sequences are counted. Support is the number of distinct
documents. It ends when no sequence of a level is frequent.

The lines to delete are those of all occurrences of frequent sequences, single lines among them. Every line of a frequent sequence is
frequent itself, with at least its support, so that the occurrences of level 1 are already all of them: who only deletes need not go on to level 2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.urls import SPACES
from larkspur.operators.skew import spread_semi_join
from larkspur.session import checkpointed


# white space but for line ends; most characters are visible ASCII, told first
BLANKS = f"(?![!-~])[{SPACES[1:-1]}\\x{{1c}}-\\x{{1f}}&&[^\\n]]+"


def same_lines(text: Column) -> Column:
    """The lines of a text in lower case, trimmed, each run of white space one space. One pass over the text, before it is divided."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), BLANKS, " "), "\n", -1), lambda line: F.trim(line))


def line_sequences(docs: DataFrame, ident: str, source: Column, text: str, min_chars: int = 16) -> DataFrame:
    """One row per document: ``doc``, ``source`` (hashed) and ``lines``, a 64-bit identifier per line, null where it doesn't count.

    Within one source two of n different lines share an identifier with a chance of n*n/2**65. Rows of one
    document count once. Null texts have no lines. Written to the shared folder, as it is read again and again.
    """

    def key(line: Column) -> Column:
        return F.when(F.length(line) >= min_chars, F.xxhash64(line))

    rows = docs.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(
        F.col(ident).alias("doc"), F.xxhash64(source).alias("source"), F.transform(same_lines(F.col(text)), key).alias("lines")
    )
    return checkpointed(rows.dropDuplicates(["doc"]))


def frequent_lines(sequences: DataFrame, min_docs: int) -> DataFrame:
    """Level 1: ``source``, ``line`` and ``docs`` where at least ``min_docs`` documents of the source have the line."""
    items = sequences.select("source", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
    return items.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)


def occurrences(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """``doc``, ``source``, ``line_no`` (from 1) and ``line`` of each frequent line.

    A line on very many pages of a dominant site meets its table row in several tasks, as many as its support asks for.
    """
    rows = sequences.select("doc", "source", F.posexplode("lines").alias("at", "line")).where(F.col("line").isNotNull())
    rows = rows.select("doc", "source", (F.col("at") + 1).alias("line_no"), "line")
    return spread_semi_join(rows, frequent, ["source", "line"], "docs", "doc")


@dataclass
class PrefixSpan:
    """The frequent sequences of a table of line sequences (``line_sequences``), level by level."""

    sequences: DataFrame
    min_docs: int
    gap: int | None = 0
    max_length: int | None = None

    def singles(self) -> DataFrame:
        """Level 1: ``source, length, lines, docs``."""
        return frequent_lines(self.sequences, self.min_docs).select("source", F.lit(1).alias("length"), F.array("line").alias("lines"), "docs")

    def projection(self) -> DataFrame:
        """The occurrences of level 1: ``doc, source, line_no, line``."""
        level = self.singles().select("source", F.element_at("lines", 1).alias("line"), "docs")
        return occurrences(self.sequences, level)

    def deletions(self) -> DataFrame:
        """``doc, line_no`` of every line in an occurrence of a frequent sequence, a single line or longer."""
        return self.projection().select("doc", "line_no")

    def patterns(self) -> DataFrame:
        """All frequent sequences: ``source, length, lines`` (identifiers in order) and ``docs``."""
        found = checkpointed(self.projection())
        longer = frequent_sequences(found, self.min_docs, self.max_length) if self.gap == 0 else gapped_sequences(found, self.min_docs, self.gap, self.max_length)
        return self.singles().unionByName(longer)


def without_lines(docs: DataFrame, ident: str, text: str, deletions: DataFrame) -> DataFrame:
    """``doc`` and ``text`` without the lines of ``deletions`` (``doc, line_no``); documents with null texts are left out, those without such lines stay as they are."""
    gone = deletions.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))  # as many as the document has lines
    rows = docs.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("doc"), F.col(text).alias("text")).dropDuplicates(["doc"])
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", i + 1), F.lit(False)))
    return rows.join(gone, rows["doc"] == gone["_doc"], "left").select("doc", F.array_join(kept, "\n").alias("text"))


def gapped_sequences(found: DataFrame, min_docs: int, gap: int | None, max_length: int | None = None) -> DataFrame:
    """All levels from 2 on of sequences with up to ``gap`` other frequent lines between two of theirs (any number if None); columns as in ``frequent_sequences``.

    Their number can grow with a power of 2 + gap in the length of what pages have in common. A projected row is the end of an occurrence: of several
    that end alike one goes on.
    """
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))
    placed = checkpointed(found.select("source", "doc", nth.alias("at"), "line"))
    reach = Window.partitionBy("doc").orderBy("at").rowsBetween(1, Window.unboundedFollowing if gap is None else gap + 1)
    steps = checkpointed(placed.select("doc", "at", F.collect_list(F.struct("at", "line")).over(reach).alias("ahead")))  # at most gap + 1, or the page's lines
    alive, level, out, n = placed.select("source", "doc", "at", F.xxhash64("line").alias("pattern")), None, None, 2
    names = placed.groupBy("source", F.xxhash64("line").alias("pattern")).agg(F.first("line").alias("line")).select("source", "pattern", F.array("line").alias("lines"))
    while max_length is None or n <= max_length:
        ahead = alive.join(steps, ["doc", "at"]).select("source", "doc", "pattern", F.explode("ahead").alias("x"))
        grown = ahead.select("source", "doc", F.col("x.at").alias("at"), F.xxhash64("pattern", "x.line").alias("next"), F.col("pattern").alias("prefix"), F.col("x.line").alias("last")).dropDuplicates(["doc", "at", "next"])
        docs = (
            grown.groupBy("source", "next", "doc").agg(F.first("prefix").alias("prefix"), F.first("last").alias("last"))
            .groupBy("source", "next").agg(F.count(F.lit(1)).alias("docs"), F.first("prefix").alias("prefix"), F.first("last").alias("last")).where(F.col("docs") >= min_docs)
        )
        named = docs.join(names.select("source", F.col("pattern").alias("prefix"), F.col("lines").alias("before")), ["source", "prefix"])
        level = checkpointed(named.select("source", F.col("next").alias("pattern"), F.lit(n).alias("length"), F.concat("before", F.array("last")).alias("lines"), "docs"))
        out = level if out is None else out.unionByName(level)
        if not level.limit(1).count():
            break
        alive = checkpointed(spread_semi_join(grown.select("source", "doc", "at", F.col("next").alias("pattern")), level, ["source", "pattern"], "docs", "doc"))
        names, n = level.select("source", "pattern", "lines"), n + 1
    return out.drop("pattern")


def frequent_sequences(found: DataFrame, min_docs: int, max_length: int | None = None) -> DataFrame:
    """All levels from 2 on (to ``max_length``, if given): ``source``, ``length``, ``lines`` (identifiers in order) and ``docs``.

    Sequences are runs of frequent lines, other lines between them left out. Each level keeps only the occurrences whose sequence is frequent and
    joins each to that of the next line, until no sequence is frequent: a run of n + 1 lines is frequent only if its first and last n are.
    """
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))
    alive = checkpointed(found.select("source", "doc", nth.alias("at"), F.col("line").alias("pattern"), F.col("line").alias("last")))
    ahead = Window.partitionBy("doc").orderBy("at")
    out, level, n = None, None, 2
    while max_length is None or n <= max_length:
        follows = F.lead("at").over(ahead) == F.col("at") + 1
        grown = alive.select("source", "doc", "at", F.col("pattern").alias("prefix"), F.lead("pattern").over(ahead).alias("suffix"), F.lead("last").over(ahead).alias("next"), follows.alias("follows"))
        grown = grown.where("follows").select("source", "doc", "at", "prefix", F.xxhash64("prefix", "suffix").alias("pattern"), F.col("next").alias("last"))
        docs = (
            grown.select("source", "doc", "pattern", "prefix", "last").dropDuplicates(["source", "pattern", "doc"])
            .groupBy("source", "pattern").agg(F.count(F.lit(1)).alias("docs"), F.first("prefix").alias("prefix"), F.first("last").alias("last"))
            .where(F.col("docs") >= min_docs)
        )
        if level is None:
            docs = docs.withColumn("before", F.array("prefix"))
        else:
            docs = docs.join(level.select("source", F.col("pattern").alias("prefix"), F.col("lines").alias("before")), ["source", "prefix"])
        level = checkpointed(docs.select("source", "pattern", F.lit(n).alias("length"), F.concat("before", F.array("last")).alias("lines"), "docs"))
        out = level if out is None else out.unionByName(level)
        if not level.limit(1).count():
            break
        alive = checkpointed(spread_semi_join(grown.select("source", "doc", "at", "pattern", "last"), level, ["source", "pattern"], "docs", "doc"))
        n += 1
    return out.drop("pattern")
