"""Problem 6: the article of each page, by wrapper induction over the pages of each host.

Pages come as lines of text, so that the tree of a page is: page, lines, and for menus and breadcrumbs the items of the line.
A line's label is its text in lower case without bullet, with numbers, the site's name and the page's title masked (lines that differ
in numbers only are one node); all menus have one label and their items are their children. Pages of one host are aligned in pairs by simple tree
matching: the greatest number of matched nodes with order kept, where two nodes match if their labels are equal, and bring the nodes that match
best below them. A label that is matched in many of its comparisons is constant: part of the template. Labels are judged over all hosts that have
them (the mean of the hosts' shares), and where too few hosts do, on the host alone; so that a host with a single page
profits from the others. A line that is the title of another page of its host is a link to it and belongs to the template's boxes of related
pages. All other nodes are varying slots: content. Lines of every length take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.skew import spread_semi_join
from larkspur.session import written

TITLE, ITEM, MENU = 1, 2, 1
ITEM_CHARS, CACHE = 40, 100_000
BULLETS = "-*•»·>–"
WIDE = re.compile(r"\s{3,}")
BETWEEN = re.compile(r"\s+[|/·>»•]\s+")
DIGITS = re.compile(r"\d+")
LISTED = re.compile(r"^([^:：]{2,30}?)\s*[:：]\s*[^,、，:：0{]{1,24}(?:[,、，][^,、，:：0{]{1,24})+$")
NODES = "id string, host bigint, own bigint, line array<int>, label array<bigint>, kind array<int>"
VOTES = "host bigint, label bigint, seen bigint, compared bigint, matched bigint"


def _plain(line: str) -> str:
    return " ".join(WIDE.sub(" | ", line.strip()).split()).lower()


class _Labels:
    """Labels and kind of a line; short lines are kept, as templates repeat them."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[tuple[int, ...], int]] = {}

    def of(self, line: str) -> tuple[tuple[int, ...], int]:
        got = self.known.get(line)
        if got is None:
            got = self._make(line)
            if len(line) <= 80:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[line] = got
        return got

    @staticmethod
    def _make(line: str) -> tuple[tuple[int, ...], int]:
        text = line[2:] if len(line) > 1 and line[0] in BULLETS and line[1] == " " else line
        d = DIGITS.sub("0", text)
        items = BETWEEN.split(d)
        if len(items) > 1:
            items = [x for x in items if "{title}" not in x] or items
            if all(len(x) <= ITEM_CHARS for x in items):
                return tuple(xxhash.xxh64_intdigest(x) for x in items), ITEM
        m = LISTED.match(d) if len(d) <= 300 else None  # a name and a list of short values: no longer than that
        return (xxhash.xxh64_intdigest(m[1] + ":{list}" if m else d),), 0


def _site(host: str | None) -> list[str]:
    """The site's name as pages write it: the words of the host's registered label, with and without the last."""
    parts = (host or "").split(".")
    words = parts[-2].split("-") if len(parts) > 1 else []
    return [" ".join(w) for w in (words, words[:-1]) if len(w) > 1]


def _masked(line: str, sites: list[str], title: str) -> str:
    for s in sites:
        if s in line:
            line = line.replace(s, "{site}")
            break
    return line.replace(title, "{title}") if len(title) >= 8 and title in line else line


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels = _Labels()
    for b in batches:
        lines, marks, kinds, sizes, own = [], [], [], [], []
        for host, title, content in zip(*(b.column(c).to_pylist() for c in ("site", "title", "content")), strict=True):
            sites, title, start = _site(host), _plain(title or ""), len(lines)
            mine, kind = labels.of(_masked(title, sites, "")) if title else ((), ITEM)
            own.append(None if kind & ITEM else mine[0])
            for no, raw in enumerate(content.split("\n"), 1):
                line = _plain(raw)
                if not line:
                    continue
                got, kind = ((0,), TITLE) if line == title else labels.of(_masked(line, sites, title))
                for x in got:
                    lines.append(no)
                    marks.append(x)
                    kinds.append(kind)
            sizes.append(len(lines) - start)
        offs = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        whole = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        titles = pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in own], pa.int64())
        values = (pa.array(lines, pa.int32()), whole(marks), pa.array(kinds, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), titles, *[pa.ListArray.from_arrays(offs, v) for v in values]], names=["id", "host", "own", "line", "label", "kind"])


def best_match(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pairs at once, the matched children (pair, i, j) in order that bring the greatest sum of ``weight[pair, i, j]``; 0 is no match."""
    ra, rb = weight.any(2), weight.any(1)
    n, m = int(ra.sum(1).max(initial=0)), int(rb.sum(1).max(initial=0))
    ia, ib = np.argsort(~ra, 1, kind="stable")[:, :n], np.argsort(~rb, 1, kind="stable")[:, :m]
    p = np.arange(len(weight))
    e = weight[p[:, None, None], ia[:, :, None], ib[:, None, :]]  # only nodes with a partner on the other side
    best = np.zeros((len(weight), n + 1, m + 1), np.int32)
    for i in range(n):
        best[:, i + 1, 1:] = np.maximum.accumulate(np.maximum(best[:, i, 1:], best[:, i, :-1] + e[:, i]), 1)
    i, j, out = np.full(len(weight), n), np.full(len(weight), m), []
    while True:
        on = (i > 0) & (j > 0)
        if not on.any():
            return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        i0, j0 = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here = best[p, i, j]
        up = on & (best[p, i0, j] == here)
        left = on & ~up & (best[p, i, j0] == here)
        take = on & ~up & ~left
        t = p[take]
        out.append((t, ia[t, i0[take]], ib[t, j0[take]]))
        i, j = np.where(up | take, i0, i), np.where(left | take, j0, j)


def match_trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple tree matching of nodes without children: which (rows of labels, padded with 0) are matched, on either side."""
    p, i, j = best_match(((a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]).astype(np.int32))
    hit_a, hit_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    hit_a[p, i] = hit_b[p, j] = True
    return hit_a, hit_b


def _padded(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each range as rows of one width, and which of them are within."""
    idx = start[:, None] + np.arange(max(1, int(count.max(initial=0))))[None, :]
    ok = idx < (start + count)[:, None]
    return np.where(ok, idx, 0), ok


class Forest:
    """The pages of a batch as trees: lines, and the items of menus below them (``label`` of each leaf, ``page`` and ``line`` it stands in)."""

    def __init__(self, page: np.ndarray, line: np.ndarray, label: np.ndarray, kind: np.ndarray, pages: int):
        self.label = label
        new = np.append(True, (page[1:] != page[:-1]) | (line[1:] != line[:-1])) if len(page) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)  # first leaf of each line
        self.count = np.diff(np.append(self.start, len(page)))
        self.owner = np.cumsum(new) - 1  # line of each leaf
        menu = (kind[self.start] & ITEM) > 0
        self.text = np.where(menu, MENU, np.where(kind[self.start] & TITLE, 0, label[self.start]))
        whole = np.add.reduceat(label * np.int64(0x9E3779B97F4A7C1), self.start) if len(self.start) else label
        self.whole = np.where(menu, whole, self.text)
        self.first = np.searchsorted(page[self.start], np.arange(pages + 1))  # lines of each page

    def match(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each leaf is compared and matched as pages ``a`` and ``b`` are aligned, pair by pair; exact copies tell nothing and don't count."""
        compared, matched = np.zeros(len(self.start), np.int64), np.zeros(len(self.label), np.int64)
        sides = [_padded(self.text, self.first[x], self.first[x + 1] - self.first[x]) for x in (a, b)]
        width = max(s[0].shape[1] for s in sides)
        (xa, oa), (xb, ob) = ((np.pad(i, ((0, 0), (0, width - i.shape[1]))), np.pad(o, ((0, 0), (0, width - o.shape[1])))) for i, o in sides)
        if not len(self.start):
            return compared, matched
        la, lb = np.where(oa, self.text[xa], 0), np.where(ob, self.text[xb], 0)
        differ = (np.where(oa, self.whole[xa], 0) != np.where(ob, self.whole[xb], 0)).any(1)
        weight = ((la[:, :, None] == lb[:, None, :]) & (la != 0)[:, :, None] & differ[:, None, None]).astype(np.int32)
        mp, mi, mj = np.nonzero(weight & (la == MENU)[:, :, None])
        if len(mp):  # two menus: what their items bring
            va, ka = _padded(self.label, self.start[xa[mp, mi]], self.count[xa[mp, mi]])
            vb, kb = _padded(self.label, self.start[xb[mp, mj]], self.count[xb[mp, mj]])
            wide = max(va.shape[1], vb.shape[1])
            fill = lambda v, k: np.pad(np.where(k, self.label[v], 0), ((0, 0), (0, wide - v.shape[1])))
            ha, hb = match_trees(fill(va, ka), fill(vb, kb))
            weight[mp, mi, mj] = 1 + ha.sum(1)
        p, i, j = best_match(weight)
        for x, o in ((xa, oa), (xb, ob)):
            np.add.at(compared, x[o & differ[:, None]], 1)
        plain = la[p, i] != MENU
        for x, k in ((xa, i), (xb, j)):
            np.add.at(matched, self.start[x[p[plain], k[plain]]], 1)
        if len(mp):
            at = np.searchsorted((mp * width + mi) * width + mj, ((p * width + i) * width + j)[~plain])
            for v, h in ((va, ha), (vb, hb)):
                np.add.at(matched, v[at][h[at][:, : v.shape[1]]], 1)
        return compared, matched


def _tally(rows: np.ndarray) -> pa.RecordBatch:
    """Sum the vote rows of equal host and label."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    start = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
    out = np.add.reduceat(rows[:, 2:], start, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[start, 0]), pa.array(rows[start, 1]), *[pa.array(out[:, i]) for i in range(3)]], names=[x.split()[0] for x in VOTES.split(", ")])


def _align(neighbours: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, n = b.column("host").to_numpy(zero_copy_only=False), b.num_rows
            sizes = np.diff(b.column("label").offsets.to_numpy())
            line, label, kind = (b.column(c).flatten().to_numpy() for c in ("line", "label", "kind"))
            page = np.repeat(np.arange(n), sizes)
            forest = Forest(page, line, label, kind, n)
            first = np.concatenate([np.arange(n - k) for k in range(1, neighbours + 1) if n > k] or [np.zeros(0, np.int64)]).astype(np.int64)
            second = np.concatenate([np.arange(k, n) for k in range(1, neighbours + 1) if n > k] or [np.zeros(0, np.int64)]).astype(np.int64)
            ok = host[first] == host[second]
            first, second = first[ok], second[ok]
            lines = np.diff(forest.first)
            big = np.maximum(lines[first], lines[second])
            order = np.argsort(big, kind="stable")
            compared, matched, at = np.zeros(len(forest.start), np.int64), np.zeros(len(label), np.int64), 0
            while at < len(order):
                width = int(big[order[min(at + 255, len(order) - 1)]])
                rows = order[at : at + max(1, min(256, 4_000_000 // max(1, width * width)))]
                at += len(rows)
                c, m = forest.match(first[rows], second[rows])
                compared += c
                matched += m
            v = np.flatnonzero((kind & TITLE) == 0)
            if len(v):
                yield _tally(np.stack((host[page[v]], label[v], np.ones(len(v), np.int64), compared[forest.owner[v]], matched[v]), 1))

    return run


def boilerplate_lines(
    pages: DataFrame, ident: str, host: Column, title: str, headings: str, content: str, neighbours: int = 2, constant: float = 0.15, host_constant: float = 0.5
) -> DataFrame:
    """``id`` (string) and ``line_no`` of each non-blank line outside the article.

    ``neighbours``: with how many other pages of its host each page is aligned on either side; pages of about one number of lines are neighbours, as those of one
    kind are. ``constant``: the mean share of matches from which a label seen on several hosts is template; ``host_constant``: the same on one
    host. A menu is out if three fifths of its items are. Rows of one id count once; null contents have no lines; null titles and hosts only give fewer
    hints; ``headings`` is not read, as the template lists its own headings there too.
    """
    # pages without content count for their titles
    rows = pages.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("string").alias("id"), host.alias("site"), F.coalesce(F.xxhash64(host), F.lit(0)).alias("host"), F.col(title).alias("title"), F.coalesce(content, F.lit("")).alias("content"),
    )
    nodes = written(rows.mapInArrow(_parse, NODES).withColumn("uid", F.monotonically_increasing_id()), "nodes")
    # a row for each repeat of a page: few
    again = nodes.select("id", "uid").join(nodes.groupBy("id").agg(F.min("uid").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "id").where("uid > _first").select("uid")
    nodes = nodes.join(written(again, "repeats"), "uid", "left_anti")
    placed = nodes.select("host", F.size("label").alias("size"), "uid", "line", "label", "kind")
    placed = placed.repartitionByRange("host", "size", "uid").sortWithinPartitions("host", "size", "uid").select("host", "line", "label", "kind")
    votes = placed.mapInArrow(_align(neighbours), VOTES).groupBy("host", "label").agg(*[F.sum(c).alias(c) for c in ("seen", "compared", "matched")])
    votes = written(votes, "votes")
    share = F.col("matched") / F.col("compared")
    judged = votes.groupBy("label").agg(F.count_if(F.col("compared") > 0).alias("judged"), F.avg(F.when(F.col("compared") > 0, share)).alias("share"))
    # only labels that are template or too rare to say go on
    judged = judged.select("label", ((F.col("judged") >= 3) & (F.col("share") >= constant)).alias("general"), (F.col("judged") < 5).alias("local")).where("general OR local")
    alone = (F.col("compared") >= 8) & (share >= host_constant)
    template = votes.join(judged, "label").where(F.col("general") | (F.col("local") & alone)).select("host", "label", "seen")
    titles = nodes.where("own IS NOT NULL").select("host", F.col("own").alias("label")).distinct()
    out = written(template.unionByName(votes.join(titles, ["host", "label"], "left_semi").select("host", "label", "seen")).groupBy("host", "label").agg(F.max("seen").alias("seen")), "template")
    items = F.transform("line", lambda x: F.size(F.filter("line", lambda y: y == x)))
    leaves = nodes.select("uid", "host", F.inline(F.arrays_zip("line", "label", "kind", items.alias("items")))).where(F.col("kind") != TITLE).drop("kind")
    hits = spread_semi_join(leaves, out, ["host", "label"], "seen", "uid").select("uid", "line", "items")
    lines = hits.repartition("uid").groupBy("uid", "line").agg(F.count(F.lit(1)).alias("n"), F.first("items").alias("items")).where(F.col("n") >= 0.6 * F.col("items"))
    return lines.join(nodes.select("uid", "id"), "uid").select("id", F.col("line").alias("line_no"))


def main_text(pages: DataFrame, ident: str, content: str, lines: DataFrame) -> DataFrame:
    """``id`` (string) and ``body``: the content without ``lines`` (of ``boilerplate_lines``); pages with null content are left out, pages without such lines stay as they are."""
    gone = lines.groupBy(F.col("id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))  # as many as the page has lines
    rows = pages.where(F.col(content).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("string").alias("id"), F.col(content).alias("content")).dropDuplicates(["id"])
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", i + 1), F.lit(False)))
    return rows.join(gone, rows["id"] == gone["_id"], "left").select("id", F.array_join(kept, "\n").alias("body"))
