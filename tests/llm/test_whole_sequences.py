"""Runs of repeated lines are found at every length."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from larkspur.llm import site_lines


def _brute(docs, min_docs):
    runs = Counter()
    for lines in docs.values():
        runs.update({tuple(lines[i:j]) for i in range(len(lines)) for j in range(i + 2, len(lines) + 1)})
    return {r: n for r, n in runs.items() if n >= min_docs}


def test_runs_of_any_length(spark):
    docs = {f"d{i}": [*range(1, 8), *([9, 1, 2] if i < 3 else [5, 6, 7, 9])] for i in range(5)}
    rows = [(d, 1, n, x) for d, lines in docs.items() for n, x in enumerate(lines)]
    found = spark.createDataFrame(rows, "doc string, source long, line_no int, line long").withColumn("line_no", F.col("line_no") * 3)
    got = site_lines.frequent_sequences(found, 3).collect()
    assert {tuple(r.lines): r.docs for r in got} == _brute(docs, 3)
    assert len(got) == len(_brute(docs, 3)) and max(r.length for r in got) == 10


def test_sequences_with_gaps(spark):
    rng = random.Random(4)
    docs = {f"d{i}": [rng.randint(1, 5) for _ in range(rng.randint(1, 6))] for i in range(14)}
    rows = [(d, 1 + n, x) for d, lines in docs.items() for n, x in enumerate(lines)]
    for gap in (0, 1, None):
        want = Counter()
        for lines in docs.values():
            n, mine = len(lines), set()
            for size in range(1, n + 1):
                for at in combinations(range(n), size):
                    if all(b - a - 1 <= (n if gap is None else gap) for a, b in zip(at, at[1:], strict=False)):
                        mine.add(tuple(lines[i] for i in at))
            want.update(mine)
        want = {k: v for k, v in want.items() if v >= 4}
        lines = spark.createDataFrame([(d, 7, [x for _, _, x in sorted(r for r in rows if r[0] == d)]) for d in docs], "doc string, source long, lines array<long>")
        got = site_lines.PrefixSpan(lines, 4, gap).patterns().collect()
        # a line is frequent or not before gaps are counted, so that all lines must be here
        assert all(v >= 4 for v in Counter(x for d in docs.values() for x in set(d)).values())
        assert {tuple(r.lines): r.docs for r in got} == want and len(got) == len(want)
        assert {(r.doc, r.line_no) for r in site_lines.PrefixSpan(lines, 4, gap).deletions().collect()} == {(d, n) for d, n, _ in rows}


def test_texts_without_their_lines(spark):
    docs = spark.createDataFrame([("a", "x\n\ny\nx"), ("b", "z"), ("b", "z"), ("c", None), ("d", "")], "doc string, t string")
    gone = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4)], "doc string, line_no int")
    assert sorted((r.doc, r.text) for r in site_lines.without_lines(docs, "doc", "t", gone).collect()) == [("a", "\ny"), ("b", "z"), ("d", "")]
