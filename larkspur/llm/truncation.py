"""Problem 10: texts that were cut off, in SQL.

Word trigrams are counted over all distinct texts, apart for those that go on in the line and those that end one. A text's
final trigram that is frequent inside lines but almost never ends one tells of a cut after a word; one whose last word is
rare in its place, but begins words that are frequent there, of a cut inside a word. Where a trigram is unknown, its last two words
are judged alike. A broken character, entity or tag at the end is a cut. A cut mark, or a length that
unusually many texts of the source have, settles places where lines may as well end as go on.

Words are runs of letters in lower case; numbers count as one word, signs and CJK characters are words each; a
capitalised word before a number counts as a name, and all names are one word. Texts that close with a full stop (or ? ! 。
and a closing bracket or quote after it) are whole. Copies of a text count once and share its verdict. Null and blank texts are not cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from larkspur.session import written

# Marks that systems put where they cut; what else may stand behind them; CJK characters; what closes a whole text, and what may stand behind that.
MARK = r"(\s*(\[\s*(\.\.\.|…)\s*\]|\(\s*(\.\.\.|…)\s*\)|…+|\.\.\.+))+$"
BLANKS = r" \t\n\r\u000b\u000c�"
CJK = r"\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
STOPS = "'.', '!', '?', '。', '！', '？'"
CLOSERS = BLANKS + r")]}»”’」』）】\u0022\u0027"
NAME = r"\p{Lu}\p{L}+(?=\s\d)"
NUMBER = r"\d+(?:[.,:]\d+)*"
# most characters are small letters, told first; what is a word of its own: a CJK character, and a sign but for apostrophes between letters
SINGLE = r"(?![a-z ])([" + CJK + r"[^\s\p{L}\p{M}\p{N}\x27’]]|[\x27’](?:(?<![\p{L}\p{M}][\x27’])|(?![\p{L}\p{M}])))"

# Ends are looked at by native string functions, so that no pattern runs over whole texts but the few that make words.
# @docs: doc (any type), source, text.
TEXTS = r"""
WITH texts AS (
  SELECT md5(text) AS k, min(text) AS text, min(lower(trim(source))) AS source
  FROM @docs WHERE text IS NOT NULL AND rtrim('@BLANKS', text) <> '' GROUP BY md5(text)
), ended AS (
  SELECT k, source, char_length(text) AS chars, octet_length(text) AS bytes, right(rtrim(text), 1) = '�' AS torn, rtrim('@BLANKS', text) AS body FROM texts
), unmarked AS (
  SELECT k, source, chars, bytes, torn, body,
    CASE WHEN right(body, 1) IN ('…', ']', ')') OR right(body, 3) = '...' THEN rtrim('@BLANKS', regexp_replace(body, r'@MARK', '')) ELSE body END AS bare
  FROM ended
), closed AS (
  SELECT k, source, chars, bytes, char_length(bare) < char_length(body) AS marked,
    torn OR right(body, 12) RLIKE r'(^|\s)&#?\w{0,8}$' OR (contains(body, '<') AND substring_index(body, '<', -1) RLIKE r'^[a-zA-Z/!][^>]*$') AS broken, bare, right(rtrim('@CLOSERS', bare), 1) IN (@STOPS) AS stopped
  FROM unmarked
)
SELECT k, source, chars, bytes, marked, broken, (stopped AND NOT right(bare, 2) RLIKE r'\d[.]' AND NOT marked) AS whole, regexp_extract(right(bare, 60), r'(\S)\S*$', 1) AS head,
  regexp_replace(regexp_replace(lower(regexp_replace(translate(bare, '\t\r\u000b\u000c', '    '), r'@NAME', '№')), r'@NUMBER', ' 0 '), r'@SINGLE', ' $1 ') AS body
FROM closed
"""

# How often each trigram goes on in its line, ends a line inside its text, and ends its text; ^ stands before a line.
COUNTED = r"""
SELECT a, b, c, sum(CASE WHEN d IS NULL THEN 0 ELSE 1 END) AS on, sum(CASE WHEN d IS NULL AND n < m - 1 THEN 1 ELSE 0 END) AS inner_end, sum(CASE WHEN d IS NULL AND n = m - 1 THEN 1 ELSE 0 END) AS text_end
FROM (
  SELECT n, m, inline(arrays_zip(a, b, c, d))
  FROM (
    SELECT n, m, concat(array('^', '^'), c) AS a, concat(array('^'), c) AS b, c, slice(c, 2, size(c)) AS d
    FROM (SELECT n, m, split(line, ' +') AS c FROM (SELECT size(lines) AS m, posexplode(lines) AS (n, line) FROM (SELECT filter(transform(split(body, '\n', -1), l -> trim('@BLANKS', l)), l -> l <> '') AS lines FROM @texts)))
  )
) WHERE c IS NOT NULL GROUP BY a, b, c
"""

# The last three words of each text that doesn't close as a whole one.
FINALS = r"""
SELECT k, marked, broken, head, source, chars, bytes, w[size(w) - 1] AS c, CASE WHEN size(w) < 2 THEN '^' ELSE w[size(w) - 2] END AS b, CASE WHEN size(w) < 3 THEN '^' ELSE w[size(w) - 3] END AS a
FROM (SELECT *, split(trim('@BLANKS', substring_index(body, '\n', -1)), ' +') AS w FROM @texts WHERE NOT whole OR broken) WHERE w[0] <> ''
"""

VERDICTS = r"""
WITH lengths AS (
  SELECT source, kind, len, count(*) AS n FROM (SELECT source, stack(2, 'c', chars, 'b', bytes) AS (kind, len) FROM @texts) GROUP BY source, kind, len
), limits AS (
  SELECT source, kind, len FROM (
    SELECT *, sum(n) OVER (PARTITION BY source, kind ORDER BY len RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - n AS near FROM lengths
  ) WHERE n >= 5 AND n >= 4 * near / 20 + 3
), begun AS (
  SELECT a, b, p, sum(on + inner_end) AS n FROM (
    SELECT a, b, on, inner_end, explode(transform(sequence(1, char_length(c) - 1), i -> substring(c, 1, i))) AS p
    FROM @counted LEFT SEMI JOIN @finals f USING (a, b) WHERE char_length(c) > 1 AND on + inner_end > 0
  ) GROUP BY a, b, p
), pairs AS (
  SELECT b, c, sum(on) AS on, sum(inner_end) AS inner_end, sum(text_end) AS text_end FROM @counted GROUP BY b, c
), pairs_begun AS (
  SELECT b, p, sum(on + inner_end) AS n FROM (
    SELECT b, on, inner_end, explode(transform(sequence(1, char_length(c) - 1), i -> substring(c, 1, i))) AS p FROM pairs LEFT SEMI JOIN @finals f USING (b) WHERE char_length(c) > 1 AND on + inner_end > 0
  ) GROUP BY b, p
), judged AS (
  SELECT f.k,
    coalesce(t.on, 0) AS on, coalesce(t.inner_end, 0) + greatest(coalesce(t.text_end, 0) - 1, 0) AS ends, coalesce(p.n, 0) AS begun,
    coalesce(q.on, 0) AS pair_on, coalesce(q.inner_end, 0) + greatest(coalesce(q.text_end, 0) - 1, 0) AS pair_ends, coalesce(pb.n, 0) AS pair_begun,
    coalesce(m.on, 0) AS name_on, coalesce(m.inner_end, 0) AS name_ends, f.marked, f.broken, f.head,
    (lc.len IS NOT NULL OR lb.len IS NOT NULL) AS at_limit
  FROM @finals f
  LEFT JOIN @counted t ON f.a = t.a AND f.b = t.b AND f.c = t.c
  LEFT JOIN begun p ON f.a = p.a AND f.b = p.b AND f.c = p.p
  LEFT JOIN @counted m ON f.a = m.a AND f.b = m.b AND m.c = '№'
  LEFT JOIN pairs q ON f.b = q.b AND f.c = q.c
  LEFT JOIN pairs_begun pb ON f.b = pb.b AND f.c = pb.p
  LEFT JOIN limits lc ON lc.kind = 'c' AND lc.source <=> f.source AND lc.len = f.chars
  LEFT JOIN limits lb ON lb.kind = 'b' AND lb.source <=> f.source AND lb.len = f.bytes
)
SELECT k, broken
  OR (on >= 3 AND ends <= 0.1 * (on + ends))
  OR ((marked OR at_limit) AND (on >= 1 OR ends = 0))
  OR (begun >= 3 AND on + ends <= 0.1 * begun)
  OR (on + ends = 0 AND pair_on >= 5 AND pair_ends <= 0.02 * (pair_on + pair_ends))
  OR (on + ends + begun = 0 AND pair_begun >= 5 AND pair_on + pair_ends <= 0.02 * pair_begun)
  OR (head RLIKE r'^\p{Lu}' AND on + ends = 0 AND name_on >= 3 AND name_ends <= 0.1 * (name_on + name_ends)) AS cut
FROM judged
"""


def _sql(sql: str, **views: DataFrame) -> DataFrame:
    """Run SQL over DataFrames named in it by @name."""
    spark = next(iter(views.values())).sparkSession
    for name, value in (("@MARK", MARK), ("@BLANKS", BLANKS), ("@CLOSERS", CLOSERS), ("@STOPS", STOPS), ("@NAME", NAME), ("@NUMBER", NUMBER), ("@SINGLE", SINGLE)):
        sql = sql.replace(name, value)
    made = []
    try:
        for name, df in views.items():
            made.append(f"{name}_{uuid.uuid4().hex}")
            df.createTempView(made[-1])
            sql = sql.replace(f"@{name}", made[-1])
        return spark.sql(sql)
    finally:
        for view in made:
            spark.catalog.dropTempView(view)


def verdicts(docs: DataFrame, ident: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents as ``doc, source, text``, and ``k`` (MD5 of a text) and ``cut`` of each text that doesn't close as a whole one."""
    rows = docs.selectExpr(f"`{ident}` AS doc", f"`{source}` AS source", f"`{text}` AS text")
    texts = written(_sql(TEXTS, docs=rows), "texts")
    counted = written(_sql(COUNTED, texts=texts), "trigrams")
    finals = written(_sql(FINALS, texts=texts), "finals")
    return rows, _sql(VERDICTS, texts=texts, counted=counted, finals=finals)


def truncated(docs: DataFrame, ident: str, source: str, text: str) -> DataFrame:
    """``doc`` of each document whose text was cut."""
    rows, said = verdicts(docs, ident, source, text)
    return _sql("SELECT d.doc FROM @docs d JOIN (SELECT k FROM @said WHERE cut) v ON md5(d.text) = v.k", docs=rows, said=said)


def truncation_rates(docs: DataFrame, ident: str, source: str, text: str) -> DataFrame:
    """``source, documents, cut_documents, rate``; sources alike but for case and outer spaces are one, a null source is one of its own."""
    rows, said = verdicts(docs, ident, source, text)
    return _sql(
        "SELECT lower(trim(d.source)) AS source, count(*) AS documents, count(v.k) AS cut_documents, round(count(v.k) / count(*), 9) AS rate "
        "FROM @docs d LEFT JOIN (SELECT k FROM @said WHERE cut) v ON md5(d.text) = v.k GROUP BY lower(trim(d.source))",
        docs=rows, said=said,
    )
