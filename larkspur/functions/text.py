"""Search text: normalisation, tokens, shingles and snippets as JVM expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are not indexed.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]

# Kana, CJK ideographs and two iteration signs; the middle dot U+30FB stands apart and separates words.
CJK_RANGES = [(0x3041, 0x309F), (0x30A0, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3005, 0x3006)]
CJK = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in CJK_RANGES)
FIRST_CJK = chr(min(a for a, _ in CJK_RANGES))  # texts compare as their characters do: Latin words are told from CJK without a pattern
WORD = f"[\\p{{IsAlphabetic}}\\p{{N}}&&[^{CJK}\\x{{30FB}}]]"
RUNS = f"[{CJK}]+|{WORD}+"
CAMEL = "(?<=\\p{Ll})(?=\\p{Lu})|(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})|(?<=\\p{L})(?=\\p{N})|(?<=\\p{N})(?=\\p{L})"

# what a word with parts holds: a capital or number behind its first character, or one that begins it and goes on
PARTED = "(?s).[\\p{Lu}\\p{N}]|^\\p{N}."


def _one_to_one() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character, and these forms, by rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    # marks that join their neighbours are left to the full normalisation
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and not unicodedata.combining(b)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FROM, TO = _one_to_one()
# what the table cannot settle: everything but blocks that are normal as they stand
UNSURE = "[^\\x{00}-\\x{A7}\\x{A9}\\x{AB}-\\x{AE}\\x{B0}\\x{B1}\\x{B6}\\x{B7}\\x{BB}\\x{BF}-\\x{131}\\x{134}-\\x{13E}\\x{141}-\\x{148}\\x{14A}-\\x{17E}\\x{180}-\\x{1C3}\\x{370}-\\x{373}\\x{386}-\\x{3CE}\\x{400}-\\x{482}\\x{48A}-\\x{52F}\\x{2010}-\\x{2016}\\x{2018}-\\x{2023}\\x{2030}-\\x{2032}\\x{20A0}-\\x{20A7}\\x{20A9}-\\x{20BF}\\x{2190}-\\x{222B}\\x{25A0}-\\x{26FF}\\x{3001}-\\x{3035}\\x{3041}-\\x{3096}\\x{309D}\\x{309E}\\x{30A0}-\\x{30FE}\\x{31F0}-\\x{31FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition (NFKC).

    One-to-one forms (full width, no-break spaces, ...) are translated in the JVM; only texts that still hold
    a character outside the blocks known to be normal go to Python, all others go there as nulls.
    """
    t = F.replace(F.translate(text, FROM, TO), F.lit("…"), F.lit("..."))
    return F.coalesce(_nfkc(F.when(t.rlike(UNSURE), text)), t)


def normalize_text(text: Column) -> Column:
    """NFKC in lower case."""
    return F.lower(nfkc(text))


def normalize_phrase(text: Column) -> Column:
    """NFKC in lower case, runs of white space one space, trimmed."""
    return F.trim(F.regexp_replace(normalize_text(text), "\\s+", " "))


def camel_parts(word: Column) -> Column:
    """``NavigationStack`` to ``[Navigation, Stack]``."""
    return F.split(word, CAMEL, -1)


def bigrams(run: Column) -> Column:
    """Pairs of neighbouring characters; a single character stands alone."""
    return F.when(F.char_length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens_of(normal: Column) -> Column:
    """Tokens of a text that is in NFKC but keeps its case."""
    def words(w: Column) -> Column:
        whole = F.array(F.lower(w))
        parts = F.filter(F.transform(camel_parts(w), F.lower), lambda p: F.char_length(p) > 1)
        split = F.when(w.rlike(PARTED) & w.rlike(CAMEL), F.concat(whole, parts)).otherwise(whole)
        return F.filter(split, lambda p: ~p.isin(*STOP_WORDS))

    return F.flatten(F.transform(F.regexp_extract_all(normal, F.lit(RUNS), F.lit(0)), lambda r: F.when((r >= F.lit(FIRST_CJK)) & r.rlike(f"^[{CJK}]"), bigrams(r)).otherwise(words(r))))


def tokenize(text: Column) -> Column:
    """Search tokens in order: words in lower case without stop words, the parts of camel-case words after the word, CJK bigrams. Null for null."""
    return tokens_of(nfkc(text))


def shingles(tokens: Column, size: int = 3) -> Column:
    """Runs of ``size`` tokens (a column of an earlier step) joined by spaces; all tokens as one if there are fewer; none if there are none."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(n > 0, many).otherwise(F.array().cast("array<string>"))


def snippet(content: Column, fallback: Column, terms: list[str], length: int = 160) -> Column:
    """A piece of the content around the first hit of any term, with ellipses where it is cut.

    Without a hit the fallback, or if that is empty, the beginning. Found in lower case after the one-to-one forms, which keep positions.
    """
    n = F.char_length(content)
    folded = F.lower(F.translate(content, FROM, TO))
    hits = F.array(*[F.nullif(F.instr(folded, F.lit(t)), F.lit(0)) for t in terms if t]) if any(terms) else F.array(F.lit(None).cast("int"))
    at = F.array_min(F.array_compact(hits)) - 1
    start = F.greatest(F.lit(0), F.least(at - length // 4, n - length))
    end = F.least(n, start + length)
    cut = F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        F.regexp_replace(F.substring(content, start + 1, end - start), "^\\s+|\\s+$", ""),
        F.when(end < n, F.lit("…")).otherwise(F.lit("")),
    )
    plain = F.when(fallback != "", fallback).otherwise(F.concat(F.substring(content, 1, length), F.when(n > length, F.lit("…")).otherwise(F.lit(""))))
    return F.when((content == "") | content.isNull(), fallback).when(at.isNotNull(), cut).otherwise(plain)
