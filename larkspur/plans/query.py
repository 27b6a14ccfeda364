"""The search query language. A query is one short text, parsed on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from larkspur.functions.text import CJK_RANGES, STOP_WORDS

# Synonym groups that are known by default.
SYNONYMS = [["js", "javascript"], ["ts", "typescript"], ["k8s", "kubernetes"], ["db", "database"], ["mac", "macos"], ["postgres", "postgresql"], ["golang", "go"]]
QUOTES = '"“”'


def normalize(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def normalize_phrase(text: str) -> str:
    return " ".join(normalize(text).split())


def _kind(c: str) -> str:
    if any(a <= ord(c) <= b for a, b in CJK_RANGES):
        return "cjk"
    return "word" if c != "・" and (c.isalpha() or c.isnumeric()) else ""


def tokenize(text: str) -> list[str]:
    """Tokens of a short text, as the column tokenizer makes them."""
    runs: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFKC", text):
        kind = _kind(c)
        if runs and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1] + c)
        else:
            runs.append((kind, c))
    out: list[str] = []
    for kind, run in runs:
        if kind == "cjk":
            out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        elif kind == "word":
            steps = [i for i in range(1, len(run)) if _camel_step(run, i)]
            parts = [run[a:b].lower() for a, b in zip([0, *steps], [*steps, len(run)], strict=True)] if steps else []
            out += [w for w in (run.lower(), *[p for p in parts if len(p) > 1]) if w not in STOP_WORDS]
    return out


def _camel_step(run: str, i: int) -> bool:
    a, b, after = run[i - 1], run[i], run[i + 1 : i + 2]
    return (a.islower() and b.isupper()) or (a.isupper() and b.isupper() and after.islower()) or (a.isalpha() and b.isnumeric()) or (a.isnumeric() and b.isalpha())


class Synonyms:
    """Words that stand for each other; words of several tokens are left out."""

    def __init__(self, groups: list[list[str]] = SYNONYMS):
        self.table: dict[str, set[str]] = {}
        for group in groups:
            single = [t[0] for t in map(tokenize, group) if len(t) == 1]
            for word in single:
                self.table.setdefault(word, set()).update(w for w in single if w != word)

    @staticmethod
    def parse(spec: str) -> list[list[str]]:
        """``a,b;c,d`` as groups."""
        return [[w.strip() for w in g.split(",")] for g in spec.split(";") if g]

    def of(self, term: str) -> list[str]:
        return sorted(self.table.get(term, ()))


@dataclass
class Query:
    """A parsed query: terms in order, their synonyms, mandatory phrases, excluded terms, filters and the text as one phrase."""

    terms: list[str] = field(default_factory=list)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    site: str | None = None
    language: str | None = None
    text: str = ""

    @property
    def has_cjk(self) -> bool:
        return any(0x3041 <= ord(c) <= 0x9FFF for c in self.text)

    @property
    def cache_key(self) -> str:
        parts = [self.text, "p=" + "|".join(sorted(self.phrases)), "x=" + "|".join(self.excluded), f"s={self.site or ''}", f"l={self.language or ''}"]
        return " ".join(parts)


def parse(raw: str, synonyms: Synonyms | None = None) -> Query:
    """Parse terms, quoted phrases, ``-word``, ``site:`` and ``lang:``; a quote that is never closed is plain text."""
    pieces = re.split(f"[{QUOTES}]", raw)
    inside, outside = pieces[1::2], pieces[0::2]
    if len(pieces) % 2 == 0:  # an odd number of quotes: the last piece is open
        outside.append(" " + inside.pop())
    q = Query(phrases=[p for p in map(normalize_phrase, inside) if p])
    free: list[str] = []
    excluded: set[str] = set()
    for word in "".join(outside).split():
        low = word.lower()
        if low.startswith("site:") and len(low) > 5:
            q.site = low[5:]
        elif low.startswith("lang:") and len(low) > 5:
            q.language = low[5:]
        elif word.startswith("-") and len(word) > 1:
            found, whole = tokenize(word[1:]), normalize(word[1:])
            excluded.update([whole] if whole in found else found)
        else:
            free.append(word)
    text = " ".join(free + q.phrases)
    q.terms = list(dict.fromkeys(t for t in tokenize(text) if t not in excluded))
    book = synonyms or Synonyms()
    q.synonyms = {t: alt for t in q.terms if (alt := [a for a in book.of(t) if a not in q.terms])}
    q.excluded, q.text = sorted(excluded), normalize_phrase(text)
    return q
