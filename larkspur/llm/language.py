"""Problem 5: the language of each page and of each line, by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier over hashed byte 4-grams (naive Bayes log
odds, languages weighted alike). A text's margins, one per bit, are decoded to the codeword with the least weighted logistic loss;
bits that tell less in training weigh less. The confidence is the share of the codeword in the softmax over all, less what it lies beyond the farthest of the lines learnt from. A text whose second
codeword is about as near, or whose nearest is farther than that of all but a thousandth of the lines learnt from (a language nobody has
labelled), is flagged as ambiguous.

The languages are those that the labels name: two-letter codes on enough rows (``languages``), not a closed list.

The labels to learn from are the noisy ones of the table: up to ``per_label`` rows for each language (a bounded,
documented sample, chosen by hash of the identifier). After a first fit the sample's lines are labelled anew by the model and
it is fitted again, so that wrong labels and foreign lines lose their weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import text_bytes as tb

BUCKET_BITS = 15
CHUNK = 1 << 19
SCALE = 4.0
PARTS = 3
LETTERS = np.array([x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256)], np.uint8)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1 from a Hadamard matrix, at least half of whose bits differ between any two."""
    order = 16
    while order <= n:
        order *= 2
    rows = sorted(range(1, order), key=lambda r: (r.bit_count(), r))[:n]
    return np.array([[1 if (r & c).bit_count() % 2 else -1 for c in range(1, order)] for r in rows], np.float32)


def grams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the 4 bytes from each position on; capitals as small letters, ASCII and Latin-1 signs and digits as spaces."""
    b = LETTERS[np.concatenate((raw, np.full(3, 32, np.uint8)))]
    sign = np.flatnonzero(raw == 0xC2)
    b[sign] = b[sign + 1] = 32
    b = b.astype(np.uint32)
    w = b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16) | (b[3:] << 24)
    return (w * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def sums(table: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each range of positions; ranges are in order and apart. Works in chunks of ``CHUNK`` positions."""
    out = np.zeros((len(start), table.shape[1]), np.float64)
    keep = np.flatnonzero(end > start)
    a, lo = 0, 0
    while lo < len(keep):
        hi = int(np.searchsorted(end[keep], start[keep[lo]] + CHUNK, "right"))
        hi = max(hi, lo + 1)
        rows = keep[lo:hi]
        a = start[rows[0]]
        part = table[ids[a : end[rows[-1]]]]
        edges = np.stack((start[rows] - a, end[rows] - a), 1).ravel()
        if edges[-1] == len(part):
            part = np.concatenate((part, np.zeros((1, part.shape[1]), part.dtype)))
        out[rows] = np.add.reduceat(part, edges, axis=0)[::2]
        lo = hi
    return out


@dataclass
class Model:
    """Weights per bucket and bit, the code and the weights of its bits."""

    languages: tuple[str, ...]
    table: np.ndarray
    code: np.ndarray
    bit_weight: np.ndarray
    farthest: float = np.inf

    def margins(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return sums(self.table, ids, start, end)[:, : self.code.shape[1]] / np.maximum(end - start, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text against each codeword."""
        return np.stack([(self.bit_weight * np.logaddexp(0, -SCALE * c * margins)).sum(1) for c in self.code], 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (its number), the share of every language, and whether it is ambiguous."""
        loss = self.losses(margins)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True) * np.exp(np.maximum(loss.min(1, keepdims=True) - self.farthest, 0))
        two = np.sort(p, 1)[:, -2:] if p.shape[1] > 1 else np.concatenate((np.zeros_like(p), p), 1)
        return loss.argmin(1), p, (two[:, 0] > 0.5 * two[:, 1]) | (loss.min(1) > self.farthest)


def fit(languages: tuple[str, ...], ids: np.ndarray, start: np.ndarray, end: np.ndarray, label: np.ndarray, refits: int = 1) -> Model:
    """Learn from ranges of bucket ids with the number of their (perhaps wrong) language."""
    code = codewords(len(languages))
    model = None
    for _ in range(refits + 1):
        share = np.zeros((len(languages), 1 << BUCKET_BITS))
        for k in range(len(languages)):
            mine = np.flatnonzero(label == k)
            if len(mine):
                at = np.concatenate([ids[s:e] for s, e in zip(start[mine], end[mine], strict=True)])
                share[k] = np.bincount(at, minlength=1 << BUCKET_BITS) / max(1, len(at))
        known = share.any(1)
        share = share * 0.999 + 1e-6
        bits = []
        for c in code.T:
            on, off = (share[known & (c == x)].mean(0) if (known & (c == x)).any() else share.mean(0) for x in (1, -1))
            bits.append(np.log(on) - np.log(off))
        table = np.zeros((1 << BUCKET_BITS, 16 * -(-code.shape[1] // 16)), np.float32)
        table[:, : code.shape[1]] = np.stack(bits, 1)
        model = Model(languages, table, code, np.ones(code.shape[1]))
        m = model.margins(ids, start, end)
        if len(label):
            right = (code[label] * m > 0).mean(0)
            model.bit_weight = np.clip(2 * right - 1, 0.05, 1)
            label = model.decode(m)[0]
            model.farthest = float(np.quantile(model.losses(m).min(1), 0.999))
    return model


def languages(docs: DataFrame, label: Column, least_rows: int = 3, least_share: float = 0.005) -> dict[str, int]:
    """The two-letter labels on at least ``least_rows`` rows and ``least_share`` of all labelled rows, by name, with their rows. Reads the label only."""
    rows = docs.select(label.alias("_lang")).where(F.col("_lang").rlike("^[a-z][a-z]$")).groupBy("_lang").count().collect()  # at most 26 * 26 rows
    total = sum(r["count"] for r in rows)
    return {r._lang: r["count"] for r in sorted(rows) if r["count"] >= max(least_rows, least_share * total)}


def labelled(docs: DataFrame, ident: str, text: str, label: Column, counts: dict[str, int], per_label: int) -> DataFrame:
    """At most about ``per_label`` rows per language whose label names it, chosen by hash of the identifier (columns ``text``, ``lang``)."""
    rows = docs.withColumn("_lang", label).where(F.col("_lang").isin(*counts) & F.col(text).isNotNull())
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("_lang") == lang, F.lit(min(1.0, per_label / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(5), F.col(ident)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(unit < share).select(F.col(text).alias("text"), F.col("_lang").alias("lang")).limit(2 * per_label * len(counts))


def train(docs: DataFrame, ident: str, text: str, label: Column, per_label: int = 300, min_chars: int = 40) -> Model:
    """Fit on the driver over the bounded sample (at most ``2 * per_label`` texts a language). Without any label all is of one unknown language, ``und``."""
    counts = languages(docs, label)
    names = tuple(counts) or ("und",)
    sample = labelled(docs, ident, text, label, counts, per_label).toArrow().combine_chunks() if counts else None
    n = sample.num_rows if counts else 0
    column = sample.column("text").combine_chunks() if n else pa.array([], pa.string())
    raw, offsets = tb.utf8(column)
    found = tb.lines(raw, offsets)
    keep = found.chars >= min_chars
    where = np.array([names.index(x) for x in sample.column("lang").to_pylist()], np.int64) if n else np.zeros(0, np.int64)
    return fit(names, grams(raw), found.start[keep], found.end[keep], where[found.row[keep]] if n else where)


def detect(docs: DataFrame, ident: str, text: str, label: Column, model: Model, min_chars: int = 40) -> DataFrame:
    """One row per document (``line_no`` 0) and per counting line in another language than the document's.

    Columns: ``id, line_no, lang, confidence, ambiguous, given``; ``given`` is ``label``. A line counts from ``min_chars`` characters,
    trimmed, and where each third of it alone is nearer to its language than to the document's; the document's language has the most characters in such lines (of equal ones the first by name). A line's
    confidence is its language's share in the decoder, a document's the mean share of its language over its counting lines, by characters;
    it is ambiguous if the lines that are make up half of it, or a second language has half as many characters. Documents without a counting line, or with a null text, are left out.
    """
    names = np.array(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.utf8(b.column("text"))
            if not len(raw):
                continue
            ln = tb.lines(raw, offsets)
            ok = np.flatnonzero(ln.chars >= min_chars)
            if not len(ok):
                continue
            row, number, chars = ln.row[ok], ln.number[ok], ln.chars[ok]
            start, end = ln.start[ok], ln.end[ok]
            edges = [start + (end - start) * i // PARTS for i in range(PARTS + 1)]
            parts = sums(model.table, grams(raw), np.stack(edges[:-1], 1).ravel(), np.stack(edges[1:], 1).ravel())[:, : model.code.shape[1]]
            parts = parts.reshape(len(ok), PARTS, -1)
            lang, shares, odd = model.decode(parts.sum(1) / np.maximum(end - start, 1)[:, None])
            per = np.zeros((b.num_rows, len(names)))
            np.add.at(per, (row, lang), chars)
            whole = per.sum(1)
            best = per.argmax(1)
            docs_at = np.flatnonzero(whole > 0)
            # a line leaves its document's language only if each part of it says so: loan words fill a part of a line
            other = np.flatnonzero(lang != best[row])
            for i in range(PARTS):
                loss = model.losses(parts[other, i] / np.maximum(edges[i + 1][other] - edges[i][other], 1)[:, None])
                at = np.arange(len(other))
                other = other[loss[at, lang[other]] < loss[at, best[row[other]]]]
            at = np.concatenate((docs_at, row[other]))
            top2 = np.sort(np.concatenate((per[docs_at], np.zeros((len(docs_at), 1))), 1), 1)[:, -2:]
            sure = np.bincount(row, chars * shares[np.arange(len(row)), best[row]], b.num_rows)[docs_at] / whole[docs_at]
            vague = np.bincount(row, chars * odd, b.num_rows)[docs_at] >= 0.5 * whole[docs_at]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(at)),
                    pa.array(np.concatenate((np.zeros(len(docs_at), np.int32), number[other].astype(np.int32)))),
                    pa.array(np.concatenate((names[best[docs_at]], names[lang[other]])).astype(object), pa.string()),
                    pa.array(np.concatenate((sure, shares[other, lang[other]]))),
                    pa.array(np.concatenate((vague | (top2[:, 0] > 0.5 * top2[:, 1]), odd[other]))),
                    b.column("given").take(pa.array(at)),
                ],
                names=["id", "line_no", "lang", "confidence", "ambiguous", "given"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"), label.alias("given"))
    return rows.mapInArrow(run, f"id {kind}, line_no int, lang string, confidence double, ambiguous boolean, given string")


def first_subtag(label: Column) -> Column:
    """``en`` of `` EN_gb``."""
    return F.element_at(F.split(F.lower(F.trim(label)), "[-_]", -1), 1)
