"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Repetitive text compresses too well,
random text hardly at all; the accepted band depends on the length, because short texts carry the
compressor's header and have nothing to refer back to. Two base rules (too few words, too many words in
repeated three-word windows) come first.

The bands come from the corpus: one aggregation over all documents that pass the base rules, each distinct text
counted once, gives a histogram of the ratio per class (quarter octave of the length, share of non-ASCII bytes), and
the limits are the median and so many spreads of the class on either side. Classes with few texts take in their
neighbours up to an octave away; where that is still too few, only the fixed bands hold. Chunks all have one length,
so their limits need no length classes. The figures are computed again when texts are judged; nothing is written.

Cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike, each on
its own; a very long text is read whole; an empty table gives an empty table; extra columns pass through
:func:`accepted` untouched and are ignored by :func:`assess`.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import small_batches, text_bytes, texts


@dataclass(frozen=True)
class Bands:
    """Accepted ratio compressed / raw bytes, by least raw length: (from bytes, low, high).

    These hold for every corpus, and alone where it has too few texts to compare with. The low limits sit far below
    ordinary prose of that length (about 0.65 at 200 bytes, 0.5 at 1 KB, 0.4 at 10 KB, 0.35 at 100 KB), the high ones
    far above it and near encoded or random bytes. The last four fields make the limits from the corpus.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (128, 0.35, 1.2), (512, 0.32, 0.95), (2048, 0.28, 0.78), (16384, 0.22, 0.72),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.76)
    max_bad_chunks: float = 0.34
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50
    spreads: float = 3.5
    # A spread is at least this share of the median, so that a class full of near copies does not reject all else.
    least_spread: float = 0.015
    least_texts: int = 50
    reach: int = 4


# Limits (low, high) by (script, length class); the length class of chunks is -1.
Limits = dict[tuple[int, int], tuple[float, float]]
_CHUNKS = -1
_BINS = 1000
_SCRIPTS = (0.005, 0.05, 0.3)

_NOT_WORD_CODE_POINT = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
_NOT_ASCII = bytes(range(0x80, 0x100))
_SYMBOLS = b"#*$%&|<>"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunks", "base_failed", "kept")
_TYPE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "ratio double, bad_chunks double, base_failed boolean, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, total = -1, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def ratio(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(compressor.compress(data)) / len(data) if data else 0.0


def length_class(n_bytes: int) -> int:
    """Quarter octaves of the length."""
    return math.floor(4 * math.log2(n_bytes)) if n_bytes else 0


def script(text: bytes) -> int:
    """The class of the share of bytes outside ASCII: texts of one script (and nearly of one language) share it."""
    share = 1 - len(text.translate(None, _NOT_ASCII)) / len(text) if text else 0.0
    return sum(share >= least for least in _SCRIPTS)


def base_figures(text: bytes, bands: Bands) -> tuple[int, int, bool]:
    """(words, words in repeated windows, whether a base rule rejects the text)."""
    words = text.split()
    repeats = repeated_words(words)
    return len(words), repeats, len(words) < bands.min_words or 100 * repeats > bands.max_repeat_percent * len(words)


def chunk_ratios(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the full chunks."""
    starts = range(0, len(text), bands.chunk_bytes)
    return [ratio(text[s:s + bands.chunk_bytes], compressor) for s in starts if len(text) - s >= bands.chunk_bytes]


def within(value: float, fixed: tuple[float, float], learned: tuple[float, float] | None) -> bool:
    return fixed[0] <= value <= fixed[1] and (learned is None or learned[0] <= value <= learned[1])


def judge(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor, limits: Limits | None = None) -> tuple:
    """The figures of one text in the order of ``_FIELDS``; without limits only the fixed bands hold."""
    limits = limits or {}
    n_words, repeats, failed = base_figures(text, bands)
    whole, kind = ratio(text, compressor), script(text)
    fixed = next((a, b) for least, a, b in reversed(bands.whole) if len(text) >= least)
    outside = [not within(r, bands.chunk, limits.get((kind, _CHUNKS))) for r in chunk_ratios(text, bands, compressor)]
    bad = sum(outside) / len(outside) if outside else 0.0
    kept = not failed and within(whole, fixed, limits.get((kind, length_class(len(text))))) and bad <= bands.max_bad_chunks
    return (
        n_words, len(text.translate(None, _NOT_WORD_CODE_POINT)), len(text) - len(text.translate(None, _SYMBOLS)),
        duplicate_lines(text), repeats, whole, bad, failed, kept,
    )


def _quartiles(histogram: dict[float, int]) -> list[float]:
    total, seen, found = sum(histogram.values()), 0, []
    for value in sorted(histogram):
        seen += histogram[value]
        while len(found) < 3 and 4 * seen >= (len(found) + 1) * total:
            found.append(value)
    return found


def limits_from(counts: Iterable[tuple[int, int, int, int]], bands: Bands) -> Limits:
    """Limits of every class from (script, length class, ratio in thousandths, texts).

    Ratios are compared as distances from the median of their length over all scripts, so that a class can take in
    its neighbours. A side's spread comes from its quartile, as for a normal curve.
    """
    classes: dict[tuple[int, int], Counter] = defaultdict(Counter)
    lengths: dict[int, Counter] = defaultdict(Counter)
    for kind, length, value, n in counts:
        classes[kind, length][(value + 0.5) / _BINS] += n
        lengths[length][(value + 0.5) / _BINS] += n
    usual = {length: _quartiles(h)[1] for length, h in sorted(lengths.items()) if h.total() >= bands.least_texts and length != _CHUNKS}

    def centre(length: int) -> float:
        return float(np.interp(length, list(usual), list(usual.values()))) if usual else 0.0

    def around(kind: int, length: int, reach: int) -> Counter:
        found = Counter()
        for at in range(max(0, length - reach), length + reach + 1):
            for value, n in classes.get((kind, at), {}).items():
                found[value - centre(at)] += n
        return found

    out: Limits = {}

    def learn(key: tuple[int, int], histogram: dict[float, int], middle: float) -> None:
        low, mid, high = (middle + value for value in _quartiles(histogram))
        least = bands.least_spread * mid
        out[key] = mid - bands.spreads * max((mid - low) / 0.6745, least), mid + bands.spreads * max((high - mid) / 0.6745, least)

    for kind in {k for k, _ in classes}:
        own = [length for k, length in classes if k == kind and length != _CHUNKS]
        for length in range(max(0, min(own) - bands.reach), max(own) + bands.reach + 1) if own else ():
            near = (around(kind, length, reach) for reach in range(bands.reach + 1))
            enough = next((h for h in near if h.total() >= bands.least_texts), None)
            if enough:
                learn((kind, length), enough, centre(length))
        if classes.get((kind, _CHUNKS), Counter()).total() >= bands.least_texts:
            learn((kind, _CHUNKS), classes[kind, _CHUNKS], 0.0)
    return out


def learned_limits(documents: DataFrame, bands: Bands = Bands()) -> Limits:
    """Limits from all texts that pass the base rules. The driver gets one row per class and thousandth of the ratio."""
    @F.arrow_udf("script int, length int, whole int, chunk int")
    def measure(column: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows: list[tuple] = []
        for text in text_bytes(column):
            if base_figures(text, bands)[2]:
                rows.append((None,) * 4)
                continue
            chunks = chunk_ratios(text, bands, compressor)
            rows.append((script(text), length_class(len(text)), int(_BINS * ratio(text, compressor)),
                         int(_BINS * median(chunks)) if chunks else None))
        return pa.StructArray.from_arrays(
            [pa.array([row[k] for row in rows], type=pa.int32()) for k in range(4)], names=["script", "length", "whole", "chunk"])

    text = documents["text"]
    distinct = documents.select(measure(text).alias("m"), F.xxhash64(text).alias("copy")).select("m.*", "copy").distinct()
    values = distinct.select("script", F.inline(F.array(
        F.struct("length", F.col("whole").alias("value")), F.struct(F.lit(_CHUNKS).alias("length"), F.col("chunk").alias("value")))))
    counts = values.where("value is not null").groupBy("script", "length", "value").agg(F.count("*").alias("n"))
    return limits_from((tuple(row) for row in counts.collect()), bands)


def verdict(text: str | Column, bands: Bands = Bands(), limits: Limits | None = None) -> Column:
    """A struct with the figures and the decision for a text column."""
    types = (pa.int64(),) * 5 + (pa.float64(),) * 2 + (pa.bool_(),) * 2

    @F.arrow_udf(_TYPE)
    def apply(column: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(value, bands, compressor, limits) for value in text_bytes(column)]
        return pa.StructArray.from_arrays(
            [pa.array([row[k] for row in rows], type=t) for k, t in enumerate(types)], names=list(_FIELDS))

    return apply(text)


def assess(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: doc_id, the base figures, the whole ratio, the share of bad chunks and the decision."""
    rows = texts(documents)
    return rows.select("doc_id", verdict("text", bands, learned_limits(rows, bands)).alias("v")).select("doc_id", "v.*")


def accepted(documents: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    small_batches(documents.sparkSession)
    text = documents[text_col].cast("string")
    return documents.where(verdict(text, bands, learned_limits(documents.select(text.alias("text")), bands))["kept"])
