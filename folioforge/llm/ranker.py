"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is a weighted sum of plain figures of its text. The weights are learned from preference pairs, a document
labelled good over one labelled bad: the chance of that order is the logistic function of the difference of their worths, so
the fit is a logistic regression on feature differences without an intercept. Pairs fix the order of documents but no
border. The border is a quantile of the worths of the whole corpus: of all levels in steps of a thousandth, the one that
splits the labelled sample best. A logistic curve through it turns worths into scores, with ``ACCEPT`` (0.7) at the border.

Learned from labelled rows outside the held-out part only, from a hash sample of about ``SAMPLE_ROWS`` of them; the worths of all
documents make the quantiles, counted in a histogram of bounded size. Labels, language, source and id are no features.

Cases: null and empty texts have all-zero features and a score like any other; a null doc_id counts as held out; a document
labelled twice is good only if every label says so, a null label is no label; without labels of both kinds every score is the
share of good labels; repeated rows are scored alike; very long texts are read whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import each_batch, text_bytes, texts
from folioforge.operators.lineage import written_once

SAMPLE_ROWS = 20_000
PAIRS_PER_ROW = 8
ACCEPT = 0.7
LEVELS = 1000
_BINS_PER_UNIT, _RANGE = 50, 100  # worths are counted in bins of 0.02, from -100 to 100

FEATURES = ("symbols", "signs", "exclamations", "capitals", "digits", "stutters", "repeats", "dup_lines", "word_length", "punctuated", "compression", "length")
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
_ENDS = tuple(bytes([c]) for c in range(33, 127) if not bytes([c]).isalnum())


def _share(part: int, whole: int) -> float:
    """A share on a scale that tells 0, 1 and 10 percent apart."""
    return math.log1p(100 * part / whole) if whole else 0.0


def features(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """The figures of a text, in the order of ``FEATURES``."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = size - len(text.translate(None, _LETTERS))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    return (
        _share(size - len(text.translate(None, _SYMBOLS)), size),
        _share(sum(not w.translate(None, _SYMBOLS + b"!-_=+~.,;:?/") for w in set(words)) + words.count(b"|"), n),
        _share(text.count(b"!"), n),
        _share(size - len(text.translate(None, _UPPER)), letters),
        _share(size - len(text.translate(None, _DIGITS)), size),
        _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        _share(len(windows) - len(set(windows)), len(windows)),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log(sum(map(len, words)) / n),
        _share(sum(w.endswith(_ENDS) for w in words), n),
        math.log(len(compressor.compress(text)) / size),
        math.log1p(n) / 4,
    )


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, the worth at the border, and the share of good labels."""

    weights: tuple[float, ...] = ()
    border: float = 0.0
    prior: float = 0.5

    def worths(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(rows @ np.array(self.weights), -_RANGE, _RANGE)

    def score(self, worth: Column) -> Column:
        if not self.weights:
            return F.lit(self.prior)
        at = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), worth - self.border + math.log(ACCEPT / (1 - ACCEPT))))
        return 1 / (1 + F.exp(-at))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _matrix(column: pa.Array) -> np.ndarray:
    compressor = zstandard.ZstdCompressor(level=1)
    return np.array([features(t, compressor) for t in text_bytes(column)], float).reshape(-1, len(FEATURES))


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, good, features) of labelled documents outside the held-out part, one row per document."""
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good")))
    share = min(1.0, rows / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "good": batch.column("good"), "features": list(_matrix(batch.column("text")))}

    # Bounded by ``rows`` (in expectation), so it may go to every task.
    found = texts(documents).join(F.broadcast(picked), "doc_id").select("doc_id", "good", "text")
    measured = each_batch(found, "doc_id long, good int, features array<double>", step)
    return measured.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("features").alias("features"))


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = 1.0) -> np.ndarray:
    """Bradley-Terry weights: Newton steps for the logistic loss of (good - bad) differences with a ridge.

    Every row of the larger class meets ``pairs_per_row`` rows of the other, dealt round.
    """
    rng = np.random.default_rng(42)
    count = pairs_per_row * max(len(good), len(bad))
    dealt = [np.concatenate([rng.permutation(len(rows)) for _ in range(-(-count // len(rows)))])[:count] for rows in (good, bad)]
    difference = good[dealt[0]] - bad[dealt[1]]
    weights = np.zeros(difference.shape[1])
    for _ in range(100):
        missed = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))  # 1 - P(good before bad)
        gradient = difference.T @ missed - ridge * weights
        curvature = (difference * np.maximum(missed * (1 - missed), 1e-9)[:, None]).T @ difference + ridge * np.eye(len(weights))
        step = np.linalg.solve(curvature, gradient)
        weights = weights + step * min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def best_border(levels: np.ndarray, worths: np.ndarray, good: np.ndarray) -> float:
    """Of the quantiles ``levels`` the one with most of the labelled worths on the right side; of equals the middle one."""
    levels = np.unique(levels)
    order = np.argsort(worths, kind="stable")
    passed = np.searchsorted(worths[order], levels, "left")  # so many lie under the level
    goods = np.concatenate([[0], np.cumsum(good[order])])
    right = (passed - goods[passed]) + (goods[-1] - goods[passed])
    best = np.flatnonzero(right == right.max())
    return float(levels[best[len(best) // 2]])


def worths(documents: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, worth) of every document."""
    if not ranking.weights:
        return texts(documents).select("doc_id", F.lit(0.0).alias("worth"))

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "worth": ranking.worths(_matrix(batch.column("text")))}

    return each_batch(texts(documents), "doc_id long, worth double", step)


def _quantiles(measured: DataFrame) -> np.ndarray:
    """Worths at LEVELS quantiles of all rows, as borders of histogram bins; the histogram has a bounded number of rows."""
    counted = measured.groupBy(F.floor(F.col("worth") * _BINS_PER_UNIT).alias("bin")).agg(F.count("*").alias("n")).collect()
    bins = np.array(sorted((r["bin"], r["n"]) for r in counted), float).reshape(-1, 2)
    if not len(bins):
        return np.zeros(1)
    wanted = np.arange(LEVELS + 1) * bins[:, 1].sum() / LEVELS
    at = np.searchsorted(np.cumsum(bins[:, 1]), wanted, "left").clip(0, len(bins) - 1)
    return bins[at, 0] / _BINS_PER_UNIT


def rank(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from ``ACCEPT`` up."""
    rows = sorted((r["doc_id"], r["good"], r["features"]) for r in _sample(documents, labels, sample_rows).collect())
    table = np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES))
    good = np.array([r[1] > 0 for r in rows], bool)
    ranking = Ranking(prior=float((good.sum() + 0.5) / (len(good) + 1)))
    measured = worths(documents, ranking)
    if good.any() and not good.all():
        ranking = Ranking(tuple(fit_pairs(table[good], table[~good]).tolist()), prior=ranking.prior)
        measured = written_once(worths(documents, ranking))
        ranking = Ranking(ranking.weights, best_border(_quantiles(measured), ranking.worths(table), good), ranking.prior)
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ranking.score(F.col("worth")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
