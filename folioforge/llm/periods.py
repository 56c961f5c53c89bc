"""Periodic runs of words by seed-and-extend diagonals.

A run is a longest stretch of words that repeats itself with a smallest period q, at least twice and over at least
``least`` (12) words. Positions i and i + q of a run hold equal words over its length less q words, so for every lag there is
a guaranteed overlap: k words for lags from k to 2k - 1 (k = 6, 12, 24, ...; the first band also takes lags under 6). Per band the
k-grams of a text are numbered (each level from two halves of the one before), pairs of equal k-grams whose lag lies in the
band are seeds, and each seed is extended along its diagonal in both directions. A table of the furthest covered position per lag
keeps a diagonal from being extended twice.

k-grams that lie inside an already found run of period k / 2 or less are no seeds: a highly periodic gram would meet all its
shifts. The others meet at most three partners in a band, so the work per level grows with the text. What such grams could
have shown beyond it, two touching runs of one period, is looked at directly (:func:`_touching`).

Cases: null and wordless texts have no runs; a text shorter than ``least`` words has none; repeated rows are treated alike; very
long texts are read whole; a null doc_id keeps its row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import each_batch, text_bytes, texts

LEAST = 12
Run = tuple[int, int, int]  # start, length, period


def _mismatch(x: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many of the next ``limit`` entries from i and from j on agree."""
    done, step = 0, 64
    while done < limit:
        size = min(step, limit - done)
        differ = x[i + done:i + done + size] != x[j + done:j + done + size]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + size, step * 4
    return limit


class _Diagonals:
    """The maximal stretches found on each lag, and the runs among them."""

    def __init__(self, x: np.ndarray, least: int):
        self.x, self.back, self.least = x, x[::-1], least
        self.covered: dict[int, int] = {}
        self.found: dict[Run, None] = {}

    def extend(self, i: int, lag: int) -> None:
        """Extend the seed at words i and i + lag, unless its diagonal is covered up to there."""
        if i < self.covered.get(lag, 0):
            return
        n = len(self.x)
        end = i + _mismatch(self.x, i, i + lag, n - i - lag)
        start = i - _mismatch(self.back, n - i, n - i - lag, i)
        self.covered[lag] = end
        length = end - start + lag
        if length >= max(self.least, 2 * lag) and self._primitive(start, lag):
            self.found[start, length, lag] = None

    def _primitive(self, start: int, lag: int) -> bool:
        root, rest, factor = self.x[start:start + lag], lag, 2
        while rest > 1:
            if factor * factor > rest:
                factor = rest
            if rest % factor == 0:
                step = lag // factor
                if _mismatch(root, 0, step, lag - step) == lag - step:
                    return False
                while rest % factor == 0:
                    rest //= factor
            factor += 1
        return True


def _numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Small numbers for the pairs of two columns."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _partners(gram: np.ndarray, places: np.ndarray, low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, lag) of equal grams with low <= lag < high; ``gram`` belongs to the ascending ``places``."""
    key = gram * (3 * size) + places
    key.sort()
    first, last = np.searchsorted(key, key + low), np.searchsorted(key, key + high)
    many = last - first
    at = np.repeat(np.arange(len(key)), many)
    other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]
    return key[at] % (3 * size), key[other] - key[at]


def _touching(x: np.ndarray, found: list[Run], k: int) -> list[tuple[int, int]]:
    """Seeds (place, lag) with k <= lag < 2k where a run of period p <= k / 2 touches the next one of that period and root."""
    by_period: dict[int, list[Run]] = {}
    for run in found:
        if 2 * run[2] <= k <= run[1]:
            by_period.setdefault(run[2], []).append(run)
    seeds = []
    for p, runs in by_period.items():
        runs.sort()
        for (b, size, _), (c, other, _) in zip(runs, runs[1:], strict=False):
            if c > b + size:
                continue
            root = x[c:c + p]
            shift = next((t for t in np.flatnonzero(x[b:b + p] == root[0]).tolist() if np.array_equal(x[b + t:b + t + p], root)), None)
            if shift is None:
                continue
            longest = min(2 * k - 1, size, other, (c + other - b) // 2)
            first = c - b - shift
            first += -(-(k - first) // p) * p if first < k else -((first - k) // p) * p
            seeds += [(max(b, c - lag), lag) for lag in range(first, longest + 1, p)]
    return seeds


def runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) of a list of words, by start and period."""
    n, k = len(words), least // 2
    if n < least:
        return []
    # Mostly no gram of the first level occurs twice.
    if len(set(zip(*(words[d:] for d in range(k)), strict=False))) == n - k + 1:
        return []
    numbers: dict[bytes, int] = {}
    x = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    gram = x[:n - k + 1]
    for d in range(1, k):
        gram = _numbered(gram, x[d:n - k + 1 + d])
    diagonals = _Diagonals(x, least)
    while True:
        low = 1 if k == least // 2 else k
        seed = np.bincount(gram)[gram] > 1
        if not seed.any():
            break
        if low == k:
            inside = np.zeros(len(gram) + 1, np.int64)
            for start, length, period in diagonals.found:
                if 2 * period <= k <= length:
                    inside[start] += 1
                    inside[start + length - k + 1] -= 1
            seed &= np.cumsum(inside[:-1]) == 0
        places = np.flatnonzero(seed)
        place, lag = _partners(gram[places], places, low, 2 * k, n)
        # One seed stands for those that follow it on its diagonal without a gap.
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        head = np.ones(len(place), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        seeds = list(zip(place[head].tolist(), lag[head].tolist(), strict=True))
        if low == k:
            seeds = sorted(seeds + _touching(x, list(diagonals.found), k), key=lambda s: (s[1], s[0]))
        for i, q in seeds:
            diagonals.extend(i, q)
        if 2 * k > n // 2:
            break
        gram = _numbered(gram[:-k], gram[k:])
        k *= 2
    return sorted(diagonals.found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def detect(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, starts, lengths, periods, collapsed) of every row; runs in order of start and period."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name: [] for name in ("n_words", "starts", "lengths", "periods", "collapsed")}
        for text in text_bytes(batch.column("text")):
            words = text.split()
            found = runs(words, least)
            out["n_words"].append(len(words))
            for k, name in enumerate(("starts", "lengths", "periods")):
                out[name].append([run[k] for run in found])
            out["collapsed"].append(b" ".join(collapsed(words, found)))
        out["collapsed"] = pa.array(out["collapsed"], type=pa.binary()).cast(pa.string())
        return {"doc_id": batch.column("doc_id"), **out}

    return each_batch(
        texts(documents), "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string", step)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    all_runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("r"))))["r"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    named = found.select("doc_id", "collapsed", all_runs.alias("runs"))
    return named.select("doc_id", "collapsed", "runs", longest.alias("r")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period",
        F.expr("r.length * 1000 div r.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in every tenth document, drawn from the CRC-32 of its id; the others as they are."""
    rows = texts(documents)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    drawn = rows.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    a = F.col("g") % n
    placed = drawn.select("doc_id", "text", "w", F.when(n > 0, a).alias("a"), F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p"))
    cycled = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get(
        "w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))
