"""Toxicity by a weighted lexicon.

Texts are lower-cased and folded: look-alike letters of other scripts, accents, and digits or signs that stand for
letters become plain letters. An Aho-Corasick automaton then finds the lexicon's words and word stems, except inside
exception phrases; the summed weights are divided by the number of words, and a logistic curve turns that density
into a score.

The lexicon, its exceptions and the curve are learned from labelled rows only, from a hash sample of at most about
``SAMPLE_ROWS`` of them (two thirds for the entries, one third for the curve). Every document is scored.

Cases: a null or empty text has density zero; a null doc_id counts as held out; a document labelled twice is toxic if
any label says so, a null label is no label; without toxic or without other labels the lexicon is empty and every
score is the share of toxic labels; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts

SAMPLE_ROWS = 20_000
MAX_ENTRIES = 2_000

# Letters of other scripts that look like Latin ones, and signs used in place of letters.
_LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
               "т": "t", "в": "b", "н": "h", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u",
               "χ": "x", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l"}
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in _LOOK_ALIKE.items()}
    for code in range(0xC0, 0x250):  # accented Latin letters become their base letter
        base = unicodedata.normalize("NFD", chr(code))[0]
        if ord(base) < 0x80:
            table.setdefault(code, base.lower())
    for code in range(26):  # full-width letters
        table[0xFF21 + code] = table[0xFF41 + code] = chr(ord("a") + code)
    table |= {code: "" for code in (*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370))}  # invisible, combining
    return table


_FOLD = _fold_table()
_SIGN = re.compile(r"[0134578@$](?=[a-z])|(?<=[a-z])[0134578](?=[a-z0-9])")
_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str) -> list[str]:
    """The words of a text after folding."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _WORD.findall(_SIGN.sub(lambda m: _STANDS_FOR[m.group()], text))


@dataclass
class Lexicon:
    """Entries are `` word `` (whole) or `` stem`` (word beginning), with spaces as borders, and their weights."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = 0.0
    slope: float = 0.0
    smoothing: float = 20.0

    def matcher(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            automaton.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def density(self, words: list[str], automaton: ahocorasick.Automaton) -> float:
        if not len(automaton) or not words:
            return 0.0
        found, excused = {}, []
        for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            else:  # the heaviest entry at a word counts
                found[start] = max(weight, found.get(start, 0.0))
        if excused:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in excused)}
        return math.fsum(found.values()) / (len(words) + self.smoothing)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * density))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _features(words: list[str], shortest: int = 3, longest: int = 8) -> set[str]:
    distinct = set(words)
    found = {f" {w} " for w in distinct}
    for size in range(shortest, longest + 1):
        found.update([f" {w[:size]}" for w in distinct if len(w) >= size])
    return found


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Labelled texts outside the held-out part: text, toxic, turn (0, 1: entries; 2: curve)."""
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    share = min(1.0, rows / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # Bounded by ``rows`` (in expectation), so it may go to every task.
    return texts(documents).join(F.broadcast(picked), "doc_id").select(
        "text", "toxic", F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(3)).alias("turn"))


def _counted(rows: DataFrame, observe) -> DataFrame:
    """Sum what ``observe(words)`` names, once per document, by label: (name, toxic, clean)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[1 if toxic else 0].update(observe(folded_words(text or "")))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][n] for n in names], pa.int64()), pa.array([seen[0][n] for n in names], pa.int64())],
                names=["name", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(count, "name string, toxic long, clean long")
    return counted.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _entries(counts: DataFrame, n_toxic: int, n_clean: int, least: int, confidence: float) -> dict[str, float]:
    """Entries whose smoothed log odds are surely positive; longer stems of a chosen, equally telling stem are left out."""
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(toxic / (n_toxic + 1)) - F.log(clean / (n_clean + 1))
    error = F.sqrt(1 / toxic + 1 / clean)
    rows = (
        counts.where(F.col("toxic") >= least).select("name", weight.alias("weight"), (weight / error).alias("z"))
        .where((F.col("z") >= confidence) & (F.col("weight") >= 1.5)).orderBy(F.desc("z"), "name").limit(MAX_ENTRIES).collect())
    chosen: dict[str, float] = {}
    for row in sorted(rows, key=lambda r: (len(r["name"].rstrip()), r["name"])):
        name = row["name"]
        covered = [chosen[name[:k]] for k in range(4, len(name.rstrip())) if name[:k] in chosen]
        if not covered or row["weight"] > max(covered) + 0.7:
            chosen[name] = float(row["weight"])
    return chosen


def _exceptions(rows: DataFrame, lexicon: Lexicon, least: int) -> tuple[str, ...]:
    """Two-word phrases with a lexicon word that nearly always stand in clean texts."""
    heads = frozenset(lexicon.weights)

    def phrases(words: list[str]) -> set[str]:
        def known(w: str) -> bool:
            return f" {w} " in heads or any(f" {w[:k]}" in heads for k in range(3, len(w) + 1))

        marked = [known(w) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], marked, marked[1:], strict=False) if x or y}

    found = _counted(rows, phrases).where((F.col("clean") >= least) & (F.col("toxic") * 10 <= F.col("clean")))
    return tuple(sorted(r["name"] for r in found.orderBy(F.desc("clean"), "name").limit(MAX_ENTRIES).collect()))


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Intercept and slope of the logistic curve, by Newton steps over binned densities."""
    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            bins = [round(min(lexicon.density(folded_words(t or ""), automaton), 2.0) * 500) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), batch.column("toxic").cast(pa.int64())], names=["bin", "toxic"])

    binned = (rows.select("text", "toxic").mapInArrow(densities, "bin long, toxic long")
              .groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect())  # at most 2 x 1001 rows
    x = np.array([[1.0, r["bin"] / 500] for r in binned])
    y, n = np.array([r["toxic"] for r in binned], float), np.array([r["n"] for r in binned], float)
    ridge, beta = np.diag([1e-3, 1e-3]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, gradient)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, least: int = 5, confidence: float = 4.0) -> Lexicon:
    """Fit the lexicon on labelled rows that are not held out."""
    rows = _sample(documents, labels, sample_rows)
    by_turn: dict[tuple[bool, bool], int] = {}
    for r in rows.groupBy((F.col("turn") == 2).alias("curve"), (F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect():
        by_turn[(r["curve"], r["bad"])] = r["n"]
    bad, good = by_turn.get((False, True), 0), by_turn.get((False, False), 0)
    share = (sum(n for (_, b), n in by_turn.items() if b) + 0.5) / (sum(by_turn.values()) + 1)
    lexicon = Lexicon(intercept=math.log(share / (1 - share)))
    if not bad or not good:
        return lexicon
    first = rows.where("turn != 2")
    lexicon.weights = _entries(_counted(first, _features), bad, good, least, confidence)
    if lexicon.weights:
        lexicon.exceptions = _exceptions(first, lexicon, least)
        if by_turn.get((True, True)) and by_turn.get((True, False)):
            lexicon.intercept, lexicon.slope = _curve(rows.where("turn = 2"), lexicon)
        else:
            lexicon.slope = 20.0
    return lexicon


def scores(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            found = [lexicon.score(lexicon.density(folded_words(t.as_py() or ""), automaton)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = texts(documents).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
