"""Best-fit packing with length patterns fitted by non-negative least squares.

Only the histogram of piece lengths (at most ``size`` counts) decides the packing, so it is planned once on the
driver at any data size: patterns of up to four lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded, and what is left over is packed
best fit, longest first, with counts instead of single pieces. The plan says for every length which ranks go to
which sequences; ranks come from counts per task, so pieces of one frequent length are spread over all tasks.

Cases: a null or empty text is one piece with the closing id only; rows with the same doc_id are separate documents
(their pieces are alike and each is packed once); a text longer than ``size`` is cut into whole pieces and a rest;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import give_back, small_batches, texts
from folioforge.llm.tokens import CACHE_ENTRIES, WORD_BPE, encoder
from folioforge.operators.lineage import written_once

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def enumerate_patterns(lengths: list[int], size: int, partners: int = 8) -> list[tuple[int, ...]]:
    """Tuples of one to four occurring lengths that add up to ``size``.

    For each largest length all pairs are taken, and triples and quadruples with up to ``partners`` evenly spaced
    second lengths (and three third ones), so their number grows only with the number of lengths.
    """
    present, ordered = set(lengths), sorted(lengths)
    found: set[tuple[int, ...]] = {(size,)} & {(n,) for n in lengths}

    def spaced(low: int, high: int, count: int) -> list[int]:
        a, b = bisect_left(ordered, low), bisect_left(ordered, high + 1)
        if b <= a:
            return []
        return [ordered[k] for k in sorted({a + (b - 1 - a) * j // max(1, count - 1) for j in range(count)})]

    for first in ordered:
        rest = size - first
        if 0 < rest <= first and rest in present:
            found.add((first, rest))
        for second in spaced(1, min(first, rest - 1), partners):
            third = rest - second
            if 0 < third and third in present:
                found.add(tuple(sorted((first, second, third), reverse=True)))
            for inner in spaced(1, min(second, third - 1), 3):
                if third - inner in present:
                    found.add(tuple(sorted((first, second, inner, third - inner), reverse=True)))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], histogram: dict[int, int], rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose summed patterns come closest to the histogram (accelerated projected gradient)."""
    lengths = sorted(histogram)
    place = {n: k for k, n in enumerate(lengths)}
    rows = np.array([place[n] for p in patterns for n in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    target = np.array([histogram[n] for n in lengths], float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[cols], len(lengths))

    def backward(r: np.ndarray) -> np.ndarray:
        return np.bincount(cols, r[rows], len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(30):  # power iteration for the step length
        probe = backward(forward(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * float(probe @ backward(forward(probe))))
    x = ahead = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(rounds):
        new = np.maximum(0, ahead - step * backward(forward(ahead) - target))
        new_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / new_pace * (new - x)
        x, pace = new, new_pace
    return x


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: (lengths in a sequence, number of such sequences)."""
    open_by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, space: int) -> None:
        if not space:
            done.append((pattern, count))
            return
        if space not in open_by_space:
            open_by_space[space] = []
            insort(spaces, space)
        open_by_space[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put((length,) * each, full, size - each * length)
                if rest:
                    put((length,) * rest, 1, size - rest * length)
                break
            space = spaces[at]
            pattern, count = open_by_space[space].pop()
            if not open_by_space[space]:
                del open_by_space[space], spaces[at]
            # Further pieces of this length go into the same sequences, as long as they fit.
            each = min(space // length, left)
            used = min(count, left // each)
            left -= used * each
            put((*pattern, *(length,) * each), used, space - each * length)
            if count > used:
                put(pattern, count - used, space)
    return done + [pair for space in spaces for pair in open_by_space[space]]


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """The whole packing for a histogram of lengths from 1 to ``size``."""
    left = Counter(histogram)
    chosen: list[tuple[tuple[int, ...], int]] = []
    patterns = enumerate_patterns(list(histogram), size)
    if patterns:
        repeats = np.rint(fit_repeats(patterns, histogram)).astype(int)
        for k in np.argsort(-repeats, kind="stable").tolist():
            if not repeats[k]:
                break
            need = Counter(patterns[k])
            times = min(int(repeats[k]), *(left[n] // c for n, c in need.items()))
            if times:
                chosen.append((patterns[k], times))
                left.subtract({n: c * times for n, c in need.items()})
    return chosen + best_fit({n: c for n, c in left.items() if c}, size)


def pieces(documents: DataFrame, size: int = 4096, tokenizer: str = WORD_BPE, end_id: int = 1, with_ids: bool = False,
           cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Every document as pieces of at most ``size`` ids; a piece also knows its rank among its task's equal lengths."""
    end, spare = np.array([end_id], "<u4").tobytes(), cache_entries < CACHE_ENTRIES
    if spare:
        small_batches(documents.sparkSession)
    schema = _PIECES + ", ids array<int>" * with_ids
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            encoded = encoder(tokenizer, cache_entries).stream(batch.column("text"))
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                raw = ids + end
                for number, at in enumerate(range(0, len(raw), 4 * size)):
                    body = raw[at:at + 4 * size]
                    length = len(body) // 4
                    row = (doc_id, number, at // 4, length, zlib.crc32(body), part, seen[length])
                    rows.append((*row, np.frombuffer(body, "<u4").astype(np.int32)) if with_ids else row)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], type=kinds[k]) for k in range(len(names))], names=names)
        if spare:
            encoder(tokenizer, cache_entries).forget()
            give_back()

    return texts(documents).mapInArrow(cut, schema)


def pack(cut: DataFrame, size: int = 4096) -> DataFrame:
    """Give every piece of a written table from :func:`pieces` its ``sequence_id`` and ``offset``.

    The histogram reaches the driver as one row per length (at most ``size``); the plan goes back to the tasks and
    has as many entries as patterns have lengths, which depends on the number of lengths and not on the data.
    """
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    starts: dict[int, tuple[list[int], list[int], list[int]]] = {n: ([], [], []) for n in totals}
    next_rank, sequence = Counter(), 0
    for pattern, times in plan(totals, size) if totals else []:
        offset = 0
        for length in pattern:
            for column, value in zip(starts[length], (next_rank[length], sequence, offset), strict=True):
                column.append(value)
            next_rank[length] += times
            offset += length
        sequence += times
    dealt = cut.sparkSession.sparkContext.broadcast({n: tuple(np.array(c, np.int64) for c in cs) for n, cs in starts.items()})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("rank_base") + F.col("local_rank"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        sequences, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            begins, sequence_of, offset_of = dealt.value[int(length[group[0]])]
            slot = np.searchsorted(begins, rank[group], side="right") - 1
            sequences[group] = sequence_of[slot] + rank[group] - begins[slot]
            offsets[group] = offset_of[slot]
        return pa.StructArray.from_arrays([pa.array(sequences), pa.array(offsets)], names=["sequence_id", "offset"])

    return ranked.withColumn("at", place("length", "rank")).select(
        *[c for c in cut.columns if c not in ("part", "local_rank")], "at.sequence_id", "at.offset")


def packed(documents: DataFrame, size: int = 4096, tokenizer: str = WORD_BPE, end_id: int = 1, with_ids: bool = False,
           cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Cut, write the pieces once, and pack them: one row per piece."""
    return pack(written_once(pieces(documents, size, tokenizer, end_id, with_ids, cache_entries)), size)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The id arrays of the sequences, from pieces packed ``with_ids``; a group holds at most ``size`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
