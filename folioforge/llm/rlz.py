"""Substring deduplication by anchor blocks and window hashes, in place of a relative Lempel-Ziv parse.

The texts of all documents are cut into blocks at anchors: in each window of ``WINDOW`` words the smallest hash of
``ANCHOR`` consecutive words is its anchor, equal windows have equal anchors, and the windows with one anchor
occurrence form a block. Blocks of all documents are indexed by their anchor.

Nothing is parsed into (position, length) factors. Whole blocks are compared by their hashes; where an anchor occurs
elsewhere but the block does not, the hashes of its single windows are looked up among the windows of all other blocks
with that anchor. Adjoining hits are joined, and what they cover is duplicate. The result is exactly the set of words
under windows that occur twice or more, because two equal windows always share their anchor. Equality is equality of
128 hash bits. A greedy parse would need the reference's text next to every document; joins of hashes need neither.

Anchors take about two in 27 word positions, so the index is a small part of the text; anchors that occur once never
meet anything. Counts are aggregated before they move, and frequent anchors or texts are only joined, never collected.

Cases: a null or empty text has no words and loses none; a text under ``WINDOW`` words has no factor; repeated rows are
occurrences of each other; ties between anchors go to the leftmost; an empty table gives no rows; a null doc_id stays
null; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import each_batch, text_bytes, texts
from folioforge.operators.lineage import fresh_path, remove, written_once, written_to

WINDOW = 35
ANCHOR = 10
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self, base: np.uint64):
        self._steps = (int(base), pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, step, np.uint64), dtype=np.uint64)]) for step in self._steps)


_POWERS = tuple(_Powers(base) for base in _BASES)


class Runs:
    """Hashes of any run of words of one text, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: list[bytes]):
        first = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self._sums = []
        for powers, values in zip(_POWERS, (first, _mix(first + np.uint64(1))), strict=True):
            powers.reach(len(words) + 1)
            self._sums.append(np.concatenate([[np.uint64(0)], np.cumsum(values * powers.up[:len(words)], dtype=np.uint64)]))

    def hashes(self, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self._sums[which]
        return _mix((sums[ends] - sums[starts]) * _POWERS[which].down[starts])


def blocks(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """The blocks of a text: anchor hash, block hash, first window, number of windows."""
    if len(words) < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    runs = Runs(words)
    at = np.arange(len(words) - anchor + 1)
    grams = runs.hashes(0, at, at + anchor)
    places = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(axis=1)
    anchors = places + np.arange(len(places))
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1])
    count = np.diff(np.append(first, len(anchors)))
    shape = (anchors[first] - first + count * 1024).astype(np.uint64)
    return grams[anchors[first]], _mix(runs.hashes(1, first, first + count + window - 1) + shape), first, count


def _keys(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit content keys of texts as two signed longs."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v) for v in values), "<i8").reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def _index(documents: DataFrame, window: int) -> DataFrame:
    """One row per block: seed, block, k1, k2, place (first window x 2**20 + number of windows)."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        values = list(text_bytes(batch.column("text")))
        found = [blocks(v.split(), window) for v in values]
        k1, k2 = _keys(values)
        counts = [len(f[0]) for f in found]
        seed, block, first, count = (np.concatenate([f[k] for f in found]) for k in range(4))
        return {
            "seed": seed.view(np.int64), "block": block.view(np.int64), "k1": np.repeat(k1, counts), "k2": np.repeat(k2, counts),
            "place": (first << 20) + count,
        }

    return each_batch(documents, "seed long, block long, k1 long, k2 long, place long", step)


def _compressed(documents: DataFrame) -> DataFrame:
    """doc_id, content key and the compressed text, which is what moves when texts have to."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        squeeze = zstandard.ZstdCompressor(level=1)
        values = list(text_bytes(batch.column("text")))
        k1, k2 = _keys(values)
        return {"doc_id": batch.column("doc_id"), "k1": k1, "k2": k2, "body": [squeeze.compress(v) for v in values]}

    return each_batch(documents, "doc_id long, k1 long, k2 long, body binary", step)


def _bodies(batch: pa.RecordBatch) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor()
    for value in batch.column("body"):
        yield expand.decompress(value.as_py())


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """The single windows of the asked blocks: h1, h2, k1, k2, start, known (the block is already a factor)."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name: [np.zeros(0, np.int64)] for name in ("h1", "h2", "k1", "k2", "start", "known")}
        rows = zip(_bodies(batch), batch.column("places").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
        for body, places, k1, k2 in rows:
            runs = Runs(body.split())
            packed, known = np.array([p["place"] for p in places], np.int64), np.array([p["known"] for p in places], bool)
            first, count = packed >> 20, packed & ((1 << 20) - 1)
            starts = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            for name, value in (
                ("h1", runs.hashes(0, starts, starts + window).view(np.int64)), ("h2", runs.hashes(1, starts, starts + window).view(np.int64)),
                ("k1", np.full(len(starts), k1)), ("k2", np.full(len(starts), k2)), ("start", starts), ("known", np.repeat(known, count)),
            ):
                out[name].append(value)
        return {name: np.concatenate(values).astype(bool if name == "known" else np.int64) for name, values in out.items()}

    return each_batch(asked, "h1 long, h2 long, k1 long, k2 long, start long, known boolean", step)


def factors(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The parse: one row per distinct text with factors: k1, k2, places (first window x 2**20 + number of windows)."""
    spark = documents.sparkSession
    path = fresh_path(spark, "blocks")
    index = written_to(_index(documents, window), path)

    # Written before it is joined: each side of the join is then dealt out by itself, and frequent anchors can be split.
    shared = written_once(
        index.groupBy("seed").agg(F.count("*").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))
        .where("n > 1").select("seed", (F.col("least") == F.col("most")).alias("alike")))
    met_path = fresh_path(spark, "met")
    met = written_to(index.join(shared, "seed"), met_path)
    remove(spark, path)

    # Blocks that meet the same anchor in other surroundings: those that occur once are boundaries.
    mixed = met.where("NOT alike").groupBy("seed", "block").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    mixed = written_once(mixed)
    whole = met.where("alike").select("k1", "k2", "place").union(
        met.where("NOT alike").join(mixed.where("n > 1").select("seed", "block"), ["seed", "block"]).select("k1", "k2", "place"))

    places = F.collect_list(F.struct(F.col("one.place").alias("place"), (F.col("n") > 1).alias("known")))
    asked = written_once(mixed.groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(places.alias("places")))
    single = written_once(_windows(_compressed(documents).join(asked, ["k1", "k2"]), window))
    twice = single.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("known").alias("all_known")).where("n > 1 AND NOT all_known")
    twice = written_once(twice.select("h1", "h2"))
    boundary = single.where("NOT known").join(twice, ["h1", "h2"]).select("k1", "k2", (F.col("start") * (1 << 20) + 1).alias("place"))

    # Copies of a text have the same factors: they are told once.
    result = whole.union(boundary).distinct().groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    result = written_once(result)
    remove(spark, met_path)
    return result


def covered(n_words: int, places: list[int], window: int = WINDOW) -> np.ndarray:
    """The words under the factors: a mask over the words of a text."""
    edges = np.zeros(n_words + 1, np.int64)
    packed = np.array(places, np.int64)
    first, count = packed >> 20, packed & ((1 << 20) - 1)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + count + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def deduplicated(documents: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word, words, of each joined factor), kept_sha256 and the kept text."""
    rows = texts(documents)
    joined = _compressed(rows).join(factors(rows, window), ["k1", "k2"], "left")
    schema = "doc_id long, n_words long, n_removed long, spans array<long>, kept_sha256 string" + ", kept string" * with_text

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {part.split(" ")[0]: [] for part in schema.split(", ")}
        for body, places in zip(_bodies(batch), batch.column("places").to_pylist(), strict=True):
            words = body.split()
            gone = covered(len(words), places or [], window)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if places else words)
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append(np.stack([turns[::2], turns[1::2] - turns[::2]], axis=1).ravel())
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept.decode("utf-8", "replace"))
        return out | {"doc_id": batch.column("doc_id")}

    return each_batch(joined.select("doc_id", "body", "places"), schema, step)
