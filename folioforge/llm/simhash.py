"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so links (at most three differing bits) are looked for among
vectors within Manhattan distance three: in one of the two halves of the vector (16 counts each) they are then at
most one apart. Each half is a grid with one cell per vector. A fingerprint is put into its own cell of both grids;
one with an odd bit count also asks in the adjacent cells, because vectors exactly one apart differ in parity. Pairs
that meet are verified by their Hamming distance inside the join.

Copies never meet: the join runs over distinct fingerprints. A cell with more than ``DENSE`` fingerprints is not
paired; its fingerprints go through :func:`ball_links`, which connects the same links by meeting points in linear
size.

Cases: a null or wordless text has fingerprint zero, which links like any other; rows with the same doc_id are
separate members; a null doc_id is never the component's id unless no member has one; an empty table gives no rows;
very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import each_batch, text_bytes, texts
from folioforge.llm.components import roots
from folioforge.operators.keyed import dealt_out
from folioforge.operators.lineage import written_once

MAX_DISTANCE = 3
DENSE = 512
_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of a text (A-Z lower-cased), as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(w), seed) for w in zip(*(words[k:] for k in range(shingle)), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(np.array(hashes[at:at + 65_536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        values = np.array([fingerprint(t) for t in text_bytes(batch.column("text"))], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": values.view(np.int64)}

    return each_batch(texts(documents), "doc_id long, fp long", step)


def popcounts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each count in the two bits of its segment."""
    return (fps & _LOW) + ((fps >> np.uint64(1)) & _LOW)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid cells of each fingerprint: (index into fps, cell, whether it is the own cell)."""
    counts = popcounts(fps)
    index, cell, own = [], [], []
    for half in range(2):
        place = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        grid = np.uint64(half) << np.uint64(32)
        index.append(np.arange(len(fps)))
        cell.append(place | grid)
        own.append(np.ones(len(fps), bool))
        digits = (place[:, None] >> (2 * np.arange(16, dtype=np.uint64))) & np.uint64(3)
        odd = digits.sum(axis=1) % 2 == 1
        for k in range(16):
            unit = np.uint64(1 << (2 * k))
            for allowed, moved in ((digits[:, k] < 2, place + unit), (digits[:, k] > 0, place - unit)):
                hit = np.flatnonzero(odd & allowed)
                index.append(hit)
                cell.append(moved[hit] | grid)
                own.append(np.zeros(len(hit), bool))
    return np.concatenate(index), np.concatenate(cell).view(np.int64), np.concatenate(own)


def _ball(radius: int) -> np.ndarray:
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(64), r)]
    return np.array(masks, np.uint64)


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within three bits of each other, without forming pairs.

    Fingerprints within three bits share a point within one bit of the one and two of the other. At every point the
    smallest fingerprint within one bit is linked to all within two bits of the point; each such link is a true one.
    """
    def points(radius: int) -> DataFrame:
        masks = _ball(radius)

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            values = batch.column("fp").to_numpy().view(np.uint64)
            return {"point": (values[:, None] ^ masks).ravel().view(np.int64), "fp": np.repeat(values, len(masks)).view(np.int64)}

        return each_batch(fps.select("fp"), "point long, fp long", step)

    hubs = points(1).groupBy("point").agg(F.min("fp").alias("b"))
    return points(2).join(dealt_out(hubs), "point").where("fp != b").select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that give the components of 'at most three differing bits'."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        values = batch.column("fp").to_numpy().view(np.uint64)
        index, cell, own = cells(values)
        return {"cell": cell, "fp": values.view(np.int64)[index], "own": own}

    placed = written_once(each_batch(fps.select("fp"), "cell long, fp long, own boolean", step))
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("cell")
    # Known after one aggregation, and mostly empty.
    crowded = written_once(crowded)
    has_crowded = bool(crowded.head(1))
    sparse = placed.join(crowded, "cell", "left_anti") if has_crowded else placed
    held = sparse.where("own").select("cell", F.col("fp").alias("a"))
    asking = sparse.select("cell", F.col("fp").alias("b"), "own")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    found = held.join(asking, [held["cell"] == asking["cell"], near & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))])
    found = found.select("a", "b")
    if has_crowded:
        found = found.union(ball_links(placed.join(crowded, "cell", "left_semi").select("fp").distinct()))
    return found


def _named(members: DataFrame, dense: int) -> DataFrame:
    """(fp, component_id, component_fp): the component's smallest doc_id and a fingerprint that it has there."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp")
    classes = written_once(members.groupBy("fp").agg(F.min(order).alias("first")))
    rooted = roots(links(classes, dense)).select(F.col("node").alias("fp"), "root")
    joined = classes.join(dealt_out(rooted), "fp")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    linked = joined.join(dealt_out(least), "root").select("fp", "least")
    # Written before rows are joined to it: the rows are then dealt out by themselves, and frequent fingerprints can be split.
    whole = written_once(classes.join(dealt_out(linked), "fp", "left").select("fp", F.coalesce("least", "first").alias("least")))
    return whole.select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.fp").alias("component_fp"))


def clusters(documents: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; the component is named by its smallest doc_id."""
    members = written_once(fingerprints(documents))
    return members.join(dealt_out(_named(members, dense).drop("component_fp")), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row of each component with all its columns: the one with the smallest doc_id (any of fully repeated rows)."""
    @F.arrow_udf("long")
    def fp_of(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in text_bytes(column)], np.uint64).view(np.int64))

    columns = documents.columns
    members = written_once(fingerprints(documents.select("doc_id", F.col(text_col).alias("text"))))
    chosen = _named(members, dense).select(F.col("component_id").alias("_id"), F.col("component_fp").alias("_fp")).distinct()
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), fp_of(documents[text_col].cast("string")).alias("_own"))
    same = [F.xxhash64("_row.doc_id", "_own") == F.xxhash64(F.col("_id").cast(documents.schema["doc_id"].dataType), "_fp"),
            F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_fp"))]
    kept = rows.join(dealt_out(chosen), same, "left_semi").select("_row", F.col("_row.doc_id").alias("_id"), "_own").dropDuplicates(["_id", "_own"])
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])
