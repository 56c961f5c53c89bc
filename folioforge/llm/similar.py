"""Near-duplicates by the similarity of their word shingles: five words, Jaccard 0.8 or more.

At similarity 0.8 SimHash fingerprints differ in about ten of 64 bits and often in more, where unrelated texts of a large
corpus meet as well. So candidates come from min-hashes of the shingles: 16 bands of four, which meet with a chance of
0.9998 at 0.8. Every candidate pair is verified by the exact Jaccard similarity of its shingle sets.

Copies never meet: the search runs over distinct texts (words with A-Z lower-cased). In a bucket of up to ``DENSE``
texts all pairs are compared. In a larger one each text is compared with one of its texts, another in every band; then the texts are dealt
into hands of about ``DEALT``, whose texts are compared where they are not joined yet. That already joins a group of near copies. What else the texts of such buckets could be similar to is found exactly among all of them (:func:`crowded_links`): two
sets of similarity 0.8 share one of their rarest shingles, so texts that have only a common passage in common never meet, and texts
already joined are not compared again. ``dense`` thus changes the plan and never a group.

Cases: null and wordless texts are copies of each other; a text under five words is one shingle; rows with the same
doc_id are separate; a null doc_id stands for its group only if no member has one; very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import each_batch, small_batches, text_bytes
from folioforge.llm.components import roots
from folioforge.operators.keyed import dealt_out
from folioforge.operators.lineage import written_once

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
DENSE, DEALT = 8, 4

_RANDOM = np.random.default_rng(42)
_N_HASHES = BANDS * ROWS
_MULTIPLY = _RANDOM.integers(0, 2**63, _N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 2**63, _N_HASHES, dtype=np.uint64)


def text_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 42)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of all word shingles, ascending."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(w), 42) for w in zip(*(words[k:] for k in range(shingle)), strict=False)), np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(_N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at:at + 2048, None] ^ _MIX) * _MULTIPLY
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return least


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def sketches(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, buckets) of the columns doc_id and text: one bucket per band."""
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        keys, buckets = [], []
        for text in text_bytes(batch.column("text")):
            words = _words(text)
            bands = min_hashes(shingles(words, shingle)).reshape(BANDS, ROWS)
            keys.append(text_key(words))
            buckets.append(np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(bands)], np.uint64).view(np.int64))
        return {"doc_id": batch.column("doc_id"), "key": np.array(keys, np.uint64).view(np.int64), "buckets": buckets}

    return each_batch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, key long, buckets array<long>", step)


def _key_of(text: Column) -> Column:
    @F.arrow_udf("long")
    def apply(column: pa.Array) -> pa.Array:
        return pa.array(np.array([text_key(_words(t)) for t in text_bytes(column)], np.uint64).view(np.int64))

    return apply(text)


def _shingles_of(text: Column, shingle: int) -> Column:
    @F.arrow_udf("array<long>")
    def apply(column: pa.Array) -> pa.Array:
        return pa.array([shingles(_words(t), shingle).view(np.int64) for t in text_bytes(column)], type=pa.list_(pa.int64()))

    return apply(text)


def _sets(keys: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(key, s): the shingles of each of the distinct keys; ``texts`` has (key, text), one row or more per key."""
    return written_once(texts.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", _shingles_of(F.col("text"), shingle).alias("s")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    both = pairs.join(dealt_out(sets.toDF("a", "sa")), "a").join(dealt_out(sets.toDF("b", "sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return written_once(both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def _least_common(size: Column, other: Column, similarity: float) -> Column:
    """How many shingles two similar sets of these sizes have in common at least."""
    return F.ceil((size + other) * (similarity / (1 + similarity)) - 1e-6)


def crowded_links(sets: DataFrame, joined: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join all similar ones of the sets (key, s), beyond those that ``joined`` (node, root) has together.

    Shingles are ordered from the rarest to the most frequent one. The first one that two similar sets share stands so early in
    both that enough can still follow: in the smaller set among the first ninth, in the larger one among the first fifth (at
    0.8). Texts meet on these shingles only, by groups that are not joined yet, under both sizes and places.
    """
    sized = sets.select("key", F.size("s").alias("size"), F.explode("s").alias("shingle"))
    # Written first, so that a shingle of very many texts can be split in the join.
    frequent = written_once(sized.groupBy("shingle").agg(F.count("*").alias("texts")))
    ordered = sized.join(dealt_out(frequent), "shingle").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("s"))
    early = ordered.select("key", "size", F.posexplode(F.slice("s", F.lit(1), (F.col("size") - F.ceil(F.col("size") * similarity - 1e-6) + 1).cast("int"))).alias("place", "x"))
    grouped = early.where("x.texts > 1").join(dealt_out(joined.withColumnRenamed("node", "key")), "key", "left")
    placed = written_once(grouped.select("key", "size", "place", "x.shingle", F.coalesce("root", "key").alias("root")))
    first = F.col("place") <= F.col("size") - _least_common(F.col("size"), F.col("size"), similarity)
    apart = placed.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("shingle")
    held = written_once(placed.join(dealt_out(apart), "shingle", "left_semi"))
    small, large = held.where(first), held
    # Most groups are single texts, for which these bounds already decide about sizes and places.
    bounds = lambda rows, t: rows.groupBy("shingle", F.col("root").alias(f"r{t}")).agg(
        F.min("size").alias(f"low_{t}"), F.max("size").alias(f"high_{t}"), F.max(F.col("size") - F.col("place")).alias(f"rest_{t}"))
    fewest = _least_common(F.col("low_a"), F.col("low_b"), similarity)
    could = (F.col("ra") != F.col("rb")) & (F.col("low_a") <= F.col("high_b")) & (F.col("high_a") >= F.ceil(F.col("low_b") * similarity - 1e-6)) & (
        (F.col("rest_a") >= fewest) & (F.col("rest_b") >= fewest))
    groups = bounds(small, "a").withColumnRenamed("shingle", "x").join(dealt_out(bounds(large, "b")), (F.col("x") == F.col("shingle")) & could).select("shingle", "ra", "rb")
    groups = written_once(groups)
    meet = groups.join(dealt_out(small.select("shingle", F.col("root").alias("ra"), F.col("key").alias("a"), F.col("size").alias("na"), F.col("place").alias("pa"))), ["shingle", "ra"])
    meet = meet.join(dealt_out(large.select("shingle", F.col("root").alias("rb"), F.col("key").alias("b"), F.col("size").alias("nb"), F.col("place").alias("pb"))), ["shingle", "rb"])
    least = _least_common(F.col("na"), F.col("nb"), similarity)
    able = (F.col("na") <= F.col("nb")) & (F.col("na") >= least) & (F.col("na") - F.col("pa") >= least) & (F.col("nb") - F.col("pb") >= least)
    pairs = written_once(meet.where(able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return _verified(pairs, sets, similarity)


def links(classes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, dense: int = DENSE) -> DataFrame:
    """Verified links (a, b) between distinct texts given as (key, buckets)."""
    placed = written_once(classes.select("key", F.explode("buckets").alias("bucket")))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64("key", "bucket")).alias("hub")).where("n > 1")
    sizes = written_once(sizes)
    few, many = sizes.where(F.col("n") <= dense).select("bucket"), sizes.where(F.col("n") > dense)
    held = placed.join(dealt_out(few), "bucket")
    pairs = held.toDF("bucket", "a").join(dealt_out(held.toDF("bucket", "b")), "bucket").where("a < b").select("a", "b")
    hand = F.pmod(F.xxhash64("key", "bucket"), F.greatest(F.lit(1), (F.col("n") / DEALT).cast("long")))
    crowded = written_once(placed.join(dealt_out(many), "bucket").select("key", F.xxhash64("bucket", hand).alias("bucket"), "hub"))
    starred = crowded.where("key != hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
    pairs = written_once(pairs.union(starred).distinct())
    found = _verified(pairs, _sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), texts, shingle), similarity)
    if not crowded.head(1):
        return found
    sets = _sets(crowded.select("key").distinct(), texts, shingle)
    # The hubs have joined most of a group of near copies; hands compare only texts that are still apart.
    grouped = roots(found).withColumnRenamed("node", "key")
    dealt = written_once(crowded.select("key", "bucket").join(dealt_out(grouped), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root")))
    hands = dealt.toDF("bucket", "a", "ra").join(dealt_out(dealt.toDF("bucket", "b", "rb")), "bucket").where("a < b AND ra != rb").select("a", "b")
    found = found.union(_verified(written_once(hands.distinct()), sets, similarity))
    return found.union(crowded_links(sets, roots(found), similarity))


def representatives(documents: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, dense: int = DENSE) -> DataFrame:
    """One row of each group with all its columns: the one with the smallest doc_id (any of fully repeated rows)."""
    small_batches(documents.sparkSession)
    columns = documents.columns
    text = documents[text_col].cast("string")
    members = written_once(sketches(documents.select("doc_id", text.alias("text")), shingle))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    classes = written_once(members.groupBy("key").agg(F.min(order).alias("first"), F.first("buckets").alias("buckets")))
    texts = documents.select(_key_of(text).alias("key"), text.alias("text"))
    rooted = roots(links(classes.select("key", "buckets"), texts, shingle, similarity, dense)).select(F.col("node").alias("key"), "root")
    joined = classes.select("key", "first").join(dealt_out(rooted), "key", "left")
    least = joined.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("least"))
    chosen = written_once(least.select(F.col("least.doc_id").alias("_id"), F.col("least.key").alias("_key")))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), _key_of(text).alias("_own"))
    same = [F.xxhash64("_row.doc_id", "_own") == F.xxhash64(F.col("_id").cast(documents.schema["doc_id"].dataType), "_key"),
            F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))]
    kept = rows.join(dealt_out(chosen), same, "left_semi").select("_row", F.col("_row.doc_id").alias("_id"), "_own").dropDuplicates(["_id", "_own"])
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])
