"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, lower-cased. Every fixed mask keeps five word positions of a short span and
ignores the others. Hashes of the kept words are joined between test items and training texts, so a substituted word
at an ignored position does not hide a hit. Each hit names a diagonal (item against text without gaps); on it the
words are compared one by one, and a text is contaminated if some stretch of ``WINDOW`` words (or the whole item, if
shorter) agrees in 80 percent of its words.

The three masks together meet every regular substitution of each fifth word. They share their first and last word pair,
so that two small bit sets of the items' pairs spare nearly all positions of the texts a row. Items with fewer words than the shortest
span cannot be told from chance and are never matched.

Cases: a null or empty text or item has no words and no hits; equal texts are decided once, by content, and all their
rows share the decision; a null item_id is reported as null; very long texts are read whole; empty tables give no
rows; other columns are ignored by :func:`contaminated` and kept by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import let
from folioforge.operators.lineage import written_once

# Kept offsets of each mask; five words each, and never all residues modulo five.
MASKS = ((0, 1, 2, 5, 6), (0, 1, 3, 5, 6), (0, 1, 4, 5, 6))
WINDOW = 13
SIMILARITY = 0.8
# Seeds of the items go to every task, and their word pairs through the driver, up to this number of rows (under 64 MB);
# beyond it the join shuffles and every position gets its rows.
BROADCAST_SEEDS = 1_500_000
# The diagonals of hits find their texts the same way up to this number (under 64 MB with their keys).
BROADCAST_DIAGONALS = 1_000_000


def word_list(text: Column) -> Column:
    """The words of a text: maximal runs of letters and digits, lower-cased."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _pairs(words: Column) -> Column:
    """The hash of each word with the next one."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _bitmap(hashes: list[int], most: int = 1 << 20) -> tuple[Column, int]:
    """A bit set of hashes as a constant array of longs, and its size in bits (a power of two)."""
    size = min(most, max(64, 1 << (16 * max(1, len(hashes)) - 1).bit_length()))
    longs = [0] * (size // 64)
    for h in hashes:
        at = h & (size - 1)
        longs[at >> 6] |= 1 << (at & 63)
    signed = [v - (1 << 64) if v >> 63 else v for v in longs]
    return F.from_json(F.lit(str(signed)), "array<bigint>"), size


def _in_bitmap(bitmap: tuple[Column, int], h: Column) -> Column:
    longs, size = bitmap
    word = F.get(longs, F.shiftright(h.bitwiseAND(F.lit(size - 1).cast("bigint")), 6).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _seeds(text: Column, heads: tuple | None = None, tails: tuple | None = None) -> Column:
    """Array of (at, seeds): word positions of a text and the masked hashes that begin there.

    All masks keep the word pair at their start and the one at their end. With bit sets of the items' first and
    last pairs only positions where both may occur in an item get hashes and, later, rows.
    """
    last = MASKS[0][-1]

    def seeds_at(words: Column, i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(number), *[F.get(words, i + k) for k in mask]) for number, mask in enumerate(MASKS)])

    def found(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1 - last)
        if heads is not None:
            places = let(_pairs(words), lambda pairs: F.filter(places, lambda i: (
                _in_bitmap(heads, F.get(pairs, i)) & _in_bitmap(tails, F.get(pairs, i + last - 1)))))
        all_seeds = F.transform(places, lambda i: F.struct(i.alias("at"), seeds_at(words, i).alias("seeds")))
        return F.when(F.size(words) > last, all_seeds)

    return let(word_list(text), found)


def _rows(df: DataFrame, keep: list[str], places: Column, at: str) -> DataFrame:
    """One row per position and mask."""
    # The outer form keeps the optimizer from computing the array once more in a filter.
    placed = df.select(*keep, F.explode_outer(places).alias("place")).where("place IS NOT NULL")
    return placed.select(*keep, F.col("place.at").alias(at), F.explode("place.seeds").alias("seed"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Verified overlaps: text_key, item_id, start (first word in the text), matched and length (words), for the best stretch."""
    spark = documents.sparkSession
    items = written_once(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_list(F.col("text")).alias("item_words"))
        .where(F.size("item_words") > min(m[-1] for m in MASKS)))
    numbered = items.select(F.xxhash64("item_words").alias("item"), "item_words").dropDuplicates(["item"])
    texts_of = items.select(F.xxhash64("item_words").alias("item"), F.array_join("item_words", " ").alias("text")).dropDuplicates(["item"])
    item_seeds = written_once(_rows(texts_of, ["item"], _seeds(F.col("text")), "item_at"))
    heads = tails = None
    if item_seeds.count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
        last = MASKS[0][-1]
        pairs = numbered.select(F.size("item_words").alias("n"), F.posexplode(_pairs(F.col("item_words"))).alias("i", "pair"))
        heads, tails = (
            _bitmap([r[0] for r in pairs.where(part).select("pair").distinct().collect()])
            for part in (F.col("i") < F.col("n") - last, (F.col("i") >= last - 1) & (F.col("i") < F.col("n") - 1)))

    keyed = documents.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    text_seeds = _rows(keyed, ["text_key"], _seeds(F.col("text"), heads, tails), "text_at")
    met = text_seeds.join(item_seeds, "seed").select("text_key", "item", (F.col("text_at") - F.col("item_at")).alias("diagonal"))
    diagonals = written_once(met.distinct())

    by_text = diagonals.groupBy("text_key").agg(F.collect_list(F.struct("item", "diagonal")).alias("found"))
    # Copies of a text are decided once; only texts with a hit are looked at again.
    if diagonals.count() <= BROADCAST_DIAGONALS:
        by_text = F.broadcast(by_text)
    again = keyed.join(by_text, "text_key").dropDuplicates(["text_key"])
    lined = (
        again.select("text_key", word_list(F.col("text")).alias("words"), F.explode("found").alias("hit"))
        .select("text_key", "words", F.col("hit.item").alias("item"), F.col("hit.diagonal").alias("diagonal"))
        .join(numbered, "item"))
    first = F.greatest(F.col("diagonal"), F.lit(0))
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    length = F.least(F.size("words") - first, F.size("item_words") - skipped)
    equal = F.zip_with(
        F.slice("words", first + 1, length), F.slice("item_words", skipped + 1, length), lambda a, b: F.when(a == b, 1).otherwise(0))
    need = F.least(F.size("item_words"), F.lit(WINDOW))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("equal") - F.col("need") + 1),
        lambda i: F.struct(F.aggregate(F.slice("equal", i, F.col("need")), F.lit(0), lambda s, x: s + x).alias("matched"), (-i).alias("at")))
    best = (
        lined.select("text_key", "item", first.alias("first"), need.alias("need"), equal.alias("equal"))
        .where(F.size("equal") >= F.col("need")).withColumn("best", F.array_max(windows))
        .where(F.col("best.matched") >= F.lit(SIMILARITY) * F.col("need")))
    names = items.select(F.xxhash64("item_words").alias("item"), "item_id")
    return best.select(
        "text_key", "item", (F.col("first") - F.col("best.at") - 1).alias("start"), F.col("best.matched").alias("matched"),
        F.col("need").alias("length")).join(names, "item").drop("item")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document: doc_id, item_ids (ascending), n_items, start and similarity of the best overlap."""
    # Written before rows are joined to it, so that the rows of a text with very many copies can be split over tasks.
    found = written_once(hits(documents, benchmark).groupBy("text_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max(F.struct((F.col("matched") / F.col("length")).alias("similarity"), (-F.col("start")).alias("place"))).alias("best")))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    return ids.join(found, "text_key").select(
        "doc_id", "item_ids", F.size("item_ids").cast("long").alias("n_items"), (-F.col("best.place")).cast("long").alias("start"),
        F.col("best.similarity").alias("similarity"))


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without contamination, with all their columns."""
    bad = written_once(hits(documents, benchmark, text_col).select("text_key").distinct())
    return documents.join(bad, text_key(documents[text_col]) == bad["text_key"], "left_anti")
