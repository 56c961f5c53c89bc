"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans come from four regular expressions with checks. They seed a bootstrapping round over identifier-like
strings (words with a digit or an at sign): each occurrence links its string (instance) to two lexical patterns, the
two words before it, and the word before with the word after it. Patterns are scored by the share of their distinct
instances that belong to a kind, instances by the trusted patterns they occur in, and so on for a few rounds. Strings
that trusted patterns vouch for become spans of that kind although no base expression matches them.

Everything runs as built-in expressions and joins. Positions come from splitting a text by the same expression that
extracts the matches, so lengths of gaps and matches add up to code point offsets in linear time.

Cases: a null text is empty; an empty text has no spans; a null doc_id stays null; equal texts get equal spans; an empty
table gives no rows; other columns are ignored by :func:`detect` and kept by :func:`redact`; texts are read whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import let
from folioforge.operators.lineage import written_once

# The kinds in their order, and their expressions. Matching may begin only where a run begins or the last
# match ended, and runs are possessive: both leave the matches as they are and keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
# An identifier-like string: a word with a digit or an at sign, and directly following words that begin like a number.
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20(?=\+?\(?[0-9])\S++)*+"

ROUNDS = 3
MIN_SEEDS = 5
TRUST = 0.9
MIN_IDENTIFIER_DIGITS = 6
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Prefix sums of an array, in blocks so that the work stays near linear."""
    def extend(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def blocks(values: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), ((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x))
        bases = F.slice(F.aggregate(totals, F.array(F.lit(0)), extend), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, bases, lambda part, base: F.slice(
            F.aggregate(part, F.array(base), extend), F.lit(2), F.size(part))))

    return let(lengths, lambda values: let(blocks(values), summed))


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)

    def luhn(mirrored: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            digit = F.substr(mirrored, i, F.lit(1)).cast("int")
            double = digit * 2
            return acc + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

        return F.aggregate(F.sequence(F.lit(1), F.length(mirrored)), F.lit(0), add) % 10 == 0

    return F.when(F.length(match) < 14, False).when(F.length(digits).between(14, 19), let(F.reverse(digits), luhn)).otherwise(False)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap necessary condition, so that most texts skip the expression."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def _split(df: DataFrame, name: str, pattern: str, holds: Column) -> DataFrame:
    """Add ``name_m`` (matches) and ``name_g`` (the gaps around them, one more); empty where ``holds`` is false."""
    empty = F.array().cast("array<string>")
    return (
        df.withColumn(f"{name}_m", F.when(holds, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(empty))
        .withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split("text", pattern, -1)).otherwise(empty)))


def _spans(name: str, keep, make) -> Column:
    """Structs made by ``make(start, end, match, gap before, gap after)`` for the matches that pass ``keep``."""
    gaps, matches = F.col(f"{name}_g"), F.col(f"{name}_m")
    ends = _running(F.zip_with(gaps, matches, lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0))))
    count = F.size(matches)
    rows = F.arrays_zip(
        matches.alias("m"), F.slice(ends, F.lit(1), count).alias("e"), F.slice(gaps, F.lit(1), count).alias("b"), F.slice(gaps, F.lit(2), count).alias("a"))
    placed = F.transform(rows, lambda p: F.when(
        keep(p["m"]), make(p["e"] - F.length(p["m"]), p["e"], p["m"], p["b"], p["a"])))
    return F.when(F.size(matches) > 0, F.filter(placed, lambda s: s.isNotNull()))


def _span_struct(kind_no: int):
    return lambda start, end, match, before, after: F.struct(
        start.cast("long").alias("start"), F.lit(kind_no).alias("kind"), end.cast("long").alias("end"))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Keeps doc_id and the content key; adds ``base`` (sorted spans) and ``candidates`` (strings with context and kind)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    for kind in KINDS:
        df = _split(df, kind, _PATTERNS[kind], _may_hold(kind, F.col("text")))
    df = _split(df, "candidate", _CANDIDATE, F.col("text").rlike("[0-9@]"))
    none = F.array().cast(_SPAN)
    found = {
        kind: F.coalesce(_spans(kind, lambda m, kind=kind: _valid(kind, m), _span_struct(no)), none) for no, kind in enumerate(KINDS)}

    def context(start: Column, end: Column, match: Column, gap_before: Column, gap_after: Column) -> Column:
        # Contexts are taken from the gaps next to the string; the last characters of a gap are enough for two words.
        before = F.lower(F.regexp_extract(F.right(gap_before, F.lit(80)), r"(\S+\s+)?(\S+)\s*$", 0))
        after = F.lower(F.regexp_extract(F.left(gap_after, F.lit(80)), r"^\s*(\S+)", 1))
        words = F.regexp_replace(F.trim(before), r"\s+", " ")
        kind = F.coalesce(*[
            F.when(F.exists(F.regexp_extract_all(match, F.lit(_PATTERNS[k]), 0), partial(_valid, k)), no) for no, k in enumerate(KINDS)])
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lower(match).alias("instance"), kind.alias("kind"),
                        words.alias("before"), F.concat_ws(" _ ", F.substring_index(words, " ", -1), after).alias("around"))

    identifier = lambda m: m.contains("@") | (F.length(F.regexp_replace(m, "[^0-9]", "")) >= MIN_IDENTIFIER_DIGITS)
    df = df.select("doc_id", "text_key", *[found[k].alias(k) for k in KINDS], _spans("candidate", identifier, context).alias("candidates"))
    return df.select("doc_id", "text_key", F.array_sort(F.concat(*KINDS)).alias("base"), "candidates")


def _occurrences(spans: DataFrame) -> DataFrame:
    """One row per identifier-like string and distinct text: text_key, start, end, instance, pattern (two each), kind or null."""
    one = spans.where(F.size("candidates") > 0).select("text_key", F.explode("candidates").alias("c"))
    one = one.select(
        "text_key", "c.start", "c.end", "c.instance", "c.kind",
        # Only full contexts tell anything: two words before, or one on each side.
        F.array_compact(F.array(
            F.when(F.col("c.before").contains(" "), F.concat(F.lit("b:"), F.col("c.before"))),
            F.when(~F.col("c.around").startswith(" _") & ~F.col("c.around").endswith("_ "), F.concat(F.lit("a:"), F.col("c.around"))),
        )).alias("patterns"))
    return one.select("text_key", "start", "end", "instance", "kind", F.explode("patterns").alias("pattern")).distinct()


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Score patterns and instances in turn. Returns trusted patterns (pattern, kind, score) and instances (instance, kind)."""
    edges = written_once(occurrences.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    believed = written_once(edges.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind")).distinct())
    trusted = None
    for _ in range(rounds):
        support = edges.join(believed, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        trusted = written_once(
            support.join(sizes, "pattern").select("pattern", "kind", "n", (F.col("n") / F.col("size")).alias("score"))
            .where((F.col("n") >= MIN_SEEDS) & (F.col("score") >= TRUST)))
        # An instance is believed if the patterns around it leave little doubt together.
        doubt = F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))
        vouched = (
            edges.where("seed IS NULL").join(trusted, "pattern").groupBy("instance", "kind").agg(doubt.alias("doubt"))
            .where(F.col("doubt") <= 1 - TRUST).groupBy("instance").agg(F.min_by("kind", F.struct("doubt", "kind")).alias("kind")))
        believed = written_once(believed.union(vouched).distinct())
    seeds = edges.where("seed IS NOT NULL").select("instance").distinct()
    return trusted.select("pattern", "kind", "score"), believed.join(seeds, "instance", "left_anti")


def detect(documents: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_key, base, added): arrays of spans (start, kind, end), code points, end exclusive."""
    spans = written_once(base_spans(documents, text_col))
    occurrences = written_once(_occurrences(spans))
    trusted, discovered = bootstrap(occurrences, rounds)
    # Written before rows are joined to it, so that the rows of a text with very many copies can be split over tasks.
    added = written_once(
        occurrences.where("kind IS NULL").join(trusted.select("pattern", "kind"), ["pattern"]).drop(occurrences["kind"])
        .join(discovered, ["instance", "kind"]).select("text_key", F.struct("start", "kind", "end").alias("span")).distinct()
        .groupBy("text_key").agg(F.array_sort(F.collect_list("span")).alias("added")))
    free = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    return spans.select("doc_id", "text_key", "base").join(added, "text_key", "left").select(
        "doc_id", "text_key", "base", F.coalesce(free, F.array().cast(_SPAN)).alias("added"))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(detected: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans per document."""
    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")

    return detected.select(
        "doc_id", *[count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(documents: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Replace personal data by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; other columns stay, the length follows.

    Discovered spans go first, by position; then each kind in its order, by splitting once more, so that the work
    stays linear. Where kinds overlap, the earlier kind wins. A null text stays null.
    """
    found = detect(documents, text_col).where(F.size("added") > 0).select("text_key", "added").dropDuplicates(["text_key"])
    found = found.select(F.col("text_key").alias("_key"), F.col("added").alias("_added"))
    columns = documents.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), text.alias("text"), F.unhex(F.md5(text)).alias("_own"))
    df = df.join(found, df["_own"] == found["_key"], "left")

    def label(no: Column) -> Column:
        return F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), no)), F.lit("]"))

    pieces = F.transform("_added", lambda s, i: F.concat(
        F.substr("text", F.coalesce(F.get(F.col("_added"), i - 1)["end"], F.lit(0)).cast("int") + 1,
                 (s["start"] - F.coalesce(F.get(F.col("_added"), i - 1)["end"], F.lit(0))).cast("int")), label(s["kind"])))
    rest = F.substr("text", F.element_at("_added", -1)["end"].cast("int") + 1, F.length("text"))
    df = df.withColumn("text", F.when(F.col("_added").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))
    for kind in KINDS:
        df = _split(df, kind, _PATTERNS[kind], _may_hold(kind, F.col("text")))
        joined = F.array_join(F.zip_with(f"{kind}_g", f"{kind}_m", lambda g, m: F.concat(
            g, F.when(m.isNull(), "").when(_valid(kind, m), f"[{kind.upper()}]").otherwise(m))), "")
        df = df.withColumn("text", F.when(F.size(f"{kind}_m") > 0, joined).otherwise(F.col("text")))
    new = F.when(F.col("_row")[text_col].isNotNull(), F.col("text"))
    changed = {text_col: new} | ({length_col: F.length(new).cast(documents.schema[length_col].dataType)} if length_col in columns else {})
    return df.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in columns])
