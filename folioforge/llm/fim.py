"""Fill-in-middle examples cut by one counted-quantifier match per text.

``regexp_count`` gives the number n of units (a word with the white space before it, or white space at the end). Two cut
points are drawn from a hash of the document id, and a pattern made for the row, ``(unit{a})(unit{b-a})(rest)`` with
possessive quantifiers, matches the whole text once: its groups are prefix, middle and suffix, and the replacement
string puts them in the order of the form. Possessive counts keep the matcher iterative, so long texts need no stack.

A text that is empty or holds a sentinel stays as it is, so every output can be taken apart again (:func:`restored`).

Cases: a null text is empty; a null doc_id is drawn from the seed alone; repeated rows are cut alike; with n units both cuts
may fall together or at an end, and parts may be empty; very long texts are matched whole; an empty table gives no rows; extra
columns are ignored. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts

# A unit is white space and a word, or white space that no word follows.
_SPACE = r"\x20\x09-\x0D"
UNIT = f"(?:[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++)"


@dataclass(frozen=True)
class Settings:
    """Sentinels of prefix, suffix and middle; percent of texts transformed, and of these in suffix-first order."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 50
    spm_percent: int = 80
    seed: int = 42

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(len(m) > 2 and m[0] == "<" and m.endswith(">") and m[1:-1].isalnum() for m in marks) or len(set(marks)) < 3:
            raise ValueError("sentinels are three different words in angle brackets")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def examples(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; form is plain, psm or spm."""
    p, s, m = settings.prefix, settings.suffix, settings.middle
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in (p, s, m):
        marked = marked | text.contains(mark)
    drawn = texts(documents).select("doc_id", text.alias("text"), F.array(*draws(F.col("doc_id"), settings.seed)).alias("h"))
    form = (F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= settings.percent), "plain")
            .when(F.col("h")[3] % 100 < settings.spm_percent, "spm").otherwise("psm"))
    counted = drawn.select("doc_id", "text", "h", form.alias("form"), F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"))
    first, second = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    cut = counted.select("doc_id", "text", "form", "n", F.least(first, second).alias("a"), F.abs(first - second).alias("size"))
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), "a", F.lit(rf"}}+)({UNIT}{{"), "size", F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    made = cut.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.regexp_replace("text", pattern, order)).alias("output"))
    # Lengths are read off the output: no part holds a sentinel, and none can arise where two parts meet.
    at = {mark: F.locate(mark, F.col("output")) for mark in (p, s, m)}
    prefix = F.when(F.col("form") == "psm", at[s] - 1 - len(p)).when(F.col("form") == "spm", at[m] - at[p] - len(p))
    middle = F.when(F.col("form") != "plain", F.length("output") - at[m] + 1 - len(m))
    return made.select("doc_id", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output of that form was made of."""
    p, s, m = settings.prefix, settings.suffix, settings.middle
    return F.when(form == "psm", F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")).when(
        form == "spm", F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")).otherwise(output)


def digests(made: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The figures of :func:`examples` with the hashes of the output and of the text rebuilt from it."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), settings), 256).alias("restored_sha256"))
