"""Connected components of a link table by alternating star contractions.

Each round points the larger neighbours of every node at the smallest one it sees, then does the same downwards, until
nothing changes; the links then form one star per component. Rounds are written to the shared folder, so a lost
executor costs a re-read. Only two figures per round reach the driver: links are joined by exchanges, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.keyed import dealt_out
from folioforge.operators.lineage import fresh_path, remove, written_once, written_to


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b"), F.col("a"))).toDF("a", "b")
    # Written first, so that the links of one node with very many can be split over tasks in the join.
    least = written_once(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")))
    return both.where(F.col("b") > F.col("a")).join(dealt_out(least), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(dealt_out(least), "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).union(moved).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component, itself included."""
    spark = links.sparkSession
    path = fresh_path(spark, "links")
    current = written_to(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    before = _state(current)
    while True:
        new_path = fresh_path(spark, "links")
        current = written_to(_small_star(_large_star(current)), new_path)
        remove(spark, path)
        path, after = new_path, _state(current)
        if after == before:
            break
        before = after
    children = current.toDF("node", "root")
    return children.union(children.select("root", "root").distinct())
