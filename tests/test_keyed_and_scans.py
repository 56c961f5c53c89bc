import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.operators import keyed as K
from folioforge.operators import scans as S


def test_upsert_last_wins_and_counts(spark):
    target = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, p string, v int")
    source = spark.createDataFrame([("a", None, 5, 1), ("a", None, 6, 2), ("c", None, 7, 1)], "k string, p string, v int, n int")
    out = K.upsert(target, source, ["k", "p"], [F.col("n").desc()])
    assert sorted((r.k, r.v) for r in out.collect()) == [("a", 6), ("b", 2), ("c", 7)]
    assert tuple(K.upsert_counts(target, source, ["k", "p"]).first()) == (1, 1)
    left = K.delete_keys(target, spark.createDataFrame([("a", None)], "k string, p string"), ["k", "p"])
    assert [r.k for r in left.collect()] == ["b"]


def test_full_outer_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    rows = {(r.k, r.a, r.b) for r in K.null_safe_join(a, b, ["k"], "full_outer").collect()}
    assert rows == {(None, 1, 3), ("x", 2, None), ("y", None, 4)}


def test_segment_scan_matches_brute_force_with_bounded_segments(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2000):
        key = "hot" if rng.random() < 0.8 else rng.choice("abc")
        # Sparse numbers, so that only a rank can make segments of equal size.
        rows.append((key, rng.randrange(1 << 62), rng.randrange(-9, 10), rng.choice([None, None, None, "u", "v", "w"]), rng.choice([None, None, [1, 2], [3]])))
    df = spark.createDataFrame(rows, "k string, pos long, v int, s string, a array<int>").repartition(5)
    placed = S.in_segments(df, ["k", "pos"], rows=30)
    sizes = placed.groupBy("part", "seg").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 30 and sizes[1] >= 2000 / 30
    got = S.segment_scan(placed, ["k"], "pos", last={"state": F.col("s"), "both": F.struct("pos", "a"), "array": F.col("a")}, sums={"total": F.col("v"), "n": F.lit(1)})
    got = got.orderBy("k", "pos").toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "pos", "v", "s", "a"]).sort_values(["k", "pos"])
    groups = pdf.groupby("k")
    assert got["total"].astype(int).tolist() == groups["v"].cumsum().tolist() and got["n"].tolist() == (groups.cumcount() + 1).tolist()
    assert got["state"].fillna("-").tolist() == groups["s"].ffill().fillna("-").tolist()
    assert [list(a) if a is not None else None for a in got["array"]] == [a if isinstance(a, list) else None for a in groups["a"].ffill()]
    assert [b["pos"] for b in got["both"]] == pdf["pos"].tolist()
    # One segment for everything gives the same.
    whole = S.segment_scan(S.in_segments(df, ["k", "pos"], rows=10**6), ["k"], "pos", sums={"total": F.col("v")}).orderBy("k", "pos").toPandas()
    assert whole["total"].tolist() == got["total"].tolist()


@pytest.mark.parametrize("span", [2, 9, 26])
def test_exponential_average_matches_recursion(spark, span):
    rng = random.Random(5)
    values = [100.0]
    for _ in range(2300):
        values.append(values[-1] * (1 + rng.gauss(0, 0.02)))
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "k string, rn int, v double")
    got = S.exponential_average(df, "k", "rn", "v", span, "e", "rn").orderBy("rn").toPandas()["e"]
    want = pd.Series(values).ewm(span=span, adjust=False).mean()
    assert ((got - want).abs() / want).max() < 1e-12


@pytest.mark.parametrize("span", [2, 9, 26])
def test_exponential_average_remembers_a_far_higher_level(spark, span):
    """An early level 1e30 and 1e250 times the later one, over many blocks."""
    for early in (1e30, 1e250):
        values, rng = [early], random.Random(6)
        values += [rng.uniform(0.5, 1.5) for _ in range(6000)]
        alpha, want = 2 / (span + 1), [values[0]]
        for v in values[1:]:
            want.append(alpha * v + (1 - alpha) * want[-1])
        df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "k string, rn int, v double").repartition(3)
        got = S.exponential_average(df, "k", "rn", "v", span, "e", "rn").orderBy("rn").toPandas()["e"]
        assert ((got - pd.Series(want)).abs() / pd.Series(want)).max() < 1e-10


def test_ranks_of_many_rows_without_score(spark):
    rows = [("p", f"{i * 7919 % 1000:03d}é"[:i % 4 + 1] + f"-{i}", None if i % 3 else i / 10) for i in range(900)]
    got = {r.n: r.rank for r in S.rank_by_score(spark.createDataFrame(rows, "g string, n string, s double"), "s", "n", groups=["g"]).collect()}
    scored = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[1]))
    rest = sorted((r[1] for r in rows if r[2] is None), key=lambda n: n.encode())
    assert [got[n] for _, n, _ in scored] == list(range(1, 301)) and [got[n] for n in rest] == list(range(301, 901))


def test_rank_and_share(spark):
    rows = [("p", n, s) for n, s in (("a", 50.0), ("b", 70.5), ("c", 50.0), ("d", None), ("e", None))]
    ranked = S.rank_by_score(spark.createDataFrame(rows, "g string, n string, s double"), "s", "n", groups=["g"])
    assert {r.n: r.rank for r in ranked.collect()} == {"b": 1, "a": 2, "c": 3, "d": 4, "e": 5}
    shared = S.share_of_total(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "n string, v double"), "v", "pct")
    assert {r.n: r.pct for r in shared.collect()} == {"a": 25.0, "b": 75.0}
