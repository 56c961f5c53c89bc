"""Fill-in-middle, pairwise ranking and periodic runs against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import fim, periods, queries, ranker

WORD = re.compile("[^\x20\x09-\x0d]+")
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    # Extra columns whose names the operators use themselves.
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"h": F.lit(1), "w": F.lit("x"), "n": F.lit(2), "form": F.lit("f"), "a": F.lit(0), "good": F.lit(True), "runs": F.lit("r"), "worth": F.lit(1.0)})


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "no id here"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "\x1c\x85 a\xa0b 漢字 😀 é"), (6, "x <P> y"), (7, "a <"), (8, "P> <S >"),
       (9, "tail  "), (10, "  head"), (11, "same words"), (11, "same words"), (12, "$1 \\ {2} (3)"), (13, "z " * 300_000)]


# fill-in-middle ------------------------------------------------------------------------------------------

def fim_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_by_hand(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "😀", " ", "  ", "\n", "\t", "<", ">", "P", "S", "M", "<P", "M>", "\x1c", "$2", "\\"]
    rows = ODD + [(100 + k, "".join(rng.choices(alphabet, k=rng.randrange(30)))) for k in range(400)] + [(k, prose(rng, 200)) for k in range(600, 700)]
    made = fim.examples(frame(spark, rows))
    got = sorted(map(tuple, made.collect()), key=repr)
    want = sorted((fim_by_hand(d, t) for d, t in rows), key=repr)
    assert got == want
    assert {"plain", "spm", "psm"} == {r[2] for r in got}
    assert any(r[3] == 0 for r in got) and any(r[4] == 0 for r in got)
    back = fim.digests(made).select("doc_id", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, sha(fim_by_hand(d, t)[5]), sha(t or "")) for d, t in rows), key=repr)
    assert fim.digests(fim.examples(frame(spark, rows).limit(0))).count() == 0


def test_fill_in_middle_settings(spark):
    rows = [(k, f"first{k} second third  fourth") for k in range(50)]
    own = fim.Settings("<pre>", "<suf>", "<mid>", percent=100, spm_percent=0, seed=7)
    made = fim.examples(frame(spark, rows), own).withColumn("back", fim.restored(F.col("output"), F.col("form"), own)).collect()
    assert {r.form for r in made} == {"psm"} and {r.doc_id: r.back for r in made} == dict(rows)
    assert all(r.output.startswith("<pre>") and r.output.index("<suf>") == 5 + r.prefix_chars for r in made)
    for bad in ("P", "<a b>", "<S>"):
        with pytest.raises(ValueError, match="sentinels"):
            fim.Settings(prefix=bad)


# pairwise ranking ----------------------------------------------------------------------------------------

def ranked_corpus(rng):
    rows, labels = [], []
    for k in range(900):
        text = prose(rng, rng.randrange(30, 300))
        bad = k % 6 == 0
        if bad:
            text = (" ".join(w + rng.choice(["%%%", "&&&"]) for w in text.split()), " | ".join(text.split()), f"{text.split()[0]} " * 80)[k // 6 % 3]
        rows.append((k, text))
        if k % 3 == 0:
            labels.append((k, int(not bad)))
    return rows, labels


def test_pairwise_ranking_on_held_out_rows(spark):
    rows, labels = ranked_corpus(random.Random(4))
    table = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0))
    odd = [(None, "word " * 9), (None, None), (2000, None), (2001, ""), (2002, prose(random.Random(5), 200_000)), (1, dict(rows)[1])]
    out = ranker.rank(frame(spark, rows + odd), table)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.doc_id % 6 != 0, r) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 150 and sum(r.predicted == good for good, r in held) >= 0.98 * len(held)
    good, bad = ([r.score for g, r in held if g == side] for side in (True, False))
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    same = [r.score for r in got if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1] and next(r for r in got if r.doc_id == 2002).predicted == 1
    again = {(r.doc_id, r.score) for r in ranker.rank(frame(spark, rows + odd).repartition(7), table).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_held_out_labels_change_nothing(spark):
    rows, labels = ranked_corpus(random.Random(6))
    held = {d for d, _ in labels if zlib.crc32(str(d).encode()) % 4 == 2}
    schema = "doc_id long, quality int"
    want = ranker.rank(frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] not in held], schema)).collect()
    turned = spark.createDataFrame([(d, 1 - q if d in held else q) for d, q in labels] + [(None, 1), (5, None)], schema)
    assert sorted(ranker.rank(frame(spark, rows), turned).collect()) == sorted(want)


def test_ranking_without_labels_of_both_kinds(spark):
    rows = [(1, "a b c"), (2, None)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in ranker.rank(frame(spark, rows), none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    assert {r.predicted for r in ranker.rank(frame(spark, rows), one).collect()} == {1}
    assert ranker.rank(frame(spark, rows).limit(0), one).count() == 0


def test_pairs_and_border_by_brute_force():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (40, 3)), rng.normal(-0.5, 1, (10, 3))
    weights = ranker.fit_pairs(good, bad, pairs_per_row=10)  # ten times forty pairs: every good row meets every bad row about once

    def loss(w):
        return np.log1p(np.exp(-((good[:, None] - bad[None]) @ w))).sum()
    assert loss(weights) < loss(np.zeros(3)) and loss(weights) < 1.05 * min(loss(weights + d) for d in rng.normal(0, 0.3, (50, 3)))
    worths, is_good = np.concatenate([good @ weights, bad @ weights]), np.repeat([True, False], [40, 10])
    levels = np.quantile(worths, np.linspace(0, 1, 101))
    right = [((worths >= v) == is_good).sum() for v in levels]
    assert ((worths >= ranker.best_border(levels, worths, is_good)) == is_good).sum() == max(right)


def test_features_are_plain_figures():
    compressor = zstandard.ZstdCompressor(level=1)
    assert ranker.features(b"", compressor) == ranker.features(b" \n", compressor) == (0.0,) * len(ranker.FEATURES)
    got = dict(zip(ranker.FEATURES, ranker.features(b"AB ab ab ab!\nAB ab ab ab!", compressor), strict=True))
    share = np.log1p
    assert got["capitals"] == pytest.approx(share(100 * 4 / 16)) and got["stutters"] == pytest.approx(share(100 * 2 / 8))
    assert got["dup_lines"] == pytest.approx(share(50)) and got["exclamations"] == pytest.approx(share(25)) and got["symbols"] == 0


# periodic runs -------------------------------------------------------------------------------------------

def runs_by_hand(words, least=12):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q) and not any(
                    all(words[t] == words[t + d] for t in range(start, start + length - d)) for d in range(1, q)):
                found.add((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kind, n = rng.randrange(5), rng.randrange(200)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    while len(out) < n:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 6 if kind == 2 else 20))]
        out += (root * 30)[:rng.randrange(1, 70)] if kind < 4 else [0] * rng.randrange(1, 60) + [1]
    return out


def test_runs_by_brute_force():
    rng, total = random.Random(8), 0
    for _ in range(600):
        words = [b"%d" % v for v in repetitive(rng)]
        got = periods.runs(words)
        assert got == runs_by_hand(words), words
        total += len(got)
    assert total > 2000
    # Two touching runs of period 5 whose seeds are all highly periodic; the whole has period 12.
    words = list("deabcdeabcdeababcdeabcdeabcde")
    assert periods.runs(words) == runs_by_hand(words) and any(r[2] == 12 for r in periods.runs(words))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(4, 13))
def test_runs_of_other_lengths(values, least):
    words = [b"%d" % v for v in values]
    assert periods.runs(words, least) == runs_by_hand(words, least)


def test_long_repetitive_texts_take_linear_work():
    a, b = [b"a"] * 100_000, [b"b"]
    assert periods.runs(a + a) == [(0, 200_000, 1)]
    assert periods.runs(a + b + a) == [(0, 100_000, 1), (100_001, 100_000, 1)]
    part = [b"%d" % v for v in np.random.default_rng(2).integers(0, 5000, 20_000)]
    assert periods.runs(part * 5) == [(0, 100_000, 20_000)]


def digest_by_hand(doc_id, text, plant):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_run_digests_by_hand(spark, tmp_path):
    rng = random.Random(9)
    rows = ODD[:-1] + [(14, "é " * 13), (15, "a b " * 6), (16, "a b " * 5), (17, f"{'a b ' * 20} {'c d e ' * 20} x"), (18, f"{'c ' * 30} y {'d ' * 30}")]
    rows += [(k, prose(rng, rng.randrange(1, 120))) for k in range(100, 300)] + [(k, prose(rng, rng.randrange(1, 60), 2)) for k in range(300, 330)]
    got = sorted(map(tuple, periods.digests(periods.detect(frame(spark, rows))).collect()), key=repr)
    assert got == sorted((digest_by_hand(d, t, False) for d, t in rows), key=repr)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_seeded_runs(spark, str(tmp_path))
    want = sorted((digest_by_hand(d, t, True) for d, t in rows), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] > 0 for r in want if r[0] is not None and r[0] >= 100) > 10
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(out.dtypes)["exponent_milli"] == "bigint"
    assert periods.digests(periods.detect(frame(spark, rows).limit(0))).count() == 0


def test_a_very_long_text_in_spark(spark):
    row = periods.digests(periods.detect(frame(spark, [(1, "z " * 300_000)]))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 300_000, 1, 300_000_000) and row.collapsed_sha256 == sha("z")
