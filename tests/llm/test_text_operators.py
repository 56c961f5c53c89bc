"""Quality rules, SimHash, decontamination, personal data, substring dedup and toxicity against brute force."""

import hashlib
import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import components, decontaminate, pii, quality, rlz, similar, simhash, toxicity
from folioforge.operators.lineage import written_once

WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"block": F.lit(1), "cell": F.lit("c"), "base": F.lit(2), "kept": F.lit(False), "n_chars": F.length("text").cast("long")})


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# quality -------------------------------------------------------------------------------------------------

def quality_by_hand(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(spark):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 1000)) + " " * (rng.random() < 0.1) for _ in range(40_000))
    rows = [(1, prose(rng, 300)), (1, prose(rng, 300)), (2, None), (3, ""), (4, "a b c a b c d"), (None, "x\n\nx\nx \x0b\x1c\x85y\xa0z #<é>"),
            (5, prose(rng, 40, 3)), (6, "the cat sat on the mat " * 50), (7, noise), (8, prose(rng, 60_000)), (9, "abab" * 20_000 + prose(rng, 60))]
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t or "")
    got = quality.assess(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in [quality_by_hand(t) for t in texts[r.doc_id]]
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[8] and not kept[9] and not kept[7] and not kept[2]
    accepted = quality.accepted(frame(spark, rows))
    assert accepted.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in accepted.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.assess(frame(spark, rows).limit(0)).count() == 0


def test_quality_limits_come_from_the_corpus(spark):
    rng = random.Random(12)
    letters = "eeeeeetttttaaaaoooiiinnnsssrrrhhllddcummfpgwybvk"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(20_000)]
    weights = [1 / (k + 3) for k in range(20_000)]

    def sentences(n):
        words = rng.choices(vocabulary, weights, k=n)
        return " ".join(w.capitalize() if k % 12 == 0 else w + "." * (k % 12 == 11) for k, w in enumerate(words))
    lengths = (600, 1200, 2400)
    clean = [sentences(rng.randint(300, 3500)) for _ in range(500)]
    junk = [text for n in lengths for text in (
        " ".join(w + rng.choice(["%%%", "&&&", "$$$", "###"]) for w in sentences(n).split(" ")),
        " ".join(f"http://www.{rng.choice(vocabulary)}.example.com/{rng.choice(vocabulary)}.html" for _ in range(n)),
        " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(n)))]
    rows = [*enumerate(clean), *((1000 + k, t) for k, t in enumerate(junk))]
    # Copies and near copies of one text are no reason to reject the others.
    rows += [(2000 + k, clean[0]) for k in range(400)] + [(3000 + k, f"{clean[1]} {vocabulary[k]}") for k in range(60)]
    got = {r.doc_id: r for r in quality.assess(frame(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [k for k in range(1000, 1000 + len(junk)) if got[k].kept] == []
    assert sum(not got[k].kept for k in range(len(clean))) <= len(clean) // 50
    assert all(got[k].kept for k in got if k >= 2000)
    assert sorted(r.doc_id for r in quality.accepted(frame(spark, rows)).select("doc_id").collect()) == sorted(k for k in got if got[k].kept)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=14))
def test_repeated_words(words):
    assert quality.repeated_words([w.encode() for w in words]) == quality_by_hand(" ".join(words))[4]


# simhash -------------------------------------------------------------------------------------------------

def components_by_hand(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_roots(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    pairs = [(a, b) for a, b in pairs if a != b]
    want = components_by_hand(pairs, {n for p in pairs for n in p})
    got = components.roots(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("dense", [512, 3])
def test_links_find_every_component(spark, dense):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(20):
            v = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                v ^= 1 << b
            fps.add(v)
    signed = sorted(int(np.uint64(v).astype(np.int64)) for v in fps)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), dense=dense)
    edges = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges)
    assert components_by_hand(edges, signed) == components_by_hand(pairs, signed)


def test_popcount_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    digits = [(simhash.popcounts(x)[:, None] >> (2 * np.arange(32, dtype=np.uint64))) & np.uint64(3) for x in (a, b)]
    manhattan = np.abs(digits[0].astype(int) - digits[1].astype(int)).sum(axis=1)
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def fingerprint_by_hand(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_clusters_and_representatives(spark):
    rng = random.Random(5)
    base = prose(rng, 400)
    near = base.replace(base.split(" ")[200], "other", 1)
    rows = [(7, base), (7, base), (3, base.upper()), (9, near), (4, None), (2, ""), (None, " \n"), (5, "one two"), (6, "ONE\ttwo"), (8, "É x"), (None, "lonely row here"),
            (10, prose(rng, 50_000))]
    got = simhash.clusters(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, fingerprint_by_hand(t or "")) for d, t in rows)
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.component_id)
    assert of[7] == of[3] == of[9] == {3} and of[5] == of[6] == {5} and of[4] == of[2] == {2} and of[None] == {2, None}
    kept = simhash.representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [
        (-1, "lonely row here"), (2, ""), (3, base.upper()), (5, "one two"), (8, "É x"), (10, rows[-1][1])]
    assert simhash.clusters(frame(spark, rows).limit(0)).count() == 0


def joins_of(*frames):
    """The join nodes of the plans, as they are before any stage has run."""
    return {n for df in frames for n in re.findall(r"\w+(?:HashJoin|MergeJoin|LoopJoin)|CartesianProduct", df._jdf.queryExecution().executedPlan().toString())}


def test_fingerprints_and_links_are_not_broadcast(spark):
    """Relations that grow with the input do not pass through the driver, however small their files are."""
    links = written_once(spark.createDataFrame([(k, k // 3) for k in range(1, 60)], "a long, b long"))
    rows = frame(spark, [(k, f"one two three four {k // 2}") for k in range(20)])
    assert joins_of(components._large_star(links), components._small_star(links)) == {"SortMergeJoin"}
    assert joins_of(simhash.clusters(rows), simhash.representatives(rows), simhash.ball_links(spark.range(20).toDF("fp"))) == {"SortMergeJoin"}


def test_similar_texts_are_not_broadcast(spark):
    rows = frame(spark, [(k, f"one two three four five six {k // 2}") for k in range(20)])
    sets = written_once(spark.createDataFrame([(k, [k // 3, k // 3 + 1]) for k in range(30)], "key long, s array<long>"))
    pairs = sets.select(F.col("key").alias("a"), (F.col("key") + 1).alias("b"))
    seen, write = [], similar.written_once
    similar.written_once = lambda df: seen.append(df) or write(df)
    try:
        similar._verified(pairs, sets, 0.8)
        similar.crowded_links(sets, spark.createDataFrame([(1, 0), (0, 0)], "node long, root long"))
    finally:
        similar.written_once = write
    assert joins_of(similar.representatives(rows), *seen) == {"SortMergeJoin"}


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(13)
    rows, k = [(i, prose(rng, 230)) for i in range(40)], 1000
    near = {}
    for i in range(30):
        words = rows[i][1].split(" ")
        for at in range(20, 230, 60):
            words[at] = f"new{i}x{at}"
        rows.append((k + i, " ".join(words)))
        near[k + i] = i
    # Ten replaced words of 230 leave a similarity of about 0.64.
    far = rows[35][1].split(" ")
    for at in range(10, 230, 22):
        far[at] = "other"
    rows += [(2000, " ".join(far)), (2001, rows[36][1].upper()), (2002, None), (2003, " "), (2004, "one two"), (None, "three four")]
    # A dense group in which every text is a copy with one word changed.
    base = prose(rng, 200).split(" ")
    rows += [(3000 + i, " ".join([*base[:i], f"q{i}", *base[i + 1:]])) for i in range(150)]
    want = [-1, *range(40), 2000, 2002, 2004, 3000]
    for dense in (similar.DENSE, 3):
        kept = similar.representatives(frame(spark, rows), dense=dense)
        assert kept.columns == frame(spark, rows).columns
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
    assert similar.representatives(frame(spark, rows).limit(0)).count() == 0


def groups_by_hand(rows):
    """The smallest id of each group of five-word similarity 0.8, from all pairs that share a shingle set of the right size."""
    sets = {}
    for d, text in rows:
        words = text.lower().split()
        sets[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted({top(d) for d in ids}), sum(d != top(d) for d in ids)


def test_crowded_buckets_lose_no_link(spark):
    """Texts that share a passage fill the buckets: 250 pairs of 0.84 among others of 0.7 to 0.79, and chains around a dense group."""
    rng = random.Random(17)
    passage = prose(rng, 100).split(" ")
    rows = []
    for k in range(250):
        tail = prose(rng, 20, 10**6).split(" ")
        rows += [(2 * k, " ".join(passage + tail)), (2 * k + 1, " ".join(passage + tail[:9] + prose(rng, 9, 10**6).split(" ")))]
    rows += [(600 + k, " ".join(passage + prose(rng, rng.randrange(8, 22), 10**6).split(" "))) for k in range(100)]
    base = prose(rng, 200).split(" ")
    for k in range(60):  # each further text moves on by a few words from the one before: neighbours are similar, the ends are not
        rows.append((1000 + k, " ".join(base[k * 2:] + prose(random.Random(18), 2 * k, 10**6).split(" ")[:2 * k])))
    rows += [(2000 + k, " ".join([*base[:k], f"q{k}", *base[k + 1:]])) for k in range(100)]
    want, lost = groups_by_hand(rows)
    assert lost > 300 and len(want) > 200
    for dense in (2, similar.DENSE):
        kept = similar.representatives(spark.createDataFrame(rows, "doc_id long, text string"), dense=dense)
        assert sorted(r.doc_id for r in kept.collect()) == want


def test_crowded_links_by_brute_force(spark):
    """Without any bucket: the exact search alone joins what all pairs join."""
    rng = random.Random(19)
    sets = []
    for k in range(400):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.7 else [rng.randrange(300) for _ in range(rng.randrange(1, 40))]
        sets.append(sorted({v if rng.random() > 0.08 else rng.randrange(300) for v in base} | {rng.randrange(300)}))
    df = spark.createDataFrame(list(enumerate(sets)), "key long, s array<long>")
    joined = spark.createDataFrame([], "node long, root long")
    found = {(r.a, r.b) for r in similar.crowded_links(df, joined).collect()}
    want = set()
    for a in range(400):
        for b in range(a + 1, 400):
            common = len(set(sets[a]) & set(sets[b]))
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert found == want and len(want) > 100
    known = spark.createDataFrame([(b, a) for a, b in sorted(want)[:1]] + [(a, a) for a, b in sorted(want)[:1]], "node long, root long")
    assert {(r.a, r.b) for r in similar.crowded_links(df, known).collect()} == want - {sorted(want)[0]}


# decontamination -----------------------------------------------------------------------------------------

def test_decontamination(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (20, 30, 13, 9, 60)]
    bench = spark.createDataFrame([*enumerate(items), (90, items[0]), (None, items[1]), (91, None), (92, "too short")], "item_id long, text string").withColumn("seed", F.lit(1))
    swapped = items[1].split(" ")
    for k in range(2, 30, 5):
        swapped[k] = "zzz"
    half = items[4].split(" ")
    for k in range(0, 60, 2):
        half[k] = "yyy"
    rows = [(1, f"{prose(rng, 50)} {items[0]} {prose(rng, 50)}"), (2, prose(rng, 200)), (3, f"{prose(rng, 9)}, {' '.join(swapped)}!"), (4, " ".join(half)), (5, None), (6, ""),
            (7, items[2].upper().replace(" ", " - ")), (8, " ".join(items[4].split(" ")[20:34])), (8, items[3]), (None, items[3]), (9, f"{prose(rng, 40_000)} {items[2]}")]
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    found = sorted(((r.doc_id or -1), tuple(r.item_ids)) for r in got)
    assert found == [(-1, (3,)), (1, (0, 90)), (3, (1,)), (7, (2,)), (8, (3,)), (8, (4,)), (9, (2,))]
    assert {r.doc_id: r.start for r in got}[1] == 50 and {r.doc_id: r.start for r in got}[9] == 40_000
    left = decontaminate.clean(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6]
    assert decontaminate.contaminated(frame(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


# personal data -------------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def sound(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return True


def base_by_hand(text):
    found = sorted((m.start(), no, m.end()) for no, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if sound(k, m.group()))
    return ",".join(f"{PATTERNS[no][0]}:{a}:{b}" for a, no, b in found)


def test_base_spans(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "%x@y-z.de", "1.2.3.4", ".", "255.256.1.1", "0255.01.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "é", " ", "\n", "@",
             "7", "12", "+", "-", "(", "word"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 50_000), (1003, "a" * 50_000 + "@"), (1004, "1.2.3.4 a@b.cc " * 2000), (None, "x@y.z"), (0, "x@y.z"), (0, "x@y.z")]
    got = pii.digests(pii.detect(frame(spark, rows))).collect()
    want = Counter((d, hashlib.sha256(base_by_hand(t or "").encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        if not r.n_added and r.doc_id is not None and 0 < r.doc_id < 1000:
            assert r.spans == base_by_hand(dict(rows)[r.doc_id])
    assert pii.detect(frame(spark, rows).limit(0)).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(k, f"Dear all, please phone us on +1 (974) 555-{3000 + k} before noon. Ref {k}") for k in range(12)]
    rows += [(100, "Hello, phone us on 0305551234 before you come"), (101, "He sold 030555123499 before lunch"), (102, None)]
    got = {r.doc_id: r for r in pii.digests(pii.detect(frame(spark, rows))).collect()}
    at = rows[12][1].index("0305551234")
    assert got[100].spans == f"phone:{at}:{at + 10}" and got[100].n_phone == 0 and got[101].spans == "" and got[0].n_added == 0
    hidden = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert hidden[100].text == "Hello, phone us on [PHONE] before you come" and hidden[100].n_chars == len(hidden[100].text)
    assert hidden[0].text == "Dear all, please phone us on [PHONE] before noon. Ref 0" and hidden[101].text == rows[13][1] and hidden[102].text is None
    assert pii.redact(frame(spark, rows)).columns == frame(spark, rows).columns


# substring dedup -----------------------------------------------------------------------------------------

def removed_by_hand(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def test_substrings(spark):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (34, 35, 36, 80, 200)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "For " * 300), (5, "For " * 40 + "end"), (None, prose(rng, 100)), (6, prose(rng, 30_000))]
    for k in range(60):
        pieces = [prose(rng, rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(passages).split(" ")
            cut = rng.randrange(len(passage) // 2)
            pieces += [" ".join(passage[cut:]), prose(rng, rng.randrange(20))]
        rows.append((10 + k, rng.choice([" ", "\n", " \t"]).join(pieces)))
    rows += [(10, rows[20][1]), (11, rows[20][1]), (11, rows[20][1])]
    got = rlz.deduplicated(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == removed_by_hand(rows, 35)
    assert all(sum(r.spans[1::2]) == r.n_removed for r in got)
    assert rlz.deduplicated(frame(spark, rows).limit(0)).count() == 0


# toxicity ------------------------------------------------------------------------------------------------

def test_folding():
    assert toxicity.folded_words("ＩＤ1ОT, Pаthétic $tupid 1000 l0ser!") == ["idiot", "pathetic", "stupid", "1000", "loser"]


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["grumblefoot", "snarkwit", "dolthead"]

    def toxic_text():
        words = prose(rng, 80, 300).split(" ")
        for _ in range(4):
            words[rng.randrange(80)] = rng.choice(bad) + rng.choice(["", "s", "!"])
        return " ".join(words)

    rows = [(k, toxic_text() if k % 4 == 0 else prose(rng, 80, 300)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(500)] + [(3, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, "sn4rkwit"), (902, "a snаrkwit and a d0lthead"), (903, prose(rng, 40_000, 300)), (1, rows[1][1])])
    lexicon = toxicity.learn(docs, labels)
    assert {f" {w[:k]}" for w in bad for k in range(3, 9)} & set(lexicon.weights)
    got = toxicity.scores(docs, lexicon).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 606 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(by_id[k].predicted == (k % 4 == 0) for k in range(600)) >= 590
    assert by_id[902].predicted == 1 and by_id[903].predicted == 0 and by_id[900].predicted == 0 and by_id[900].score == by_id[901].score
    empty = toxicity.learn(docs, labels.limit(0))
    assert not empty.weights and len({r.score for r in toxicity.scores(docs, empty).collect()}) == 1
    assert toxicity.scores(docs.limit(0), lexicon).count() == 0


def test_exception_phrases():
    lexicon = toxicity.Lexicon(weights={" clown ": 5.0}, exceptions=("class clown",))
    matcher = lexicon.matcher()
    assert lexicon.density(["the", "class", "clown"], matcher) == 0 < lexicon.density(["the", "clown"], matcher)
