"""The pipeline against a step-by-step account of its decisions, and the queries' contract."""

import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from folioforge.llm import packing, registry, similar, simhash, tokens
from folioforge.operators.lineage import written_once

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def corpus():
    rng = random.Random(11)
    item = prose(rng, 25)
    clean = [prose(rng, 120) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(20, clean[0]), (20, clean[0]), (21, clean[1].upper()), (30, "too short"), (31, None), (32, ""), (33, "again and " * 100),
             (40, f"{prose(rng, 60)} {item} {prose(rng, 60)}"), (50, f"{prose(rng, 80)} write to me.you@mail.example.com today, {prose(rng, 20)}"),
             (60, prose(rng, 9000)), (None, prose(rng, 90))]
    return item, rows


def test_stages_and_packing(spark, tmp_path):
    item, rows = corpus()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {d: t for d, t in reversed(rows)}
    gone = [{30, 31, 32, 33}, {20, 21}, {40}, set()]
    for (_, stage), lost in zip(corpus_pipeline.STAGES[:4], gone, strict=True):
        docs = written_once(stage(spark, docs, str(tmp_path)))
        for d in lost:
            kept.pop(d)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} == set(kept)
    assert docs.count() == len(kept)
    kept[50] = kept[50].replace("me.you@mail.example.com", "[EMAIL]")
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t)) for d, t in kept.items()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, want = Tokenizer.from_file(tokens.WORD_BPE), set()
    for d, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want |= {(d, k, a, zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_near_duplicates_by_fingerprint_and_by_similarity(spark):
    """Texts within three bits go by op7's fingerprints even below similarity 0.8; similar texts further apart go as well."""
    rng = random.Random(5)
    close = far = None
    while close is None or far is None:
        words = prose(rng, 30).split()
        other = list(words)
        for at in rng.sample(range(30), 2):
            other[at] = f"x{rng.randrange(4000)}"
        # A long repeat holds most shingles, so the fingerprint hardly moves while the set of shingles changes.
        a, b = " ".join(words + ["so it goes on and"] * 200), " ".join(other + ["so it goes on and"] * 200)
        close = close or (a, b)
        long = prose(rng, 120).split()
        changed = [*long[:60], "changed", *long[61:]]
        bits = bin(simhash.fingerprint(" ".join(long).encode()) ^ simhash.fingerprint(" ".join(changed).encode())).count("1")
        far = far or ((" ".join(long), " ".join(changed)) if bits > simhash.MAX_DISTANCE else None)
    of = lambda t: set(similar.shingles(t.encode().split()).tolist())
    likeness = [len(of(a) & of(b)) / len(of(a) | of(b)) for a, b in (close, far)]
    apart = bin(simhash.fingerprint(close[0].encode()) ^ simhash.fingerprint(close[1].encode())).count("1")
    assert likeness[0] < similar.SIMILARITY <= likeness[1] and apart <= simhash.MAX_DISTANCE
    rows = [(1, close[0]), (2, close[1]), (3, far[0]), (4, far[1]), (5, prose(rng, 80))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5}


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written_once(stage(spark, docs, SF))
        assert docs.count() == 0


def test_registered_queries_and_sql(spark):
    names = set(contract.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = {}
    for name, sql in registry.ORACLE.items():
        want, got = con.execute(sql).df().astype(object), contract.queries()[name](spark, SF).toPandas().astype(object)
        order = sorted(want.columns)
        assert sorted(got.columns) == order
        got, want = (x[order].where(x[order].notna(), None).sort_values(["conv_id" if "conv_id" in order else "doc_id"]) for x in (got, want))
        assert got.values.tolist() == want.values.tolist()
        found[name] = got
    assert (found["op1_prefix_targets"].conv_id == -7).sum() == 1 and len(found) == 2


def test_main_paths_of_native_operators_run_no_python(spark):
    for name in ("op1_prefix_targets", "op4_contextual_pii", "op5_spaced_seeds"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_entry_points_keep_their_columns(spark):
    fixed = {
        "op2_pattern_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op8_token_planes": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op9_content_archive": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op12_pairwise_ranking": {"doc_id", "held_out", "score", "predicted"},
        "op10_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    }
    for name, columns in fixed.items():
        out = contract.queries()[name](spark, SF)
        assert columns <= set(out.columns) and out.where(F.lit(True)).count() > 0


def test_pipeline_returns_training_sequences(spark, tmp_path):
    item, rows = corpus()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    out = written_once(corpus_pipeline.run(spark, str(tmp_path)))
    sequences = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    pieces = out.collect()
    assert {r.sequence_id for r in pieces} == set(sequences) and sum(r.length for r in pieces) == sum(map(len, sequences.values()))
    for r in pieces:
        assert zlib.crc32(np.array(sequences[r.sequence_id][r.offset:r.offset + r.length], "<u4").tobytes()) == r.ids_crc32
    text = next(t for d, t in rows if d == 50).replace("me.you@mail.example.com", "[EMAIL]")
    want = [*Tokenizer.from_file(tokens.WORD_BPE).encode(text, add_special_tokens=False).ids, 1]
    assert [list(r.ids) for r in pieces if r.doc_id == 50] == [want]
