"""Chat formatting, token files, packing and the archive: round trips, brute force and odd inputs."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm import chat, packing, tokenfile, tokens, warc
from folioforge.operators.lineage import fresh_path

ODD_TEXTS = [
    (5, "Some plain words, twice.\nSome plain words, twice."), (5, "Some plain words, twice.\nSome plain words, twice."), (None, "no id"), (7, None), (8, ""),
    (9, "É́\u0085x ß İ ²½ don't <|endoftext|> 漢字 \x1c end"), (10, "long " * 9000), (2, "a\tb  c\r\nd"),
]


def ids_of(text):
    return Tokenizer.from_file(tokens.WORD_BPE).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names the operators use themselves.
    return spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").withColumns({"part": F.lit("x"), "fp": F.lit(1), "row": F.lit("r")})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sSTéÉßİ² \t\n\u0301\u0085Ως.,!9_<|endoftext|>漢", max_size=30))
def test_words_give_the_ids_of_the_text(text):
    assert np.frombuffer(tokens.encoder(tokens.WORD_BPE).encode([text])[0], "<u4").tolist() == ids_of(text)


# Batches that mix plain and odd words, letter case, empty words, long runs, and special tokens in their own and in other case.
MIXED_TEXTS = [
    "The the THE tHe", "", "  ", "THE!! WE'LL don't !'s ''S 2024x7", "a <|ENDOFTEXT|> B", "a <|endoftext|> B x<|startoftext|>Y", "RAÓ!! Ÿ ŉA ſs ÀÉß",
    "Thé the 漢字 ΑΣ İI", "tab\tTab \x1c\x1fEnd", "xyzzy" * 300, "\n\nA\n b", "e\u0301 E\u0301", "\U0001f600 \xff\xfe ÿÿÿÿ",
]


@pytest.mark.parametrize("entries", [0, 1, 2, 7, 20, 1000])
def test_mixed_batches_give_the_ids_of_their_texts(entries):
    own = tokens.WordEncoder(tokens.WORD_BPE, entries)
    rng, whole = np.random.default_rng(entries), Tokenizer.from_file(tokens.WORD_BPE)
    want = {t: whole.encode(t, add_special_tokens=False).ids for t in MIXED_TEXTS}
    for _ in range(30):
        some = [MIXED_TEXTS[k] for k in rng.integers(0, len(MIXED_TEXTS), rng.integers(1, 6))]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(some)] == [want[t] for t in some]
        assert len(own._words) <= entries and len(own._parts) <= entries


def test_words_are_learned_once_in_any_case_and_all_at_once():
    own, calls = tokens.WordEncoder(tokens.WORD_BPE), []
    learn = own._learn_parts
    own._learn_parts = lambda parts: calls.append(sorted(parts)) or learn(parts)
    own.encode(["Some words", "SOME WORDS some", "some, Words"])
    assert sorted(own._words) == ["some", "some,", "words"]
    own.encode(["WORDS, Some"])
    assert calls == [[",", "some", "words"]]


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(unit, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert tokenfile.from_planes(tokenfile.to_planes(ids, unit), n).tolist() == ids.tolist()


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_token_files(spark, odd, unit):
    path = fresh_path(spark, "t")
    tokenfile.write(odd, path, unit=unit)
    rows = sorted(tokenfile.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ODD_TEXTS), key=lambda d: (d is not None, d or 0))
    texts, at = dict(ODD_TEXTS), 0
    for r in rows:
        want = [*ids_of(texts[r.doc_id]), 2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (want, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_token_files_of_nothing(spark, odd):
    path = fresh_path(spark, "t")
    tokenfile.write(odd.limit(0), path)
    assert tokenfile.read(spark, path).count() == 0


def check_packing(rows, size):
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for placed in found.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(found)


def test_packing_rows(spark, odd):
    rows = packing.packed(odd, size=512, with_ids=True).collect()
    want = Counter()
    for doc_id, text in ODD_TEXTS:
        ids = [*ids_of(text), 1]
        want.update((doc_id, k, a, tuple(ids[a:a + 512])) for k, a in enumerate(range(0, len(ids), 512)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert check_packing(rows, 512) == -(-sum(r.length for r in rows) // 512)
    assert packing.packed(odd.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark, odd):
    placed = packing.packed(odd, size=512, with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plan_packs_every_piece(histogram):
    packed = packing.plan(histogram, 64) if histogram else []
    used = Counter()
    for pattern, times in packed:
        assert sum(pattern) <= 64 and times > 0
        used.update({n: c * times for n, c in Counter(pattern).items()})
    assert used == Counter(histogram)


def test_plan_comes_near_the_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 4096).tolist())
    packed = sum(times for _, times in packing.plan(histogram, 4096))
    assert packed <= 1.002 * -(-sum(n * c for n, c in histogram.items()) // 4096)


CHAT = [
    (1, 0, "system", "be <<SYS>> brief"), (1, 2, "assistant", "a\\b </s>"), (1, 1, "user", "hi [INST]"), (1, 3, "user", "bye"),
    (2, 0, "user", "no answer"), (3, 0, "assistant", None), (4, 0, None, "x"), (4, 0, None, "x"), (4, None, "assistant", "first"),
    (None, 0, "assistant", "n1"), (None, 0, "assistant", "n2"), (5, 0, "assistant", "long " * 20000), (5, 1, "assistant", "\\</s>\\\\[/INST]"),
]


def test_chat_examples_and_digests(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    examples = chat.examples(df)
    rows = examples.collect()
    by_conv = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(CHAT):
        by_conv[conv if conv is not None else ("n", k)].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(rows) == sum(max(1, sum(t[2] == "assistant" for t in ts) + (sorted(ts)[-1][2] != "assistant")) for ts in by_conv.values())
    for r in rows:
        assert not r.trained or r.text[r.loss_end:] == "</s>"
        assert r.text.count("</s>") == r.n_turns and r.text.count("[INST]") == r.n_turns
    got = {(r.conv_id, r.turns_sha256): r for r in chat.digests(examples).collect()}
    assert len(got) == len(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[(None if isinstance(conv, tuple) else conv, hashlib.sha256(said.encode()).hexdigest())]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.examples(df.limit(0)).count() == 0


PAGES = [(1, "u1", "same"), (9, "u9", "same"), (3, "u\r\n3", "same"), (4, None, None), (5, "u5", ""), (None, "n", "same"), (7, "u7", "x" * 300_000 + "é"),
         (9, "u9b", "same"), (2, "u2", "é")]


def test_archive(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "payload": F.lit("p")})
    path = fresh_path(spark, "w")
    warc.write(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({html or "" for _, _, html in PAGES})
    rows = warc.read(spark, path).collect()
    assert Counter(r.page_id for r in rows) == Counter(p for p, _, _ in PAGES)
    payload_of = {p: (h or "").encode() for p, _, h in PAGES}
    by_payload = defaultdict(list)
    for r in rows:
        body = payload_of[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        by_payload[body].append(r)
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert block.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
        assert block[:-4].partition(b"\r\n\r\n")[2] == (body if r.record_type == "response" else b"")
    for group in by_payload.values():
        last = max(r.page_id for r in group if r.page_id is not None)
        responses = [r for r in group if r.record_type == "response"]
        assert [r.page_id for r in responses] == [last] and responses[0].refers_to is None
        assert all(r.refers_to == last for r in group if r.record_type == "revisit")
    assert len({r.record_id for r in rows}) == len(rows)
    empty = fresh_path(spark, "w")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0
    small = fresh_path(spark, "w")
    warc.write(df, small, min_bytes=100)
    assert {r.record_type for r in warc.read(spark, small).collect()} == {"response"}
