"""Token ids by a public tokenizer, encoded word by word with bounded caches.

The tokenizer drops white space and never merges across it, nor across the borders of its own pre-tokens (runs of
letters, single digits, runs of other signs). So the ids of a text are the ids of its words in order, and those of a plain word the ids of its pre-tokens. Each worker keeps the ids of words and pre-tokens it
has seen, up to a number of entries and of bytes; the caches only save work and never change a result. Words with
anything but printable ASCII and common Latin letters are given to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa

# One worker per core: the library must not start threads of its own. Set before it is imported.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

CACHE_ENTRIES = 450_000
# Bytes of words and ids that a cache holds per entry on average at most; long words fill it sooner.
_ENTRY_BYTES = 96
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# The tokenizer's pre-token pattern, restricted to the letters that _PLAIN lets through, and its word end.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
_PLAIN_LINES = re.compile(r"[\n!-~À-ÖØ-öø-įı-ſ]*")
_PARTS = re.compile(r"[a-zß-öø-ſ]+|\n|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\na-z0-9ß-öø-ſ]+")
_WORD_END = "</w>"
# Stands between the ids of words while many are joined: no id, and since ids stay below 2**24 no other bytes look like it.
_BREAK_ID = 0xFFFFFFFF
_BREAK = b"\xff\xff\xff\xff"


def _bytes(entries: dict[str, bytes]) -> int:
    return sum(map(len, entries)) + sum(map(len, entries.values()))


class WordEncoder:
    """Encodes whole texts; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self._np = np
        self._tokenizer = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 2**24:
            raise ValueError("ids of 2**24 and more are not supported")
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self._closes[[k for token, k in vocabulary.items() if token.endswith(_WORD_END)]] = True
        # The same model for pre-tokens that are cut and lower-cased already.
        self._part_tokenizer = Tokenizer(self._tokenizer.model)
        self._part_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._most, self._word_bytes, self._part_bytes = cache_entries, 0, 0

    def _encode_direct(self, text: str) -> bytes:
        return self._np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Every pre-token ends with the only one of its ids that closes a word, so one call encodes many."""
        learned: dict[str, bytes] = {}
        for at in range(0, len(parts), 10_000):
            some = parts[at:at + 10_000]
            joined = self._part_tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = self._np.array(joined.ids, "<u4")
            ends = self._np.flatnonzero(self._closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("the tokenizer does not close each pre-token once")
            learned.update(zip(some, self._np.insert(ids, ends, _BREAK_ID).tobytes().split(_BREAK), strict=False))
        return learned

    def _ids_of_parts(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of at least these pre-tokens; a line feed stands for the border of two words."""
        known, needed = self._parts, set(parts)
        fresh = needed.difference(known)
        if not fresh:
            return known
        border = {"\n": _BREAK} if "\n" in fresh else {}
        learned = self._learn_parts(list(fresh.difference(border))) | border
        size = _bytes(learned)
        if len(known) + len(learned) > self._most or self._part_bytes + size > self._most * _ENTRY_BYTES:
            learned |= {p: known[p] for p in needed.difference(fresh)}
            size = _bytes(learned)
            known.clear()
            self._part_bytes = 0
        if len(learned) > self._most or size > self._most * _ENTRY_BYTES:
            return learned
        known.update(learned)
        self._part_bytes += size
        return known

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        """All words are cut by one search over their lines, and their ids joined and cut again at once."""
        joined = "\n".join(words)
        special = [s for s in self._special if s in joined]
        learned: dict[str, bytes] = {}
        # Mostly all words are plain and none holds a special token's text; only otherwise each is looked at.
        if special or not _PLAIN_LINES.fullmatch(joined):
            plain = _PLAIN.fullmatch
            learned = {w: self._encode_direct(w) for w in words if not plain(w) or any(s in w for s in special)}
            words = [w for w in words if w not in learned]
            joined = "\n".join(words)
        if words:
            parts = _PARTS.findall(joined.lower())
            ids = b"".join(map(self._ids_of_parts(parts).__getitem__, parts))
            learned.update(zip(words, ids.split(_BREAK), strict=True))
        return learned

    def _split(self, text: str) -> list[str]:
        """The words of a text, in lower case where that cannot change their ids."""
        text = text.replace("\n", " ")
        if text.isascii():
            lowered = text.lower()
            if not any(s.lower() in lowered for s in self._special):
                text = lowered
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._split(text) for text in texts]
        cache, needed = self._words, set().union(*split)
        missing = needed.difference(cache)
        if len(cache) + len(missing) > self._most or self._word_bytes > self._most * _ENTRY_BYTES // 2:
            cache.clear()
            self._word_bytes = 0
            missing = needed
        # A small table of the words at hand is faster to look up than the whole cache.
        found = needed.difference(missing)
        ids = dict(zip(found, map(cache.__getitem__, found), strict=True))
        if missing:
            learned = self._learn_words(list(missing))
            ids |= learned
            size = _bytes(learned)
            if len(learned) <= self._most and size <= self._most * _ENTRY_BYTES // 2:
                cache.update(learned)
                self._word_bytes += size
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def forget(self) -> None:
        """Drop what the caches hold."""
        self._words.clear()
        self._parts.clear()
        self._word_bytes = self._part_bytes = 0

    def stream(self, column: pa.Array, rows: int = 256) -> Iterator[bytes]:
        """The ids of each text of a column (null: none), a few rows at a time to bound what is held at once."""
        for at in range(0, len(column), rows):
            yield from self.encode([t or "" for t in column.slice(at, rows).to_pylist()])


@lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> WordEncoder:
    """One encoder per worker process, file and cache size."""
    return WordEncoder(path, cache_entries)
