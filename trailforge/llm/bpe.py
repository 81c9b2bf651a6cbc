"""BPE by dynamic programming over prefixes.

For each prefix of a pre-token exactly one token can be the last of its encoding: the one that is
compatible with the last token of what stands before it. An Aho-Corasick automaton (the suffix automaton of the
vocabulary) lists the tokens that end at each position, a memoised pair test picks the one that fits, and the
back-pointers give the ids. The work is linear in the length of the word and needs no merge queue.

Defined cases: a null text is the empty text and has no tokens; special tokens that stand in a text become
their own ids; words of any length are encoded whole; rows without a doc_id, rows that repeat one and repeated rows are
encoded each by itself; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.util
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trailforge.llm.common import give_back

#: White space as Unicode defines it, and what splits a word from its neighbours.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Distinct words kept with their ids in one worker; beyond it the memory is emptied and filled anew. Fewer where a worker
#: has served other stages before.
WORDS_KEPT, FEWER_WORDS_KEPT = 700_000, 250_000
BITS, MASK = 20, (1 << 20) - 1  # a token's id below its length, or below the token before it
END = "\x00"  # marks the end of a word; no byte is written so


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and their ranks, read on the driver from a tokenizer's JSON text (a file of fixed size)."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.ends = bool(suffix)
        mark = (lambda t: t.removesuffix(suffix) + END if suffix and t.endswith(suffix) else t)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ids = {mark(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank, self.parts, self.joined = {}, {}, {}
        for k, pair in enumerate(model["merges"]):
            a, b = (mark(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[a + b]
            self.joined[self.ids[a], self.ids[b]] = k
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = k, (self.ids[a], self.ids[b])
        count = max(self.ids.values()) + 1  # the same by token, for the pair test
        self.ranks, self.lefts, self.rights = [-1] * count, [-1] * count, [-1] * count
        for token, (a, b) in self.parts.items():
            self.ranks[token], self.lefts[token], self.rights[token] = self.rank[token], a, b
        self.meets = {a << BITS | b: k for (a, b), k in self.joined.items()}
        self.usable = {t: i for t, i in self.ids.items() if t != END and self._stands(i)}

    def _stands(self, token: int) -> bool:
        """Whether merging its symbols yields the token itself: both parts do, and they meet before any other pair."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._stands(a) and self._stands(b) and self.fits(a, b, self.rank[token])

    def fits(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether a and b stay apart when their symbols are merged together.

        The last merge on either side is taken back, the right one first if both are of one rank; the tokens that
        then touch must have no merge of their own that would have come earlier.
        """
        ranks, lefts, rights, meets = self.ranks, self.lefts, self.rights, self.meets
        while True:
            meet = meets.get(a << BITS | b)
            if meet is not None and meet < limit:
                return False
            left, right = ranks[a], ranks[b]
            if left > right:
                if left < limit:
                    limit = left
                a = rights[a]
            elif right < 0:
                return True
            else:
                if right < limit:
                    limit = right + 1
                b = lefts[b]


class Encoder:
    """Encodes and decodes texts; keeps what it found for distinct words and pairs, within bounds."""

    def __init__(self, vocabulary: Vocabulary, words_kept: int = WORDS_KEPT):
        v = self.vocabulary = vocabulary
        self.words_kept = words_kept
        self.automaton = ahocorasick.Automaton()
        self.size = {}
        for token, i in v.usable.items():
            self.automaton.add_word(token, len(token) << BITS | i)
            self.size[i] = len(token)
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.end = END if v.ends else ""
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)
        self.shown = [v.shown.get(i, "").encode() for i in range(max(v.shown) + 1)]
        self.narrow = re.compile(rf"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|(?:{ENDINGS})|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
        self.beyond = re.compile("[^\x00-\xff]")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def encode_word(self, word: str) -> list[int]:
        plain = word.isascii() and word.isprintable()
        text = (word if plain else "".join(map(self.letters.__getitem__, word.encode()))) + self.end
        last, pairs = [-1] * len(text), self.pairs  # by the place at which a prefix ends
        for end, found in self.automaton.iter(text):
            if last[end] < 0:
                start = end - (found >> BITS)
                if start < 0:
                    last[end] = found & MASK
                elif (before := last[start]) >= 0:
                    key = before << BITS | found & MASK
                    fit = pairs.get(key)
                    if fit is None:
                        fit = pairs[key] = self.vocabulary.fits(before, found & MASK)
                    if fit:
                        last[end] = found & MASK
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(token := last[at])
            at -= self.size[token]
        return ids[::-1]

    def split(self, text: str) -> list[str]:
        """Pre-tokens: composed, lower-cased code point by code point, cut at white space and between kinds of characters."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() looks at the neighbours of this one
                text = text.replace("Σ", "σ")
            text = text.lower()
            if self.beyond.search(text):
                return wide().findall(text)
            return self.narrow.findall(text)
        return self.narrow.findall(text.lower())

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.words) > self.words_kept:
            self.words.clear()
        if len(self.pairs) > WORDS_KEPT:
            self.pairs.clear()
        if self.cut and any(s in text for s in self.vocabulary.special):
            special = self.vocabulary.special
            return b"".join(special[x].to_bytes(4, "little") if x in special else self._plain(x) for x in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: the tokens as the vocabulary shows them, with a space between."""
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Words(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.encoder.encode_word(word)).tobytes()
        if len(word) <= 64:
            self[word] = found
        return found


@functools.cache
def wide() -> re.Pattern:
    """The pattern for texts beyond Latin-1, with letters and numbers as Python's Unicode tables have them."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(0x110000):
        if kind := ranges.get(unicodedata.category(chr(c))[0]):
            if kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
        elif kind is not None:
            kind.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LN")
    return re.compile(f"{ENDINGS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers has a file; it is read on the driver only."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin), name)


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[str, Encoder] = {}


def broadcast_vocabulary(spark: SparkSession, path: str):
    """Read the file on the driver, where its path is valid, and send what it holds; its size does not grow with data."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(text)
    return spark.sparkContext.broadcast((key, _vocabularies[key]))


def encoder_of(shared, words_kept: int = WORDS_KEPT) -> Encoder:
    key, vocabulary = shared.value
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    _encoders[key].words_kept = words_kept
    return _encoders[key]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, words_kept: int = WORDS_KEPT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, one row per row of docs; ids on request.

    A map over the scan: no shuffle, and memory for one batch of texts and the bounded word memory.
    """
    shared = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = encoder_of(shared, words_kept)
        for batch in batches:
            n, first, second, kept = [], [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second), *([pa.array(kept, pa.binary())] if with_ids else [])], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
