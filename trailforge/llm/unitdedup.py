"""Substring dedup by hashing lines and the sentences in them.

Units are normalised (lower case, white space squeezed) and hashed; of all occurrences of a unit in the corpus the
one of least rank (doc_id, then place) stays, the others go, and spans are offsets in the original text. Two grains:
whole lines, and sentences, so that a passage is also found where it stands within a longer line. A unit has at
least `min_words` words; a shorter sentence is looked up together with the sentences after it, and with those before
it, until that many words are reached, and only the short sentence itself is removed.

Digests have 128 bits. Defined cases: a null or empty text has no units and is kept as it is; rows that repeat a doc_id
follow one another in the order of their texts, the first ranks first; rows without an id rank before all others, in the
order of a hash of their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from trailforge.llm.common import bucket_bounds, in_blocks, pack_ints, pack_sorted, parts_of, rows_of, text_bytes, unpack_ints, unpack_sorted

#: Bytes of text in a block; a bucket has the keys of four.
BLOCK_BYTES = 8_000_000

_sentence = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n|[.!?]+|$)\s*")
RESULT = "doc_id long, n_chars long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept string"


def units(text: str, min_words: int) -> list[tuple[bytes, int, int]]:
    """(key, start, end) of every unit of a text; the key is a 128-bit digest, the span is in characters."""
    found, at = [], 0
    for line in text.split("\n"):
        words = line.lower().split()
        if len(words) >= min_words:
            found.append((xxhash.xxh3_128_digest(" ".join(words), 1), at, min(len(text), at + len(line) + 1)))
        at += len(line) + 1
    parts = [(m.start(), m.end(), m.group().lower().split()) for m in _sentence.finditer(text) if m.end() > m.start()]
    for k, (start, end, words) in enumerate(parts):
        for step in (1,) if len(words) >= min_words else (1, -1):
            own, at = words, k + step
            while len(own) < min_words and 0 <= at < len(parts):
                own = own + parts[at][2] if step > 0 else parts[at][2] + own
                at += step
            if len(own) >= min_words:
                found.append((xxhash.xxh3_128_digest(" ".join(own), 2 if len(words) >= min_words else 3 if step > 0 else 4), start, end))
    return found


def rank_of(doc_id: int | None, text: bytes) -> int:
    """Where a document stands in the order in which occurrences are kept."""
    return doc_id if doc_id is not None else -(1 << 62) - 1 - (xxhash.xxh3_64_intdigest(text) >> 2)


def _block_units(table: pa.Table, min_words: int):
    """A block's number, ids, ranks, texts, and its units: rows, (key, start, end), keys as pairs of 64 bits, their order and first places."""
    block, ids, raw = rows_of(table)
    by = sorted(range(len(ids)), key=lambda k: rank_of(ids[k], raw[k]))
    ids, rank = [ids[k] for k in by], np.array([rank_of(ids[k], raw[k]) for k in by], np.int64)
    texts = [raw[k].decode("utf-8", "replace") for k in by]
    each = [units(t, min_words) for t in texts]
    row = np.repeat(np.arange(len(ids)), [len(x) for x in each])
    flat = [u for x in each for u in x]
    keys = np.frombuffer(b"".join(u[0] for u in flat), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: rows are in rank order already
    first = np.ones(len(keys), bool)
    first[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
    return block, ids, rank, texts, row, flat, keys, order, first


def dedup_units(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """Documents with the repeated units removed, as (doc_id, n_chars, n_removed, n_spans, removed, kept)."""
    total = text_bytes(docs)
    buckets = parts_of(total, 4 * BLOCK_BYTES)
    blocks = in_blocks(docs, parts_of(total, BLOCK_BYTES))

    def ask(table: pa.Table) -> pa.Table:
        block, _, rank, _, row, _, keys, order, first = _block_units(table, min_words)
        lead = order[first]
        high, low = keys[lead, 0], keys[lead, 1].astype("<u8")
        cuts = [0, *np.searchsorted(high, bucket_bounds(buckets)).tolist(), len(lead)]
        out = [(k, block, pack_sorted(high[a:b]), low[a:b].tobytes(), pack_ints(rank[row[lead[a:b]]])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "high", "low", "ranks"])

    def answer(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        sent = [unpack_sorted(x) for x in table.column("high").to_pylist()]
        ends = np.cumsum([len(x) for x in sent])
        high, low = np.concatenate(sent), np.frombuffer(b"".join(table.column("low").to_pylist()), "<u8")
        rank = np.concatenate([unpack_ints(x) for x in table.column("ranks").to_pylist()])
        order = np.lexsort((rank, low, high))
        later = np.zeros(len(high), bool)
        later[order[1:]] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        spans = [(a, b) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        some = [k for k, (a, b) in enumerate(spans) if later[a:b].any()]
        lost = [(high[a:b][later[a:b]], low[a:b][later[a:b]]) for a, b in (spans[k] for k in some)]
        return pa.table([pa.array(blocks[some], pa.int32()), pa.array([pack_sorted(h) for h, _ in lost], pa.binary()), pa.array([x.tobytes() for _, x in lost], pa.binary())], names=["block", "high", "low"])

    def drop(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([])
        _, ids, _, texts, row, flat, keys, order, first = _block_units(table, min_words)
        whole = lambda high, low: np.ascontiguousarray(np.stack([high, low], 1).astype(">u8")).view("S16").ravel()
        lost = [whole(unpack_sorted(h), np.frombuffer(x, "<u8")) for h, x in zip(replies.column("high").to_pylist(), replies.column("low").to_pylist(), strict=True)]
        gone = np.isin(whole(keys[:, 0], keys[:, 1]), np.concatenate(lost)) if lost and len(keys) else np.zeros(len(keys), bool)
        gone[order[~first]] = True
        spans: list[list[tuple[int, int]]] = [[] for _ in ids]
        for k in np.flatnonzero(gone).tolist():
            spans[row[k]].append(flat[k][1:])
        out = []
        for i, text, own in zip(ids, texts, spans, strict=True):
            merged: list[list[int]] = []
            for a, b in sorted(own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            stay, at = [], 0
            for a, b in merged:
                stay.append(text[at:a])
                at = b
            out.append((i, len(text), sum(b - a for a, b in merged), len(merged), [{"start": a, "end": b} for a, b in merged], "".join(stay) + text[at:]))
        return _result(out)

    asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block int, high binary, low binary, ranks binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "block int, high binary, low binary")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(drop, RESULT)


def _result(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "n_removed", "n_spans", "removed", "kept"])


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
