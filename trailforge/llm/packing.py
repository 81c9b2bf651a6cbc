"""Packing of token ids into fixed rows, best fit in decreasing order.

Documents are encoded where they are read and dealt to shards by a hash of id and text. There is a shard for every
SHARD_BYTES of text in the corpus, so a shard's work is bounded and the result follows from the documents alone, not
from how they are partitioned. In a shard each document
is cut into segments of at most `length` tokens (a longer one into whole rows and a rest, so nothing is lost),
segments are taken from the longest to the shortest, and each goes to the open row with the least room that still
holds it. A segment tree over the amounts of room finds that row in O(log length).

A row of the result is one row of the id matrix: `input_ids` (little-endian unsigned 16 or 32 bit integers, filled up
with the pad id), `cu_seqlens` (cumulative segment lengths from 0), `position_ids` (as input_ids, but of 32 bits where rows are
longer than 65,536; they restart at 0 with each segment and in the fill) and, for each segment, its document, its first token's place in it and its length.

Defined cases: a null text or one without tokens has no segment; rows that repeat a doc_id or have none are documents of their
own; ties in length go by doc_id, null first, then by ids and place; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.bpe import broadcast_vocabulary, encoder_of
from trailforge.llm.common import parts_of, text_bytes

#: Bytes of the corpus's texts for each shard.
SHARD_BYTES = 4_000_000
RESULT = (
    "shard int, row int, n_tokens long, n_segments int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
    "segments array<struct<doc_id:long,start:long,length:long>>"
)


class RoomTree:
    """Rows by the room they have left; finds the least room of at least a wanted size."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)  # how many rows lie below each node
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, want: int) -> tuple[int, int] | None:
        """(room, row) of the tightest fit, taken out; None if nothing is large enough."""
        node = want + self.base
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up until a right neighbour has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node <<= 1
                if not self.count[node]:
                    node += 1
        room = node - self.base
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.base
        while node:
            self.count[node] += by
            node >>= 1


def pack(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (item, start, size) for items of these sizes, given in the order that breaks ties."""
    segments = [(at, item, min(length, size - at)) for item, size in enumerate(sizes) for at in range(0, size, length)]
    segments.sort(key=lambda s: (-s[2], s[1], s[0]))
    tree, rows = RoomTree(length), []
    for start, item, size in segments:
        found = tree.take(size)
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append((item, start, size))
        if room > size:
            tree.put(room - size, row)
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, pad_id: int = 49407, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The packed id matrix of all documents, one row of it per row (RESULT)."""
    shared = broadcast_vocabulary(docs.sparkSession, tokenizer)
    wide = max(shared.value[1].shown) > 0xFFFF
    kind = np.dtype("<u4" if wide else "<u2")
    place_kind = np.dtype("<u4") if length > 1 << 16 else kind

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t.as_py()), "<u4").astype(kind).tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def fill(table: pa.Table) -> pa.Table:
        doc_ids, ids = table.column("doc_id").to_pylist(), table.column("ids").cast(pa.large_binary()).to_pylist()
        order = sorted((k for k in range(len(ids)) if ids[k]), key=lambda k: (doc_ids[k] is not None, doc_ids[k] or 0, ids[k]))
        tokens, width = [ids[k] for k in order], kind.itemsize
        shard, out = table.column("shard")[0].as_py(), []
        pad, count = np.full(length, pad_id, kind).tobytes(), np.arange(length, dtype=place_kind).tobytes()
        for row, own in enumerate(pack([len(t) // width for t in tokens], length)):
            parts, places, ends, n, told = [], [], [0], 0, []
            for i, at, size in own:
                parts.append(tokens[i][at * width : (at + size) * width])
                places.append(count[: size * place_kind.itemsize])
                ends.append(n := n + size)
                told.append({"doc_id": doc_ids[order[i]], "start": at, "length": size})
            out.append((shard, row, n, len(own), b"".join([*parts, pad[n * width :]]), b"".join([*places, count[: (length - n) * place_kind.itemsize]]), ends, told))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])))
        names = ["shard", "row", "n_tokens", "n_segments", "input_ids", "position_ids", "cu_seqlens", "segments"]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 8, kinds, strict=True)], names=names)

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts_of(text_bytes(docs), shard_bytes))).cast("int")
    dealt = docs.select(shard.alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dealt.mapInArrow(encode, "shard int, doc_id long, ids binary").groupBy("shard").applyInArrow(fill, RESULT)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrix as Parquet, its ids as they are; Spark's committer leaves whole files only."""
    packed.write.mode("overwrite").parquet(path)
