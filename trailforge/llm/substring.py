"""Exact removal of byte strings that repeat across documents, from maximal repeats in enhanced suffix arrays.

A suffix array of the whole corpus is cut into independent parts by minimisers. Each window of `length` bytes has one
minimiser, the 16-byte string in it with the least hash, so equal windows have equal minimisers wherever they stand.
Consecutive windows with one minimiser form a segment, and segments are dealt to buckets by their minimiser: the suffix
array of a bucket holds all occurrences of its windows. In it, a stack scan over the longest common prefixes walks
the interval tree; intervals of at least `length` bytes whose occurrences have different bytes to the left are the maximal
repeats, and each is put out with all of its occurrences. An occurrence in a document later than the first of its group
is removed.

Documents are dealt to blocks once. Blocks first ask which 33-byte strings beside their minimisers occur in another
document at all (every window holds one, before or after its minimiser), and only segments with such a string are
sent on, each distinct one once for each block. So a passage that stands in a third of all documents reaches its bucket
once for each block, and text that is nowhere repeated is never sent.

Defined cases: a null text is empty; texts shorter than `length` bytes are never changed; repeats within one document do
not count; rows that repeat a doc_id do not remove from one another; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailforge.llm.common import bucket_bounds, in_blocks, mix, pack_ints, pack_sorted, parts_of, rows_of, text_bytes, unpack_ints, unpack_sorted

GRAM, SIDE = 16, 17  # a minimiser's bytes, and those beside it in the strings that blocks ask for
LONGEST = 32_000  # bytes in a window, so that places within a segment have 16 bits
PIECE = 1 << 18  # bytes that are hashed at a time
SORTED_AT_ONCE = 40_000  # suffixes in one part of a suffix array
SCREENED_AT_ONCE = 200_000  # windows that are hashed at a time
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary"


def maximal_repeats(lines: list[bytes], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All (size, [(line, place), ...]): strings of at least `length` bytes that occur twice or more in lines and that
    no common byte before or after all occurrences would make longer. A line's start and end count as a change."""
    lens = np.array([len(x) for x in lines], np.int64)
    width = int(lens.max(initial=0))
    matrix = np.zeros((len(lines), width), np.uint8)
    matrix[np.arange(width)[None, :] < lens[:, None]] = np.frombuffer(b"".join(lines), np.uint8)
    out = []
    for size, line, place in _repeat_groups(matrix, lens, length):
        out.append((size, sorted(zip(line.tolist(), place.tolist(), strict=True))))
    return out


def _repeat_groups(matrix: np.ndarray, lens: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, lines, places) of each maximal repeat in the rows of a zero-filled matrix."""
    width = matrix.shape[1]
    starts = np.maximum(0, lens - length + 1)
    ends = np.cumsum(starts)
    if not ends[-1]:
        return
    padded = np.concatenate([matrix, np.zeros((len(lens), width + 8), np.uint8)], 1)
    # only windows whose first bytes occur twice can begin a repeat; equal ones stay together in each part that is sorted
    words = np.ndarray(padded.size - 7, "<u8", padded.data, strides=(1,))
    cover = sorted({*range(0, length - 7, 8), max(0, length - 8)})
    head = np.empty(ends[-1], np.uint64)

    def places(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = np.searchsorted(ends, window, "right")
        return line, window - (ends - starts)[line]

    for at in range(0, len(head), SCREENED_AT_ONCE):
        line, place = places(np.arange(at, min(len(head), at + SCREENED_AT_ONCE)))
        base, own = line * padded.shape[1] + place, np.zeros(len(line), np.uint64)
        for k in cover:
            word = words[base + k]
            own = mix(own ^ (word if length >= 8 else word & np.uint64((1 << 8 * length) - 1)))
        head[at : at + len(own)] = own
    twice = np.sort(head)
    twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
    if not len(twice):
        return
    window = np.concatenate([at + np.flatnonzero(twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part) for at, part in ((at, head[at : at + SCREENED_AT_ONCE]) for at in range(0, len(head), SCREENED_AT_ONCE))])
    head = head[window]
    order = np.argsort(head, kind="stable")
    first = np.flatnonzero(np.r_[True, head[order][1:] != head[order][:-1]])
    size = np.diff(np.r_[first, len(order)])
    del head, twice
    at = 0
    while at < len(first):
        to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), SORTED_AT_ONCE, "right")))
        chosen = order[np.repeat(first[at:to] - (np.cumsum(size[at:to]) - size[at:to]), size[at:to]) + np.arange(size[at:to].sum())]
        line, place = places(window[chosen])
        yield from _sorted_groups(matrix, padded, lens, length, line.astype(np.int32), place.astype(np.int32))
        at = to


def _sorted_groups(matrix: np.ndarray, padded: np.ndarray, lens: np.ndarray, length: int, line: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The maximal repeats that begin at the given places, from their part of the suffix array."""
    width = matrix.shape[1]
    # the suffix array: suffixes of at least `length` bytes in order, by content and then by length
    suffix = np.lib.stride_tricks.sliding_window_view(padded, width, 1)[line, place]
    left = lens[line] - place
    order = np.argsort(suffix.view(f"S{width}").ravel(), kind="stable")
    suffix, line, place, left = suffix[order], line[order], place[order], left[order]
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))  # zero bytes in texts do not reach past an end
    joined = common >= length
    # top intervals: runs of suffixes with that much in common; those with one byte to the left cannot hold a maximal repeat
    first = np.flatnonzero(np.r_[True, ~joined])
    size = np.diff(np.r_[first, len(line)])
    before = np.where(place > 0, matrix[line, place - 1].astype(np.int64), 256 + line)  # a line's start is like no other byte
    diverse = (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)) & (size > 1)
    for lo, n in zip(first[diverse].tolist(), size[diverse].tolist(), strict=True):
        if n == 2:
            yield int(common[lo]), line[lo : lo + 2], place[lo : lo + 2]
            continue
        heights, seen = [*common[lo : lo + n - 1].tolist(), 0], before[lo : lo + n].tolist()
        stack: list[list[int]] = []  # [height, start, one left byte or -1 if there are several]
        for k, height in enumerate(heights):
            start, bytes_left = k, seen[k]
            while stack and stack[-1][0] > height:
                h, start, own = stack.pop()
                own = own if own == bytes_left else -1
                if own == -1:
                    yield h, line[lo + start : lo + k + 1], place[lo + start : lo + k + 1]
                bytes_left = own
            if stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == bytes_left else -1
            elif height:
                stack.append([height, start, bytes_left])


def _words8(text: np.ndarray) -> np.ndarray:
    w = text.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    return w


class Segments:
    """The segments of a batch of pieces (doc, offset in it, bytes): for each, its document's row, its place, size and hashes."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int):
        self.pieces = pieces
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        self.text = text = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum(sizes)
        self.length = length
        grams = length - GRAM + 1  # in a window
        if len(text) < length:
            windows = np.zeros(0, np.int64)
        else:
            w = _words8(text)
            g = mix(mix(w[:-8]) + (w[8:] * np.uint64(0xC2B2AE3D27D4EB4F)))  # of each GRAM bytes
            self.gram = g
            least = (g >> np.uint64(24) << np.uint64(24)) | np.arange(len(g), dtype=np.uint64)
            span = 1
            while span * 2 <= grams:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < grams:
                least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
            valid = np.zeros(len(text), bool)
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                if b - a >= length:
                    valid[a : b - length + 1] = True
            windows = np.flatnonzero(valid[: len(least)])
        if not len(windows):
            self.start = self.count = self.at = self.row = self.doc_place = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        at = (least[windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]
        head = np.flatnonzero(new)
        self.start, self.count, self.at = windows[head], np.diff(np.r_[head, len(windows)]), at[head]
        piece = np.searchsorted(ends, self.start, "right")
        self.row = np.array([p[0] for p in pieces])[piece]
        self.doc_place = self.start - (ends - sizes)[piece] + np.array([p[1] for p in pieces])[piece]
        self.key = mix(self.gram[self.at])  # the least of many hashes is a small number; buckets are ranges of even ones

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the strings before and after each minimiser, with it, and whether some window holds them."""
        g, m = self.gram, self.at
        has_before = m - self.start >= SIDE
        has_after = self.start + self.count - 1 + self.length - m - GRAM >= SIDE
        b = np.where(has_before, m - SIDE, 0)
        before = mix(mix(mix(g[b]) ^ g[np.where(has_before, m - 1, 0)]) ^ g[m] ^ np.uint64(1))
        a = np.where(has_after, m + SIDE, 0)
        after = mix(mix(mix(g[m]) ^ g[np.where(has_after, m + SIDE - 1, 0)]) ^ g[a] ^ np.uint64(2))
        return before, after, has_before, has_after

    def names(self) -> np.ndarray:
        """A hash of each segment's whole content."""
        size = self.count - 1 + self.length
        name = mix(size.astype(np.uint64))
        for k in range(-(-(2 * self.length) // GRAM)):
            name = mix(name ^ self.gram[self.start + np.minimum(k * GRAM, size - GRAM)])
        return name

    def contents(self, chosen: np.ndarray) -> tuple[np.ndarray, bytes]:
        size = (self.count - 1 + self.length)[chosen]
        index = np.repeat(self.start[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return size, self.text[index].tobytes()


def _batches(texts: list[bytes], length: int, piece: int) -> Iterator[Segments]:
    """All windows of all texts, each in one batch of about `piece` bytes."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), piece):
            part = text[at : at + piece + length - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= piece:
                yield Segments(held, length)
                held, size = [], 0
    if held:
        yield Segments(held, length)


def _ranks(ids: list[int | None]) -> np.ndarray:
    return np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)


def _table(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    pa.default_memory_pool().release_unused()
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, length: int = 50, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept) of each document without the bytes that a string of `length` bytes
    covers which also starts in a document with a smaller doc_id; removed has the spans in the original bytes."""
    if not LONGEST >= length >= GRAM + 2 * SIDE - 1:
        raise ValueError(f"length must be from {GRAM + 2 * SIDE - 1} to {LONGEST}: shorter windows need not hold a minimiser with its side")
    small = np.dtype(np.uint8 if 2 * length <= 256 else np.uint16)  # a segment is shorter than two windows
    total = text_bytes(docs)
    buckets = parts_of(total)
    blocks = in_blocks(docs, parts_of(total))
    shift = np.uint64(max(0, 64 - (total.bit_length() + 10)))  # keys so long that few strings meet by chance, as the corpus grows
    lower = bucket_bounds(buckets) >> shift

    def ask(table: pa.Table) -> pa.Table:
        """Which side strings occur here, and which of them in several documents."""
        block, ids, texts = rows_of(table)
        rank, keys, owner = _ranks(ids), [], []
        for s in _batches(texts, length, piece):
            if len(s.start):
                before, after, has_before, has_after = s.sides()
                own = rank[s.row]
                keys += [before[has_before] >> shift, after[has_after] >> shift]
                owner += [own[has_before], own[has_after]]
        keys, owner = (np.concatenate(keys), np.concatenate(owner)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
        lead = keys[first]
        cuts = [0, *np.searchsorted(lead, lower).tolist(), len(lead)]
        out = [(k, block, pack_sorted(lead[a:b]), np.packbits(several[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return _table(["bucket", "block", "keys", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()], out)

    def answer(table: pa.Table) -> pa.Table:
        """Tell each block which of its strings occur in more than one document."""
        block = table.column("block").to_pylist()
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("several").to_pylist(), keys, strict=True)]
        every = np.sort(np.concatenate([*keys, *(k[s] for k, s in zip(keys, several, strict=True))]))
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for b, k in zip(block, keys, strict=True):
            at = np.minimum(np.searchsorted(repeated, k), max(0, len(repeated) - 1))
            hot = k[repeated[at] == k] if len(repeated) else k[:0]
            if len(hot):
                out.append((b, pack_sorted(hot)))
        return _table(["block", "hot"], [pa.int32(), pa.binary()], out)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        """The distinct segments with a repeated string, by bucket of their minimiser, with the first and last document of each here."""
        names = ["bucket", "block", "keys", "names", "least", "most", "sizes", "data"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        if not table.num_rows or not replies.num_rows:
            return _table(names, kinds, [])
        block, ids, texts = rows_of(table)
        rank = _ranks(ids)
        hot = np.sort(np.concatenate([unpack_sorted(x) for x in replies.column("hot").to_pylist()]))
        held: list[tuple] = []
        for s in _batches(texts, length, piece):
            if not len(s.start):
                continue
            before, after, has_before, has_after = s.sides()
            chosen = np.zeros(len(s.start), bool)
            for key, has in ((before, has_before), (after, has_after)):
                k = key >> shift
                chosen |= has & (hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k)
            pick = np.flatnonzero(chosen)
            if len(pick):
                name, own = s.names()[pick], rank[s.row[pick]]
                order = np.argsort(name, kind="stable")
                first = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
                lead = pick[order[first]]
                size, data = s.contents(lead)
                held.append((s.key[lead], name[order[first]], np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first), size, np.frombuffer(data, np.uint8)))
        if not held:
            return _table(names, kinds, [])
        key, name, least, most, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
        begin = np.cumsum(size) - size
        order = np.lexsort((name, key))
        first = np.flatnonzero(np.r_[True, (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])])
        least, most, lead = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first), order[first]
        key, name, size, begin = key[lead], name[lead], size[lead], begin[lead]
        cuts, out = [0, *np.searchsorted(key, bucket_bounds(buckets)).tolist(), len(key)], []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                n = size[a:b]
                index = np.repeat(begin[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append((k, block, pack_sorted(key[a:b]), name[a:b].astype("<u8").tobytes(), pack_ints(least[a:b]), pack_ints(most[a:b]), n.astype(small).tobytes(), data[index].tobytes()))
        return _table(names, kinds, out)

    def scan(table: pa.Table) -> pa.Table:
        """The maximal repeats of a bucket; for each block, (segment's name, place, size, first document) of what may go."""
        def joined(column, read):
            return np.concatenate([read(x) for x in table.column(column).to_pylist()])

        sizes = joined("sizes", lambda x: np.frombuffer(x, small)).astype(np.int64)
        counts = [len(x) // small.itemsize for x in table.column("sizes").to_pylist()]
        block = np.repeat(table.column("block").to_numpy(), counts)
        key, name = joined("keys", unpack_sorted), joined("names", lambda x: np.frombuffer(x, "<u8"))
        least, most, data = joined("least", unpack_ints), joined("most", unpack_ints), joined("data", lambda x: np.frombuffer(x, np.uint8))
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((name, key))
        first = np.flatnonzero(np.r_[True, (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])])
        copies = np.diff(np.r_[first, len(order)])
        one = order[first]  # a distinct segment each
        seg_least, seg_most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
        seg_of = np.empty(len(order), np.int64)
        seg_of[order] = np.repeat(np.arange(len(first)), copies)
        told: list[tuple[np.ndarray, ...]] = []
        # a segment that several documents share is a repeat as a whole
        shared = np.flatnonzero(seg_most > seg_least)
        told.append((shared.astype(np.int32), np.zeros(len(shared), small), sizes[one][shared].astype(small), seg_least[shared]))
        # segments of one minimiser stay together in each part that is sorted at once
        starts = np.flatnonzero(np.r_[True, key[one][1:] != key[one][:-1], True])
        at = 0
        while at < len(starts) - 1:
            to = at + 1
            while to < len(starts) - 1 and starts[to + 1] - starts[at] <= 2000:
                to += 1
            part = np.arange(starts[at], starts[to])
            at = to
            if len(part) < 2:
                continue
            lens = sizes[one[part]]
            width = int(lens.max())
            matrix = np.zeros((len(part), width), np.uint8)
            fill = np.arange(width)[None, :] < lens[:, None]
            matrix[fill] = data[np.repeat(begin[one[part]] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
            # what an earlier document has of each segment; a group's first document need not be told apart from
            # others before the segment's own, so spans of one segment are joined
            mark = np.zeros((len(part), width + 1), np.int32)
            for size, line, place in _repeat_groups(matrix, lens, length):
                own = seg_least[part[line]]
                later = own > own.min()
                np.add.at(mark, (line[later], place[later]), 1)
                np.add.at(mark, (line[later], place[later] + size), -1)
            inside = np.cumsum(mark[:, :-1], 1) > 0
            line, edge = np.nonzero(np.diff(np.pad(inside, ((0, 0), (1, 1))).astype(np.int8), axis=1))
            if len(line):
                own = part[line[::2]]
                told.append((own.astype(np.int32), edge[::2].astype(small), (edge[1::2] - edge[::2]).astype(small), seg_least[own] - 1))
        seg, place, size, lowest = (np.concatenate(x) for x in zip(*told, strict=True))
        # to every block that sent the segment and has a document later than the first
        by_seg = np.argsort(seg_of, kind="stable")
        from_ = np.r_[0, np.cumsum(copies)]
        n = copies[seg]
        sent = by_seg[np.repeat(from_[seg] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        place, size, lowest = np.repeat(place, n), np.repeat(size, n), np.repeat(lowest, n)
        late = most[sent] > lowest
        sent, place, size, lowest = sent[late], place[late], size[late], lowest[late]
        order = np.lexsort((place, name[sent], block[sent]))
        sent, place, size, lowest = sent[order], place[order], size[order], lowest[order]
        owner = block[sent]
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(owner)]):
            out.append((int(owner[a]), pack_sorted(name[sent[a:b]]), key[sent[a:b]].astype("<u8").tobytes(), place[a:b].astype(small).tobytes(), size[a:b].astype(small).tobytes(), pack_ints(lowest[a:b])))
        return _table(["block", "names", "keys", "places", "sizes", "least"], [pa.int32(), *[pa.binary()] * 5], out)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        if not table.num_rows:
            return _table(names, kinds, [])
        _, ids, texts = rows_of(table)
        rank = _ranks(ids)
        gone: dict[int, np.ndarray] = {}  # of each changed document, where spans begin (+1) and end (-1)
        if replies.num_rows:
            name = np.concatenate([unpack_sorted(x) for x in replies.column("names").to_pylist()])
            key = np.concatenate([np.frombuffer(x, "<u8") for x in replies.column("keys").to_pylist()])
            place, size = (np.concatenate([np.frombuffer(x, small) for x in replies.column(c).to_pylist()]).astype(np.int64) for c in ("places", "sizes"))
            least = np.concatenate([unpack_ints(x) for x in replies.column("least").to_pylist()])
            order = np.argsort(name, kind="stable")
            name, key, place, size, least = name[order], key[order], place[order], size[order], least[order]
            for s in _batches(texts, length, piece):
                if not len(s.start):
                    continue
                own = s.names()
                a, b = np.searchsorted(name, own, "left"), np.searchsorted(name, own, "right")
                n = b - a
                hit = np.repeat(np.arange(len(own)), n)
                told = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                late = (rank[s.row[hit]] > least[told]) & (s.key[hit] == key[told])
                hit, told = hit[late], told[late]
                rows, begin = s.row[hit], s.doc_place[hit] + place[told]
                end = begin + size[told]
                for row in np.unique(rows).tolist():
                    mark = gone.setdefault(row, np.zeros(len(texts[row]) + 1, np.int32))
                    mine = rows == row
                    np.add.at(mark, begin[mine], 1)
                    np.add.at(mark, end[mine], -1)
        out = []
        for row, (i, text) in enumerate(zip(ids, texts, strict=True)):
            if row not in gone:
                out.append((i, len(text), 0, 0, [], text))
                continue
            off = np.cumsum(gone[row])[:-1] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, off, False]))
            spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            out.append((i, len(text), int(off.sum()), len(spans), spans, np.frombuffer(text, np.uint8)[~off].tobytes()))
        return _table(names, kinds, out)

    asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, several binary")
    hot = asked.groupBy("bucket").applyInArrow(answer, "block int, hot binary")
    sent = blocks.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(send, "bucket int, block int, keys binary, names binary, least binary, most binary, sizes binary, data binary")
    repeats = sent.groupBy("bucket").applyInArrow(scan, "block int, names binary, keys binary, places binary, sizes binary, least binary")
    return blocks.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(cut, RESULT)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
