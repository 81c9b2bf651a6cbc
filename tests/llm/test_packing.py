import random

import numpy as np
import pytest

from trailforge.llm import packing
from trailforge.llm.bpe import Encoder, Vocabulary
from trailforge.llm.queries import tokenizer_path


def brute(sizes, length):
    """Best fit in decreasing order by looking at every open row."""
    segments = sorted(((at, i, min(length, n - at)) for i, n in enumerate(sizes) for at in range(0, n, length)), key=lambda s: (-s[2], s[1], s[0]))
    rooms = []
    for _, _, size in segments:
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(length - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_packs_as_well_as_a_full_search(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, rng.randrange(1, 64), rng.randrange(1, 300)]) for _ in range(200)]
    rows = packing.pack(sizes, 64)
    assert sorted(64 - sum(s for _, _, s in row) for row in rows) == brute(sizes, 64)
    seen = sorted((i, a, s) for row in rows for i, a, s in row)
    for i, n in enumerate(sizes):
        own = [(a, s) for j, a, s in seen if j == i]
        assert [a for a, _ in own] == list(range(0, n, 64)) and sum(s for _, s in own) == n


def test_round_trip(spark):
    rows = [(1, "one two three " * 900), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "no id"), (6, "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'x' AS ids")
    out = packing.pack_documents(docs, tokenizer_path(), length=256).collect()
    encoder = Encoder(Vocabulary(open(tokenizer_path(), encoding="utf-8").read()))
    parts = {}
    for r in out:
        ids, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(places) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and len(r["segments"]) == r["n_segments"]
        assert (ids[r["n_tokens"] :] == 49407).all()
        for s, a, b in zip(r["segments"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert b - a == s["length"] and (places[a:b] == np.arange(b - a)).all()
            parts.setdefault(s["doc_id"], []).append((s["start"], ids[a:b].tolist()))
    whole = lambda text: np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert sum((x for _, x in sorted(parts[1])), []) == whole(rows[0][1])
    assert [x for _, x in parts[4]] == [whole("short")] * 2 and parts[None][0][1] == whole("no id") and set(parts) == {1, 4, None}


def test_rows_do_not_hang_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = packing.pack_documents(docs.repartition(n), tokenizer_path(), length=256, shard_bytes=60_000).collect()
            seen.append(sorted((r["shard"], r["row"], bytes(r["input_ids"]), tuple(map(tuple, r["segments"]))) for r in out))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len({s[0] for s in seen[0]}) > 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_path()).count() == 0


def test_positions_of_long_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 70_000), (2, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_path(), length=100_000).collect()
    assert len(rows) == 1 and rows[0]["n_tokens"] == 70_000
    places = np.frombuffer(rows[0]["position_ids"], "<u4")
    assert (places[:70_000] == np.arange(70_000)).all() and (places[70_000:] == np.arange(30_000)).all()
