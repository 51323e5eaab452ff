"""Operators that place rows: mix, shards, packing, and top-k search."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_cases import corpus, edge_rows, frame
from tokenizers import Tokenizer

from mirrorkeep.llm import mixing, packing, sharding, topk_search

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("rows", [corpus(41, 150), edge_rows()], ids=["corpus", "edges"])
@pytest.mark.parametrize("weights", [{"src0": 3, "src1": 2, "src3": 4}, {}], ids=["weights", "none"])
def test_mix_keeps_every_row_and_its_windows(spark, rows, weights):
    docs = frame(spark, rows, clashing=True)
    got = mixing.mix(docs, weights, rest_weight=2, block_bytes=150)
    assert got.select("row.*").schema.names == docs.columns
    found = got.select("row.doc_id", "row.text", "row.source", "stream", "block", "slot", "release", "due", got["place"].alias("at")).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    slots = {(r.stream, r.block): r.slot for r in found}
    assert len(set(slots.values())) == len(slots)
    assert all(r.release <= r.slot < r.due for r in found)
    for stream in {r.stream for r in found}:
        mine = sorted((r.slot, r.at) for r in found if r.stream == stream)
        assert [(s, a) for s, a in mine] == sorted(((r.slot, r.at) for r in found if r.stream == stream))
        blocks = [b for _, b in sorted((s, b) for (st, b), s in slots.items() if st == stream)]
        assert blocks == sorted(blocks)
    names = sorted(weights)
    for r in found:
        assert r.stream == (names.index(r.source) if r.source in weights else len(names))


def test_timetable_deviates_by_less_than_a_block(spark):
    streams = [(0, 5, 37), (1, 3, 9), (2, 1, 11), (3, 4, 40)]
    table = mixing.timetable(spark.createDataFrame(streams, "stream int, weight int, blocks long")).collect()
    slots = {}
    for stream, weight, blocks in streams:
        for block in range(blocks):
            rounds, place = divmod(block, weight)
            (t,) = [t for t in table if t.stream == stream and t.place == place and t.first_round <= rounds < t.end_round]
            begin = t.base + (rounds - t.first_round) * t.h
            assert begin + t.release <= (slot := begin + t.slot) < begin + t.due
            slots[slot] = stream
    assert sorted(slots) == list(range(sum(b for _, _, b in streams)))
    # While all sources have blocks, at any time.
    h = sum(w for _, w, _ in streams)
    whole = min(b // w for _, w, b in streams)
    for stream, weight, _ in streams:
        given = 0
        for slot in range(whole * h):
            given += slots[slot] == stream
            assert abs(given - (slot + 1) * weight / h) < 1


def test_mix_refuses_other_weights(spark):
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, corpus(1, 5)), {"src0": 0.5})


@pytest.mark.parametrize("limit", [300, 5000, 1 << 30])
@pytest.mark.parametrize("rows", [corpus(42, 150), edge_rows()], ids=["corpus", "edges"])
def test_shards_fit_and_only_oversized_ones_split(spark, rows, limit):
    docs = frame(spark, rows, clashing=True)
    got = sharding.shard(docs, limit)
    assert got.select("row.*").schema.names == docs.columns
    found = got.select("row.doc_id", "row.text", "n_bytes", "shard", "shard_bytes", "shard_rows").collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    members = defaultdict(list)
    for r in found:
        assert r.n_bytes == len((r.text or "").encode())
        members[r.shard].append(r)
    for name, mine in members.items():
        assert {r.shard_bytes for r in mine} == {sum(r.n_bytes for r in mine)} and {r.shard_rows for r in mine} == {len(mine)}
        assert mine[0].shard_bytes <= limit or len(mine) == 1
        path = name.split("-")
        assert not name or path[-1] == "" or sum(r.n_bytes for n, o in members.items() if n.startswith(name[:-1]) for r in o) > limit
        for r in mine:
            number = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
            assert f"{number:060b}".startswith(path[0])
    assert sharding.directory(got).count() == len(members)


def test_equal_rows_over_the_limit_are_parted(spark):
    rows = [(1, "x" * 100, "", "", 0)] * 30 + [(1, "y" * 50, "", "", 0)] * 3
    found = sharding.shard(frame(spark, rows), 250).select("shard", "n_bytes", "shard_bytes").collect()
    assert len(found) == 33 and all(r.shard_bytes <= 250 for r in found) and len({r.shard for r in found}) >= 13


def plain_pieces(rows, capacity):
    tokenizer, out = Tokenizer.from_file(BPE), Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for i, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = np.array(ids[start : start + (capacity if i else first)], dtype="<u4")
            out[r[0], i, start, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("capacity", [64, 2048])
@pytest.mark.parametrize("rows", [corpus(43, 150), edge_rows()], ids=["corpus", "edges"])
def test_packing(spark, rows, capacity):
    got = packing.pack(frame(spark, rows, clashing=True).repartition(5), BPE, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows, capacity)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= capacity
    # One task with all pieces would not need many fewer.
    alone = packing.best_fit(np.array([r.length for r in got]), capacity)[2]
    assert len(sequences) <= 1.1 * len(alone) + 1


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_best_fit():
    dice = np.random.RandomState(0)
    sizes = dice.randint(1, 101, 2000)
    bins, offsets, filled = packing.best_fit(sizes, 100)
    assert filled.max() <= 100 and len(filled) <= 1.02 * math.ceil(sizes.sum() / 100) + 1
    for b in range(len(filled)):
        mine = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
        assert [o for o, _ in mine] == np.cumsum([0] + [n for _, n in mine])[:-1].tolist()
    assert packing.best_fit(np.empty(0, dtype=np.int64), 10)[2].size == 0


def test_words_are_encoded_as_in_the_text():
    dice, encoder = random.Random(7), packing.Encoder(BPE)
    texts = ["".join(dice.choices(["a", "the", "'s", " ", " ", "\n", "\t", "é", "日本", ".", "12", "<|endoftext|>", "\x1c", " ", "　", "​", "᠎", "\r", ",", ",", ".", "a.b", "x,", "é.", "̈", "\n"], k=dice.randint(0, 30))) for _ in range(6000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    tokens, bounds = encoder.encode(pa.array(texts))
    assert [tokens[i : j - 1].tobytes() for i, j in pairwise(bounds)] == want and set(tokens[bounds[1:] - 1]) == {0}
    assert encoder.encode(pa.array(texts))[0].tobytes() == tokens.tobytes()


def plain_top(vectors, k, asks):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in rows:
        if asks(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in rows if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    dice = random.Random(5)
    vectors = [(i, [dice.choice([0.0, 0.0, dice.uniform(-1, 1)]) for _ in range(12)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)]  # ties
    vectors += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (None, [1.0] * 12), (405, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS id", "2 AS score", "3 AS block")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    rows = topk_search.integer_vectors(df)
    got = topk_search.top_k(rows.where("id % 10 = 0"), rows, k=9).collect()
    assert {tuple(r) for r in got} == plain_top(exact, 9, lambda q: q % 10 == 0) and len(got) == 9 * 34
    few = rows.where("id < 4")
    assert {tuple(r) for r in topk_search.top_k(few, few, k=9).collect()} == plain_top([v for v in exact if v[0] is not None and v[0] < 4], 9, lambda q: True)
    none = rows.where("id < 0")
    assert topk_search.top_k(none, rows).count() == 0 and topk_search.top_k(rows, none).count() == 0
