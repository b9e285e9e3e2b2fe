import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from convoeval.llm import packing, token_store
from convoeval.llm.shared import work_folder
from llm_data import awkward_texts, documents
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoded():
    t = Tokenizer.from_file(PATH)
    return [(k, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")) for k, x in awkward_texts()]


def test_store_and_keyed_access(spark, encoded):
    folder = work_folder(spark, "tokens-test")
    written = token_store.write_shards(documents(spark), folder, PATH, 2)
    indexed = token_store.write_index(written, folder)
    bases = token_store.shard_bases(written)
    asked = spark.createDataFrame([(7,), (8,), (12345,), (-3,)], "doc_id long")
    found = token_store.read_documents(token_store.look_up(asked, indexed, folder), bases, folder).collect()
    assert sorted(r["doc_id"] for r in found) == ["7", "8", "8"]
    whole = token_store.write_and_read(documents(spark), work_folder(spark, "tokens-test"), PATH).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in whole) == Counter(
        (k, len(i), zlib.crc32(i.tobytes())) for k, i in encoded
    )
    rows = sorted(whole, key=lambda r: r["start"])
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert token_store.write_and_read(documents(spark, []), work_folder(spark, "tokens-test"), PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal_and_survives_its_bytes(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    built = token_store.PerfectHash.build(keys)
    again, used = token_store.PerfectHash.from_bytes(built.to_bytes())
    assert used == len(built.to_bytes())
    assert sorted(again(keys).tolist()) == list(range(len(keys)))
    others = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    assert (again(others) < max(1, len(keys))).all()


def test_keys_left_after_the_last_level_are_listed(monkeypatch):
    monkeypatch.setattr(token_store, "LEVELS", 1)
    keys = np.arange(1, 500, dtype=np.uint64) * np.uint64(7919)
    built = token_store.PerfectHash.build(keys)
    assert len(built.rest) and sorted(built(keys).tolist()) == list(range(len(keys)))


def pieces_of(ids, size):
    start, out = 0, []
    while start < len(ids):
        length = (len(ids) - start) % size or size
        out.append((len(out), start, length, zlib.crc32(ids[start : start + length].tobytes())))
        start += length
    return out


@pytest.mark.parametrize("size", [1024, 16])
def test_packing(spark, encoded, size):
    rows = packing.pack(documents(spark), PATH, size=size).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(
        (k, *p) for k, ids in encoded for p in pieces_of(ids, size)
    )
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert packing.pack(documents(spark, []), PATH).collect() == []


def best_fit_decreasing(histogram, size):
    """One piece after the other; returns how full each sequence is."""
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= length
            else:
                room.append(size - length)
    return len(room), sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_for_every_piece(seed):
    rng = np.random.default_rng(seed)
    size = 64
    histogram = {int(k): int(n) for k, n in zip(rng.permutation(np.arange(1, 65))[:20], rng.integers(1, 40, 20))}
    steps = packing.plan(histogram, size)
    filled, served = defaultdict(int), defaultdict(int)
    for s in steps:
        served[s.length] += s.last - s.first
        for q in range(s.sequence, s.sequence + s.last - s.first):
            assert filled[q] == s.offset
            filled[q] += s.length
    assert dict(served) == histogram
    expected, room = best_fit_decreasing(histogram, size)
    assert len(filled) == expected and sorted(size - f for f in filled.values()) == room


def test_plan_does_not_grow_with_counts():
    small, large = ({k: n * (1 + k % 5) for k in range(1, 1025)} for n in (10, 10_000_000))
    assert len(packing.plan(large, 1024)) < 3 * len(packing.plan(small, 1024))
