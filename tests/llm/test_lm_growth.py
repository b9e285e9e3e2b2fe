"""What the language model's shards do must not grow faster than the text."""

import numpy as np
import pandas as pd
import pytest

from convoeval.llm import lm
from convoeval.llm.elias_fano import BigramTrie, Monotone, _pack


@pytest.mark.parametrize("bits", [1, 7, 8, 31, 32, 38, 56, 57, 58, 61, 63, 64])
def test_packed_bits(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 2, 9, 64, 1000):
        values = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        one = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
        raw = _pack(values, bits)
        assert raw.tobytes() == np.packbits(one.ravel(), bitorder="little").tobytes() + bytes(8)
        low = Monotone(n, bits, raw, np.zeros(1, np.uint8))._low(np.arange(n))
        assert low.tolist() == (values & np.uint64((1 << bits) - 1)).tolist()


def test_successors_of_a_common_context_are_searched_by_halves(monkeypatch):
    rng, looked = np.random.default_rng(4), []
    common = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    context = np.arange(3000, dtype=np.uint64)
    successor = np.concatenate([common, rng.integers(0, 1 << 40, 2999).astype(np.uint64)])
    first = np.concatenate([[0], len(common) + np.arange(2999)])
    trie = BigramTrie(BigramTrie.encode(context, first, successor, np.zeros(3000), np.arange(len(successor)) % 254))
    low = Monotone._low
    monkeypatch.setattr(Monotone, "_low", lambda self, i: looked.append(len(i)) or low(self, i))
    place = np.repeat(np.arange(3000), np.diff(np.append(first, len(successor))))
    assert trie.find(place, successor).tolist() == list(range(len(successor)))
    assert (trie.find(place[: len(common)], common + np.uint64(1)) >= 0).sum() == np.isin(common + np.uint64(1), common).sum()
    assert len(looked) < 60  # one by one it took a look for each of thousands of successors


class Read:
    """Stands for a table; keeps the functions that are run on it."""

    def __init__(self):
        self.tasks = []

    def select(self, *_):
        return self

    def groupBy(self, *_):  # noqa: N802
        return self

    def mapInPandas(self, task, _):  # noqa: N802
        self.tasks.append(task)
        return self

    applyInPandas = mapInPandas  # noqa: N815


def test_a_block_sends_one_table_for_all_shards(tmp_path):
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(60)) for i in range(40)]
    batch = pd.DataFrame({"_key": [str(i) for i in range(40)], "_text": texts, "_out": [i % 7 == 2 for i in range(40)]})
    table = Read()
    lm.blocks(table, lm.Options(block_tokens=500), "doc_id", "text")
    cut = pd.concat(list(table.tasks[0](iter([batch]))))
    shards, width = 30, 4
    for make in (
        lambda t: lm.word_counts(t, shards, 1e9),
        lambda t: lm.pair_codes(t, str(tmp_path), 0.75, -9.0, shards, width, {}),
    ):
        table = Read()
        make(table)
        send, answer = table.tasks
        sent = list(send(iter([cut])))
        assert len(sent) == len(cut) and max(map(len, sent)) > shards // 2
        for _, rows in pd.concat(sent).groupby("shard"):
            got = answer(rows.copy())
            assert got["block"].dropna().tolist() == rows["block"].tolist()


def test_answers_do_not_depend_on_how_many_blocks_are_asked_together(tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 80)) for _ in range(60)]
    batch = pd.DataFrame({"_key": [str(i) for i in range(60)], "_text": texts, "_out": [i % 7 == 2 for i in range(60)]})
    table = Read()
    lm.blocks(table, lm.Options(block_tokens=400), "doc_id", "text")
    cut = pd.concat(list(table.tasks[0](iter([batch]))))
    table = Read()
    lm.pair_codes(table, str(tmp_path), 0.75, -9.0, 3, 4, {})
    send, answer = table.tasks
    sent, found = pd.concat(list(send(iter([cut])))), []
    for asked in (1, 700, 1 << 18):
        monkeypatch.setattr(lm, "ASKED", asked)
        found.append([answer(rows.copy()).drop(columns="contexts").values.tolist() for _, rows in sent.groupby("shard")])
        assert all(len(rows) > 1 for rows in found[-1])
    assert found[0] == found[1] == found[2]
