import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from convoeval.llm import lm
from convoeval.llm.elias_fano import BigramTrie, Monotone
from llm_data import awkward_texts, documents, lower, out_of

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]


def model(rows, discount=0.75):
    words, pairs, kinds = Counter(), Counter(), defaultdict(set)
    for k, t in rows:
        if not out_of(k, 7, 2):
            w = [*lower(t), " "]
            words.update(w)
            for a, b in zip([" ", *w], w):
                pairs[a, b] += 1
                kinds[a].add(b)
    total, v = sum(words.values()), len(words)

    def score(t):
        w, base, full = [*lower(t), " "], 0.0, 0.0
        for a, b in zip([" ", *w], w):
            p = (words[b] + 1) / (total + v + 1)
            base += math.log10(p)
            c = words[a]
            full += math.log10(max(pairs[a, b] - discount, 0) / c + discount * len(kinds[a]) / c * p if c else p)
        return len(w), sum(words[x] > 0 for x in w), total, base, full

    return score


@pytest.mark.parametrize(
    "options",
    [lm.Options(), lm.Options(block_tokens=500, shard_tokens=1000), lm.Options(block_tokens=3000, shard_tokens=300, hot_share=0.01)],
)
def test_equals_the_plain_model(spark, options):
    rows = awkward_texts()
    score, expected = model(rows), defaultdict(list)
    for k, t in rows:
        expected[(k, out_of(k, 7, 2), *score(t)[:3])].append(score(t)[3:])
    got = defaultdict(list)
    for r in lm.score(documents(spark), options).collect():
        got[tuple(r[c] for c in COLUMNS)].append((r["base_score"], r["score"]))
    assert got.keys() == expected.keys()
    for k in expected:
        for (base, full), (b, f) in zip(sorted(expected[k]), sorted(got[k])):
            assert b == pytest.approx(base, rel=1e-12)
            assert f == pytest.approx(full, abs=0.03 * k[2])  # a token's code is off by half a level at most


def test_nothing_to_learn_from(spark):
    held = [(k, "some text") for k in range(60) if out_of(k, 7, 2)]
    for r in lm.score(documents(spark, held)).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(documents(spark, [])).collect() == []


@pytest.mark.parametrize("top", [0, 5, 10_000, 2**52])
def test_monotone_sequences(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 700):
        values = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
        raw = b"xx" + Monotone.encode(values)
        m, end = Monotone.open(raw, 2)
        assert end == len(raw) and m[np.arange(n)].tolist() == values.tolist()
        x = np.concatenate([values, rng.integers(0, top + 2, 200).astype(np.uint64)])
        assert m.successor(x).tolist() == np.searchsorted(values, x).tolist()


def test_trie_finds_its_pairs_and_no_others():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    a, b = (np.array(x, np.uint64) for x in zip(*pairs))
    contexts, first = np.unique(a, return_index=True)
    raw = BigramTrie.encode(contexts, first, b, np.zeros(len(contexts)), np.arange(len(b)) % 254)
    trie = BigramTrie(raw)
    asked = np.array([(x, y) for x in range(62) for y in range(62)], np.uint64)
    found = trie.find(trie.find_contexts(asked[:, 0]), asked[:, 1])
    where = {p: i for i, p in enumerate(pairs)}
    assert found.tolist() == [where.get((int(x), int(y)), -1) for x, y in asked]
