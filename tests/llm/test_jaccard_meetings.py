"""What the Jaccard join holds and moves: texts hashed together, bitmaps, verification, rows that stay."""

import re
import tracemalloc

import numpy as np
import pytest

from convoeval.llm import jaccard


def test_texts_hashed_together_equal_texts_alone():
    texts = ["", " ", "a", "A b", "a b", "x" * 64, "x" * 65 + " y", "x" * 64 + "\x0by", "Ä b\tc d\x1ce f", "ä b\tc d\x1ce f"]
    texts += ["\n".join(f"w{(i * 7 + k) % 40}" for i in range(90)) for k in range(5)] + ["one  two\r\nthree four five", "a b\x00", "a b"]
    for n in (1, 4):
        together = [s.tolist() for s in jaccard.Shingler(n).all(texts)]
        assert together == [jaccard.Shingler(n)(t).tolist() for t in texts]
        for text, own in zip(texts, together):
            words = text.encode().lower().split()
            grams = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
            assert len(own) == len(grams) and own == sorted(own)
    assert together[3] == together[4] and together[8] != together[9]  # of letters, only A-Z are lower-cased


@pytest.mark.parametrize("percent", [40, 80, 85])
def test_bitmaps_rule_out_no_link(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for size in (1, 3, 60, 64, 65, 200, 500) * 2:
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for changed in (0, 0.05, 0.1, 0.3):
            x, m = base.copy(), rng.random(size) < changed
            x[m] = rng.integers(0, 1 << 63, m.sum())
            sets.append(np.unique(x[: max(1, int(size * rng.choice([1, 0.9])))]))
    ids = list(range(len(sets)))
    for side in (None, rng.integers(0, 2, len(ids)).tolist()):
        union, links = jaccard.Union(), 0
        found = jaccard.pairs_left(ids, [(len(s), jaccard.bitmap(s)) for s in sets], side, percent)
        for a, b in found:
            union.join(a, b)
        for i in ids:
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared) and (not side or side[i] != side[j]):
                    links += 1
                    assert union.root(i) == union.root(j)
        assert links and len(found) < len(ids)


def test_unrelated_sets_do_not_stay_in_a_cluster():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 300 + k).astype(np.uint64)) for k in range(40)]
    assert jaccard.pairs_left(list(range(40)), [(len(s), jaccard.bitmap(s)) for s in sets], None, 80) == []


def test_verification_of_long_sets_in_little_memory():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    sets = [np.sort(rng.permutation(base)[:3950]) for _ in range(300)]
    orders = jaccard.Orders(np.zeros(0, np.uint64), np.zeros(0, np.int64), 85)
    tracemalloc.start()
    found = jaccard.links_between(list(range(300)), sets, None, orders, 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 299
    assert peak < 50e6  # the postings of all tokens took more


def test_only_chosen_texts_are_numbered(spark):
    rows = [(k, f"one two three four five six seven {k}") for k in range(20)] + [(3, "others"), (None, "a b c")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Options(words=5, percent=80))
    lines = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    numbered = [i for i, line in enumerate(lines) if re.search(r"ArrowEvalPython \[number\(", line)]
    assert numbered
    for i in numbered:
        depth = len(re.match(r"[^\w]*", lines[i])[0])
        below = []
        for line in lines[i + 1 :]:
            if len(re.match(r"[^\w]*", line)[0]) <= depth:
                break
            below.append(line)
        assert any("Join" in line or "Union" in line or "isnull(doc_id" in line for line in below)
