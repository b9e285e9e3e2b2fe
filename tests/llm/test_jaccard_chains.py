"""Passages that many texts share must not bring unrelated texts together."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convoeval.llm import jaccard
from llm_data import documents, linked, prose


def test_chained_passages_do_not_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(31)
    passages = [prose(rng, 10) for _ in range(30)]
    rows = [(i, " ".join([prose(rng, 40), passages[i % 30], prose(rng, 40), passages[(i + 1 + i // 30) % 30]])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 10)]
    met, dealt = jaccard._met, []

    def counted(sets, *others):
        dealt.append(sets.agg(F.sum("blocks")).first()[0] or 0)
        return met(sets, *others)

    monkeypatch.setattr(jaccard, "_met", counted)
    spread = documents(spark, rows).repartition(120)  # few tasks see a token often enough to know it as frequent
    assert Counter(map(tuple, jaccard.join(spread, jaccard.Options(few=3, block=20)).collect())) == linked(rows)
    assert sum(dealt) < 2 * len(rows), dealt  # each set of one chain came once for each of its blocks


@pytest.mark.parametrize("percent", [40, 80, 85])
def test_open_pairs_have_all_links(percent):
    rng, pairs = np.random.default_rng(percent), []
    for size in (1, 3, 60, 64, 65, 200, 500) * 4:
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for changed in (0, 0.05, 0.1, 0.3, 1):
            b, m = a.copy(), rng.random(len(a)) < changed
            b[m] = rng.integers(0, 1 << 63, m.sum())
            pairs.append((a, np.unique(np.concatenate([b, rng.integers(0, 1 << 63, size // 9).astype(np.uint64)]))))
    sides = list(zip(*pairs))
    left = jaccard.may_link(
        [np.array([len(s) for s in side]) for side in sides], [pd.Series([jaccard.bitmap(s) for s in side]) for side in sides], percent
    )
    shared = np.array([len(np.intersect1d(a, b)) for a, b in pairs])
    union = np.array([len(np.union1d(a, b)) for a, b in pairs])
    assert left[100 * shared >= percent * union].all()
    assert percent < 80 or not left[(shared == 0) & (union > 100)].any()


def test_words_that_are_rare_come_first():
    counts = np.zeros(jaccard.WORD_CELLS, np.int64)
    text = "the of the of the of the of in and the of rareword the of in and the of"
    next(jaccard.Shingler(4, counts).all([" ".join([text, "the of in and " * 50])]))
    levels = np.rint(np.log2(counts + 1)).astype(np.uint8)
    ((tokens, ranks),) = jaccard.Shingler(4).ranked([text], levels)
    assert tokens.tolist() == jaccard.Shingler(4)(text).tolist()
    orders = jaccard.Orders(np.zeros(0, np.uint64), np.zeros(0, np.int64), 85, levels)
    (prefix,) = orders.prefixes(tokens, (jaccard.RARE,), ranks)
    rare = {int(jaccard.Shingler(4)(" ".join(text.split()[i : i + 4]))[0]) for i in range(9, 13)}
    assert len(prefix) == 2 and set(prefix.tolist()) <= rare
    (later,) = orders.with_frequent(prefix[:1], np.array([9])).prefixes(tokens, (jaccard.RARE,), ranks)
    assert prefix[0] not in later and set(prefix[1:].tolist()) < set(later.tolist())
