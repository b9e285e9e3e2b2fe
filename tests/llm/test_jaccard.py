import random
from collections import Counter

import numpy as np
import pytest
from convoeval.llm import jaccard
from convoeval.llm.components import Union, components
from convoeval.llm.shared import join_spread, work_folder
from llm_data import awkward_texts, documents, linked, prose


def joined(spark, rows, **options):
    return Counter(map(tuple, jaccard.join(documents(spark, rows), jaccard.Options(**options)).collect()))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = prose(rng, 1) + "q"
    return " ".join(out)


def group_of_copies(n=140):
    """Near and exact copies around the threshold, a passage that many texts share, frequent words."""
    rng = random.Random(9)
    base, passage = prose(rng, 160).split(), prose(rng, 60)
    rows = [(i, edited(rng, base, i % 9)) for i in range(n)]
    rows += [(1000 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40)) for i in range(60)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 40, 2)]
    rows += [(3000 + i, "the of and to " * (5 + i % 3)) for i in range(20)]
    rng.shuffle(rows)
    return rows


def test_awkward_rows(spark):
    assert joined(spark, awkward_texts()) == linked(awkward_texts())
    assert joined(spark, []) == Counter()


@pytest.mark.parametrize("options", [{}, {"few": 3, "block": 20, "counted": 3000, "shard_rows": 4000, "bloom_bits": 1 << 12}])
def test_copies_by_comparing_all_pairs(spark, options):
    rows = group_of_copies()
    expected = linked(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 50
    assert joined(spark, rows, **options) == expected
    assert joined(spark, rows, **options, words=5, percent=80) == linked(rows, 5, 80)


def test_every_order_keeps_every_link():
    rng = np.random.default_rng(3)
    orders = jaccard.Orders(np.arange(0, 400, 7, dtype=np.uint64), np.arange(58), 85)
    for _ in range(300):
        a = np.unique(rng.integers(0, 500, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 500, 3).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert all(len(np.intersect1d(orders.prefix(a, k), orders.prefix(b, k))) for k in range(3))


@pytest.mark.parametrize("trial", range(20))
def test_links_of_a_cluster_connect_what_all_pairs_connect(trial):
    rng = np.random.default_rng(trial)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    orders = jaccard.Orders(np.sort(draw(50)), rng.integers(3, 99, 50), 85)
    bases = [np.unique(draw(rng.integers(5, 80))) for _ in range(4)]
    sets = []
    for _ in range(40):
        base = bases[rng.integers(0, 4)]
        kept = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])]
        sets.append(np.unique(np.concatenate([kept, draw(rng.integers(0, 4))])))
    sets = [s for s in sets if len(s)]
    side = rng.integers(0, 2, len(sets)).tolist() if trial % 2 else None
    got, expected = Union(), Union()
    for a, b in jaccard.links_between(list(range(len(sets))), sets, side, orders, 85):
        got.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if (not side or side[i] != side[j]) and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                expected.join(i, j)
    assert [got.root(i) for i in range(len(sets))] == [expected.root(i) for i in range(len(sets))]


def test_one_of_each_group_stays(spark):
    rows = group_of_copies()
    kept = jaccard.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in linked(rows)})
    left = jaccard.keep_one(documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c d"), (3, None), (4, "")]))
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, None, 3, 4])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(df, work_folder(spark, "components-test")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1201)}, 5000: 5000, 5001: 5000}
    none = components(df.filter("false"), work_folder(spark, "components-test"))
    assert none.collect() == []


def test_spread_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)] + [(None, -1)], "k long, x long")
    values = spark.createDataFrame([(1, "a"), (6, "b")], "k long, v string")
    got = Counter(map(tuple, join_spread(rows, values, "k").select("k", "x", "v").collect()))
    assert got == Counter(map(tuple, rows.join(values, "k", "left").select("k", "x", "v").collect()))
