from collections import Counter

import pytest
from convoeval.llm import lexical
from llm_data import awkward_texts, documents, prose

import random


def items():
    rng = random.Random(3)
    base = awkward_texts()[0][1]
    return [
        (0, " ".join(base.split()[10:20])),
        (1, "THE the ou ou"),  # upper case, repeats
        (2, None),
        (3, ""),
        (4, "naïve 漢字 😀 123"),
        (5, "nothing-here-at-all zzzz"),
        (6, prose(rng, 40)),
        (7, "x" * 50_000),
    ]


def run(spark, rows, asked, **options):
    q = spark.createDataFrame(asked, "item_id long, text string")
    out = lexical.search(documents(spark, rows), q, lexical.Options(**options))
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("options", [{}, {"block": 3, "slices": 64, "hashes": 2, "query_terms": 5}])
def test_equals_brute_force(spark, options):
    rows = awkward_texts()
    want = Counter(lexical.brute_force(rows, items()))
    assert run(spark, rows, items(), **options) == want


def test_ties_and_many_documents(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(300)] + [(1000 + i, "the the an") for i in range(30)]
    asked = [(0, "the an"), (1, "ou er st")]
    got = run(spark, rows, asked, block=16, slices=128)
    assert got == Counter(lexical.brute_force(rows, asked))
    assert max(r for _, r, _, _ in got) == 10


def test_empty_tables(spark):
    assert run(spark, [], items()) == Counter()
    assert run(spark, [(1, None), (2, "")], items()) == Counter()
    assert run(spark, awkward_texts(), []) == Counter()
