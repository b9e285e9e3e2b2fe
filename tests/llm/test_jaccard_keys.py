"""Rows without key, and rows that share one."""

import random
from collections import Counter

from convoeval.llm import jaccard
from llm_data import documents, linked, prose


def chain(words):
    """Texts of which each is near the next one but not the one after."""
    return [" ".join(words[i : i + 100]) for i in range(0, 15, 5)]


def test_keyless_near_copies_and_bridges(spark):
    rng = random.Random(21)
    a, b, c = (chain(prose(rng, 120).split()) for _ in range(3))
    rows = [(7, a[0]), (None, a[1]), (None, a[1]), (5, a[2])]  # keys 5 and 7 meet only through a keyless text
    rows += [(9, b[0]), (None, b[1])]
    rows += [(None, t) for t in c]
    expected = linked(rows)
    assert expected[(7, 97, 5)] == 1 and expected[(None, 97, 9)] == 1
    got = Counter(map(tuple, jaccard.join(documents(spark, rows), jaccard.Options()).collect()))
    assert got == expected


def test_one_keyless_row_of_a_component_stays(spark):
    rng = random.Random(22)
    a, b = (chain(prose(rng, 120).split()) for _ in range(2))
    rows = [(None, a[0]), (None, a[0]), (None, a[1]), (None, a[2]), (7, b[0]), (None, b[1]), (5, b[2]), (None, ""), (None, None)]
    kept = jaccard.keep_one(documents(spark, rows)).collect()
    # Beside a row with a key one without stays, as test_one_of_each_group_stays has it.
    assert Counter(r["doc_id"] for r in kept) == Counter({None: 4, 5: 1})
    texts = [r["text"] for r in kept if r["doc_id"] is None]
    assert sum(t in a for t in texts if t) == 1 and b[1] in texts


def test_different_texts_of_one_key_are_different_documents(spark):
    rng = random.Random(23)
    a, alone, other = chain(prose(rng, 120).split()), prose(rng, 80), prose(rng, 80)
    rows = [(1, a[0]), (2, a[1]), (2, alone), (2, alone), (3, other), (3, ""), (3, ""), (3, None), (4, "")]
    kept = jaccard.keep_one(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == Counter([(1, a[0]), (2, alone), (3, other), (3, ""), (4, "")])
