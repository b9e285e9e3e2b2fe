import random
import re
from collections import Counter

import pytest
from convoeval.llm import divergence

TERM = re.compile(divergence.TERM)


def brute(rows, least=10, top=10):
    """All (group, kept term) cells in plain Python."""
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [((l or ""), (s or ""), TERM.findall((t or "").translate(low))) for t, l, s in rows]
    groups = sorted({(l, s) for l, s, _ in docs})
    out = []
    for lang in sorted({l for l, _ in groups}):
        df = Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        v = len(kept)
        count = {g: Counter(t for l, s, ts in docs if (l, s) == g for t in ts if t in set(kept)) for g in groups if g[0] == lang}
        lang_count = sum(count.values(), Counter())
        n = {g: sum(c.values()) for g, c in count.items()}
        nl = sum(n.values())

        def p(c, total):
            return 1 + (10**9 * (c + 2)) // (total + 2 * v)

        f = lambda a, b: ((a - b) ** 2) // (a + b)
        for g in count:
            pairs = []
            for h in count:
                if h != g and h[0] == lang:
                    value = sum(f(p(count[g][t], n[g]), p(count[h][t], n[h])) for t in kept) if v else 0
                    pairs.append((value, h[1]))
            pairs.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, g[1], "pair", s, value, r + 1) for r, (value, s) in enumerate(pairs)]
            terms = []
            for t in kept:
                a, b = p(count[g][t], n[g]), p(lang_count[t], nl)
                if count[g][t] > 0 and a > b:
                    terms.append((f(a, b), t))
            terms.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, g[1], "term", t, value, r + 1) for r, (value, t) in enumerate(terms[:top])]
    return Counter(out)


def table(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "Ωmega", "x1y", "zz", "qq", "rr", "ss", "tt", "uu"]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "de", None, "fr"])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "é"])
        text = " ".join(rng.choice(words[: rng.randint(2, 12)]) for _ in range(rng.randint(0, 30)))
        rows.append((text if i % 17 else None, lang, source))
    rows += [("", "solo", "s1"), ("only words here", "solo", "s2")]  # a language without kept terms
    rows += [rows[5]] * 5  # repeated rows
    return rows


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 3}, {"least_docs": 2, "top": 3, "bucket_rows": 5}])
def test_equals_brute_force(spark, options):
    rows = table()
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("doc_id", divergence.F.lit(1))
    o = divergence.Options(**options)
    got = Counter(map(tuple, divergence.audit(df.withColumn("value", divergence.F.lit("x")), o).collect()))
    assert got == brute(rows, o.least_docs, o.top)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0
