"""Small tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = {"score": 7.0, "kept": "x", "piece": 3, "set": "s", "_t": "t", "component_id": -5, "rank": 9}


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["an", "er", "the", "ou", "st", "ti", "lo"]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.replace(" ", "  ", 1).split(" ")
    near[40] = "changed"
    line = prose(rng, 9)
    return [
        (1, base),
        (2**60 + 1, near[7] + " " + base),
        (2, " ".join(near)),
        (3, base.upper()),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one"),
        (8, "One two"),
        (8, "One two"),  # a repeated row
        (9, "one two three"),
        (None, base),
        (None, None),
        (10, "\n".join([line] * 6 + [prose(rng, 30)])),
        (11, "a b c d e " * 40),
        (12, "naïve café “quoted” 漢字 😀 é <|endoftext|> x y z\x1cw don't I'll 123,456 $$$ ###"),
        (13, prose(rng, 30_000)),  # very long
        (14, "x" * 50_000),  # one very long word
        (15, prose(rng, 200) + " | * # $ " * 60),
        (16, prose(rng, 64)),
        (17, prose(rng, 64)),
    ]


def documents(spark: SparkSession, rows=None, clashing: bool = True):
    rows = awkward_texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return df


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> list[str]:
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def out_of(key, classes: int, left: int) -> bool:
    return key is None or zlib.crc32(str(key).encode()) % classes == left


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    w, t = words(text), text or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered, seen, again = Counter(windows), set(), set(), 0
    for i, g in enumerate(windows):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    for x in t.split("\n"):
        if WORD.search(x):
            again += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), again, len(covered)


def shingles(text: str | None, n: int = 4) -> frozenset:
    w = lower(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def linked(rows, n: int = 4, percent: int = 85) -> Counter:
    """(key, size, component) of every row, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return Counter((k, len(sets[i]), min(least[root(i)], default=None)) for i, (k, _) in enumerate(rows))
