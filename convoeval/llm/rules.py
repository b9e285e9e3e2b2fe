"""Quality rules that vote, combined by weak supervision.

Each rule votes good, bad or abstains. What the rules' votes are worth is estimated without
labels: expectation-maximisation over the table of vote patterns finds how often each rule says
what on good and on bad documents, and every document gets the posterior probability that it is
good. Only DataFrame functions are used; the table of patterns is the sufficient statistic of
the model and has at most 3 ** rules rows, however many documents there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.llm.shared import SPACES, stored, work_folder

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_letters", "n_capitals", "n_exclaimed")
WINDOW = 5
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Votes BAD where ``bad`` holds, else GOOD where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


# The bounds leave a gap in which a rule abstains.
RULES = (
    Rule("length", "n_words < 10", "n_words >= 30"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars", "100 * n_symbols <= 1 * word_chars"),
    Rule("symbols_per_word", "10 * n_symbols > n_words", "20 * n_symbols <= n_words"),
    Rule("letters", "100 * n_letters < 80 * word_chars", "100 * n_letters >= 90 * word_chars"),
    Rule("lines", "n_dup_lines > 5 and 2 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("capitals", "10 * n_capitals > 4 * word_chars", "10 * n_capitals <= 2 * word_chars"),
    Rule("word_length", "word_chars > 15 * n_words or word_chars < 2 * n_words",
         "word_chars between 3 * n_words and 12 * n_words"),
    Rule("exclaimed", "10 * n_exclaimed > 3 * n_words", "20 * n_exclaimed <= n_words"),
)


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules need; all are 0 for a null or empty text.

    Words are runs of other characters than space and tab to carriage return. A word counts in
    ``n_repeat_words`` if it lies in a window of five words that occurs twice or more. Windows
    are compared by 64-bit hash within one text. Cost is n log n in the words of a text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = documents.drop(*COUNTS, *EXTRA).withColumn("__rules_t", body)
    df = df.withColumn("__rules_w", F.array_remove(F.split("__rules_t", SPACES), ""))
    df = df.withColumn("__rules_l", F.filter(F.split("__rules_t", "\n"), lambda x: F.length(_removed(x, WHITE)) > 0))
    df = df.withColumn("__rules_g", _windows(F.col("__rules_w")))
    # Only texts in which a window repeats are sorted: equal hashes then stand together.
    repeats = F.size(F.array_distinct("__rules_g")) < F.size("__rules_g")
    placed = F.transform("__rules_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__rules_o", F.when(repeats, F.array_sort(placed)))
    df = df.withColumn("__rules_p", F.array_sort(F.transform(F.filter("__rules_o", _has_twin), lambda x: x["i"])))
    inside = _removed(F.col("__rules_t"), WHITE)
    return df.select(
        *[c for c in df.columns if not c.startswith("__rules")],
        F.size("__rules_w").cast("long").alias("n_words"),
        F.length(inside).cast("long").alias("word_chars"),
        (F.length("__rules_t") - F.length(_removed(F.col("__rules_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__rules_l") - F.size(F.array_distinct("__rules_l"))).cast("long").alias("n_dup_lines"),
        _covered().alias("n_repeat_words"),
        F.size("__rules_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(inside, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(inside, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        (F.length("__rules_t") - F.length(_removed(F.col("__rules_t"), "!?"))).cast("long").alias("n_exclaimed"),
    )


def _windows(words: Column) -> Column:
    """The hash of every window of five words."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _has_twin(x: Column, k: Column) -> Column:
    """The window before or after it in the order of hashes has the same hash."""
    same = [F.coalesce(F.get(F.col("__rules_o"), k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
    return same[0] | same[1]


def _covered() -> Column:
    """Words in repeated windows: each covers five places, or fewer up to the next one."""
    steps = F.transform("__rules_p", lambda p, j: F.least(F.coalesce(F.get(F.col("__rules_p"), j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def votes(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``vote_<rule>``: 1 good, -1 bad, 0 abstains."""
    cast = {
        f"vote_{r.name}": F.when(F.expr(r.bad), BAD).when(F.expr(r.good), GOOD).otherwise(ABSTAIN) for r in rules
    }
    return counted.withColumns(cast)


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents, and of each rule the share of its votes on good and on bad
    documents that say bad."""

    good: float
    bad_on_good: tuple[float, ...]
    bad_on_bad: tuple[float, ...]

    def evidence(self, rule: int, vote: int) -> float:
        """What one vote adds to the log odds of being good; an abstention adds nothing."""
        g, b = self.bad_on_good[rule], self.bad_on_bad[rule]
        return {BAD: math.log(g / b), GOOD: math.log((1 - g) / (1 - b)), ABSTAIN: 0.0}[vote]

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        return math.log(self.good / (1 - self.good)) + sum(self.evidence(j, v) for j, v in enumerate(pattern))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 200) -> Accuracies:
    """Expectation-maximisation over counted vote patterns.

    Starts from the belief that a document with any bad vote is rather bad. Weak beliefs, worth a
    fiftieth of the documents, hold the classes to their meaning: rules call few good documents
    bad, and some of the bad ones. Without documents the beliefs themselves are returned.
    """
    total = sum(patterns.values())
    held = max(1.0, total / 50)
    good = {p: 0.1 if BAD in p else 0.95 for p in patterns}
    now = None
    for _ in range(rounds):
        g_all = sum(n * good[p] for p, n in patterns.items())
        share = (g_all + 0.9 * held) / (total + held)
        on_good, on_bad = [], []
        for j in range(rules):
            said = [[0.0, 0.0], [0.0, 0.0]]  # [class is bad][vote is bad]
            for p, n in patterns.items():
                if p[j] != ABSTAIN:
                    said[0][p[j] == BAD] += n * good[p]
                    said[1][p[j] == BAD] += n * (1 - good[p])
            on_good.append((said[0][1] + 0.02 * held) / (sum(said[0]) + held))
            on_bad.append((said[1][1] + 0.3 * held) / (sum(said[1]) + held))
        before, now = now, Accuracies(share, tuple(on_good), tuple(on_bad))
        if before and abs(before.good - now.good) < 1e-12:
            break
        good = {p: _sigmoid(now.log_odds(p)) for p in patterns}
    return now


def posterior(accuracies: Accuracies, rules: tuple[Rule, ...] = RULES) -> Column:
    """The probability that a document is good, from its vote columns."""
    odds = F.lit(math.log(accuracies.good / (1 - accuracies.good)))
    for j, r in enumerate(rules):
        vote = F.col(f"vote_{r.name}")
        odds = odds + F.when(vote == BAD, accuracies.evidence(j, BAD)).when(
            vote == GOOD, accuracies.evidence(j, GOOD)
        ).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(
    documents: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    threshold: float = 0.5,
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """Add the counts, ``base_failed``, ``posterior`` and ``kept`` to every document.

    The counts are computed once and stored in the shared folder with the other columns, with the
    text only if ``keep_text`` asks for it back; a first pass counts vote patterns, a second
    applies what was estimated from them. Columns of the added names are replaced. A null text has
    no words and fails the base rule, as does an empty one. Repeated rows and null keys stay; an
    empty table gives an empty one.
    """
    counted = counts(documents, text)
    counted = votes(counted if keep_text else counted.drop(text), rules)
    rated = stored(counted, work_folder(documents.sparkSession, "rules"))
    names = [f"vote_{r.name}" for r in rules]
    found = {tuple(r[n] for n in names): r["count"] for r in rated.groupBy(*names).count().collect()}
    accuracies = estimate(found, len(rules))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = rated.drop("posterior", "base_failed", "kept").withColumn("posterior", posterior(accuracies, rules))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
