"""Parsing conversations into turns, truncating them, and truncation statistics.

Everything here is a per-row expression: one narrow stage, no shuffle, whatever the size
of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.draws import draw
from convoeval.functions.text import WS_CLASS, strip

# The labels that name a speaker, and how a turn is printed.
CUSTOMER_LABELS = ("Customer:", "User:")
AGENT_LABELS = ("Agent:", "Support:")
PRINTED = {"customer": "Customer: ", "agent": "Agent: "}

_LABELS = "|".join(CUSTOMER_LABELS + AGENT_LABELS)
# A newline that is followed by a labelled line. Each piece between two such newlines is
# one labelled line plus the unlabelled lines after it.
_BEFORE_LABEL = rf"\n(?=[{WS_CLASS}&&[^\n]]*+(?:{_LABELS}))"


def _starts_with_any(line: Column, labels: tuple[str, ...]) -> Column:
    hit = F.startswith(line, F.lit(labels[0]))
    for label in labels[1:]:
        hit = hit | F.startswith(line, F.lit(label))
    return hit


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda line: line != "")


def _turns_of_piece(piece: Column) -> Column:
    """Turns of one labelled line and its unlabelled followers.

    Unlabelled lines alternate speakers, so the j-th line of a piece has the role of the
    piece's label if j is even and the other role if j is odd. Text before the first label
    counts as a piece that the customer opens.
    """

    def one(line: Column, j: Column, agent_opens: Column) -> Column:
        labelled = _starts_with_any(line, CUSTOMER_LABELS + AGENT_LABELS)
        return F.struct(
            F.when((agent_opens.cast("int") + j) % 2 == 0, "customer").otherwise("agent").alias("role"),
            F.when(labelled, strip(F.substring(line, F.locate(":", line) + 1, F.length(line))))
            .otherwise(line)
            .alias("content"),
        )

    opener = F.coalesce(_starts_with_any(F.get(piece, F.lit(0)), AGENT_LABELS), F.lit(False))
    return F.transform(piece, lambda line, j: one(line, j, opener))


def parse_turns(text: Column) -> Column:
    """ARRAY<STRUCT<i, role, content>> of a conversation; null text gives null.

    Work is linear in the text: the text is cut at labelled lines and every piece is
    numbered by itself, so no growing array is copied turn by turn.
    """
    pieces = F.transform(F.split(text, _BEFORE_LABEL, -1), _lines)
    turns = F.flatten(F.transform(pieces, _turns_of_piece))
    return F.transform(
        turns,
        lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["content"].alias("content")),
    )


def turn_count(text: Column) -> Column:
    """Number of turns, without building them: the non-blank lines."""
    return F.size(_lines(text))


def print_turns(turns: Column) -> Column:
    """Turns as text, one ``Customer: ...`` or ``Agent: ...`` line each."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.when(t["role"] == "customer", PRINTED["customer"]).otherwise(PRINTED["agent"]),
                t["content"],
            ),
        ),
        "\n",
    )


def explode_turns(df: DataFrame, key: str = "conversation_id", field: str = "conversation") -> DataFrame:
    """One row per turn: key, i, role, content."""
    return df.select(key, F.inline(parse_turns(F.col(field))))


def truncate_table(
    df: DataFrame,
    seed: int = 42,
    key: str = "conversation_id",
    conversation_field: str = "conversation",
    min_turns: int = 2,
    max_turns: int | None = None,
    ensure_customer_last: bool = True,
    new_field_name: str = "truncated_conversation",
) -> DataFrame:
    """Cut every conversation at a seeded random turn.

    Texts of at most ``min_turns`` turns pass unchanged. Otherwise the cut is drawn from
    ``min_turns`` to the number of turns (or ``max_turns``; 0 and None mean no limit), and
    with ``ensure_customer_last`` moved back to the last customer turn before it, if any.
    """
    if min_turns < 0:
        raise ValueError("min_turns must not be negative")
    if max_turns and max_turns < min_turns:
        raise ValueError(f"max_turns ({max_turns}) is below min_turns ({min_turns})")

    text = F.col(conversation_field)
    n = F.size("_turns")
    hi = F.least(n, F.lit(max_turns)) if max_turns else n
    cut = F.when(
        n > min_turns, (F.lit(min_turns) + draw(seed, F.col(key)) % (hi - min_turns + 1)).cast("int")
    )
    # Each step is a projection of its own: the turns are used several times and must not
    # be parsed several times.
    out = df.withColumn("_turns", parse_turns(text)).withColumn("_cut", cut)
    if ensure_customer_last:
        customer_turns = F.filter(
            F.slice("_turns", F.lit(1), F.col("_cut")),
            lambda t: t["role"] == "customer",
        )
        last_customer = F.get(F.slice(customer_turns, -1, 1), F.lit(0))["i"] + 1
        out = out.withColumn("_cut", F.coalesce(last_customer, F.col("_cut")))
    kept = F.slice("_turns", F.lit(1), F.col("_cut"))
    return out.withColumn(
        new_field_name, F.when(n <= min_turns, text).otherwise(print_turns(kept))
    ).drop("_turns", "_cut")


def truncation_statistics(
    df: DataFrame,
    original_field: str = "conversation",
    truncated_field: str = "truncated_conversation",
) -> DataFrame:
    """One row: average turns before and after, average reduction, number of rows."""
    counts = df.select(
        turn_count(F.col(original_field)).cast("bigint").alias("o"),
        turn_count(F.col(truncated_field)).cast("bigint").alias("t"),
    )
    return counts.agg(
        F.round(F.avg("o"), 6).alias("avg_original_turns"),
        F.round(F.avg("t"), 6).alias("avg_truncated_turns"),
        F.round((F.sum("o") - F.sum("t")) / F.count("o"), 6).alias("avg_reduction"),
        F.count(F.lit(1)).alias("total_examples"),
    )


def pair_original_with_truncated(
    original: DataFrame,
    truncated: DataFrame,
    key: str = "conversation_id",
    original_field: str = "conversation",
    truncated_field: str = "truncated_conversation",
) -> DataFrame:
    """Original and truncated text of the same conversation, paired by key."""
    return original.select(key, original_field).join(
        truncated.select(key, truncated_field), key, "inner"
    )
