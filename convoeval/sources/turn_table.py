"""Conversation texts from a table that holds one row per turn."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the roles of a turn table are printed.
SPEAKERS = {"user": "Customer", "assistant": "Agent"}
# Turns that are joined to one text before the pieces of a conversation meet.
PIECE = 1024
# Conversations of more than one piece that are broadcast by their keys; more take a shuffle.
MOST_LONG = 200_000


def _with_line_breaks(text: Column, line_break: str) -> Column:
    """Every kind of line break as ``line_break``. Plain replacement is faster than a regex."""
    for found in ("\r\n", "\r"):
        text = F.replace(text, F.lit(found), F.lit("\n"))
    return text if line_break == "\n" else F.replace(text, F.lit("\n"), F.lit(line_break))


def conversations_from_turns(
    turns: DataFrame, line_break: str = " ", speakers: Mapping[str, str] = SPEAKERS
) -> DataFrame:
    """``conv_id, turn, role, text`` rows as ``conversation_id, company, conversation``.

    Each turn becomes one line: a newline inside a turn would begin a turn of the other
    speaker, so ``line_break`` takes its place (a newline keeps it). A system turn names
    the company with its first word: no system turn gives a null company, and one that
    does not begin with a plain letter gives a blank company. Every other turn is spoken:
    ``speakers`` says how its role is printed, and a role that is not in there is printed as
    it is (a missing one as ``Unknown``). A turn without text is an empty line of its speaker.
    A conversation of system turns only has nothing to show and no row.

    A conversation may hold a large share of all turns. Turns are therefore joined to text
    in pieces of ``PIECE`` turns first, which spreads a long conversation over many tasks,
    and the pieces are joined to the conversation: its task handles few large strings, and
    not more text than the one value that it writes. Most conversations are one piece: a pass
    over the keys of turns numbered outside ``[0, PIECE)`` finds the others, and if there are
    at most ``MOST_LONG`` of them their keys are broadcast, so that only their pieces meet in a
    second shuffle; one-piece conversations are done after the first. A null turn counts as 0.
    """
    speaker = F.coalesce("role", F.lit("Unknown"))
    for role, name in speakers.items():
        speaker = F.when(F.col("role") == role, name).otherwise(speaker)
    said = F.concat(speaker, F.lit(": "), _with_line_breaks(F.coalesce("text", F.lit("")), line_break))
    prepared = turns.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / PIECE).alias("piece"),
        "turn",
        F.when(~F.col("role").eqNullSafe(F.lit("system")), said).alias("line"),
        F.when(F.col("role") == "system", F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("company"),
    )
    # collect_list skips the null structs of turns that are not spoken.
    line = F.when(F.col("line").isNotNull(), F.struct("turn", "line"))
    pieces = (
        prepared.groupBy("conversation_id", "piece")
        .agg(F.max("company").alias("company"), F.array_sort(F.collect_list(line)).alias("lines"))
        .select("conversation_id", "company", "piece", F.col("lines.line").alias("lines"))
    )
    long_ids = (
        turns.filter((F.col("turn") >= PIECE) | (F.col("turn") < 0))
        .select(F.col("conv_id").cast("string").alias("_long"))
        .distinct()
    )
    if long_ids.count() > MOST_LONG:
        return _joined(pieces)
    ids = F.broadcast(long_ids)
    is_long = F.col("conversation_id").eqNullSafe(F.col("_long"))
    single = (
        pieces.join(ids, is_long, "left_anti")
        .filter(F.size("lines") > 0)
        .select("conversation_id", "company", F.array_join("lines", "\n").alias("conversation"))
    )
    return single.unionByName(_joined(pieces.join(ids, is_long, "left_semi")))


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of text to one conversation each, in the order of the pieces."""
    text = F.when(F.size("lines") > 0, F.struct("piece", F.array_join("lines", "\n").alias("text")))
    return (
        pieces.groupBy("conversation_id")
        .agg(F.max("company").alias("company"), F.array_sort(F.collect_list(text)).alias("texts"))
        .filter(F.size("texts") > 0)
        .select("conversation_id", "company", F.array_join("texts.text", "\n").alias("conversation"))
    )
