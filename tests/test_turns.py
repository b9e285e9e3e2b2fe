import pytest
from table_values import column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import models
from convoeval.operators.turns import parse_turns, truncate_table, truncation_statistics, turn_count
from convoeval.sources.turn_table import conversations_from_turns

QUICK = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
LINES = st.sampled_from(
    ["Customer: q", " User:  x ", "Agent: a:b", "\tSupport:", "plain", "customer: low", "", "  ", " Agent: s", "x: Customer: y", "\rUser: r"]
)
TEXTS = st.lists(st.lists(LINES, max_size=9).map("\n".join), min_size=1, max_size=40)


def conversations(spark, texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "k int, conversation_id string, conversation string")


def parsed(spark, texts):
    df = conversations(spark, texts).select("k", parse_turns(F.col("conversation")).alias("t"))
    return [None if ts is None else [(t["role"], t["content"]) for t in ts] for ts in column(df, "t")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Customer: hi\nSupport: a:b", [("customer", "hi"), ("agent", "a:b")]),
        ("x\ny\nCustomer: z\nw", [("customer", "x"), ("agent", "y"), ("customer", "z"), ("agent", "w")]),
        ("customer: hi", [("customer", "customer: hi")]),
        ("", []),
        ("\n \n", []),
        (None, None),
    ],
)
def test_parse_edges(spark, text, expected):
    assert parsed(spark, [text]) == [expected]


@QUICK
@given(TEXTS)
def test_parse_equals_model(spark, texts):
    assert parsed(spark, texts) == [models.turns(t) for t in texts]
    df = conversations(spark, texts).withColumn("n", turn_count(F.col("conversation")))
    assert column(df, "n") == [len(models.turns(t)) for t in texts]


@QUICK
@given(TEXTS, st.sampled_from([(1, None, True), (2, 0, True), (2, 4, False), (3, None, True), (0, 3, True)]))
def test_truncate_equals_model(spark, texts, setting):
    low, high, customer_last = setting
    df = truncate_table(
        conversations(spark, texts), 101, min_turns=low, max_turns=high, ensure_customer_last=customer_last
    )
    expected = [models.truncated(t, i, 101, low, high, customer_last) for i, t in enumerate(texts)]
    assert column(df, "truncated_conversation") == expected


def test_truncate_edges(spark):
    def cut(text, **options):
        return column(truncate_table(conversations(spark, [text]), **options), "truncated_conversation")[0]

    assert cut("User: q\nSupport: a", min_turns=2) == "User: q\nSupport: a"
    assert cut("Agent: a\nAgent: b\nAgent: c", min_turns=2, max_turns=2) == "Agent: a\nAgent: b"
    assert cut("User: q\nAgent: a\nAgent: b\nAgent: c", min_turns=3) == "Customer: q"
    assert cut(None) is None
    with pytest.raises(ValueError):
        cut("x", min_turns=3, max_turns=2)


def test_truncation_ignores_partitions(spark):
    texts = ["\n".join(f"line {j}" for j in range(i % 9)) for i in range(200)]
    source = conversations(spark, texts)
    results = [
        column(truncate_table(source.repartition(p), 5, min_turns=1), "truncated_conversation") for p in (1, 4, 17)
    ]
    assert results[0] == results[1] == results[2]


def test_statistics(spark):
    df = spark.createDataFrame([("a\nb\nc", "a"), ("a", "a")], "conversation string, truncated_conversation string")
    assert truncation_statistics(df).first().asDict() == {
        "avg_original_turns": 2.0, "avg_truncated_turns": 1.0, "avg_reduction": 1.0, "total_examples": 2
    }
    assert truncation_statistics(df.filter("false")).first()["avg_reduction"] is None


def test_long_conversation_is_parsed_in_linear_time(spark):
    """One conversation of 200,000 turns, half of them unlabelled."""
    text = "\n".join(f"Customer: q{i}" if i % 4 == 0 else f"t{i}" for i in range(200_000))
    df = truncate_table(conversations(spark, [text]), 101, min_turns=1)
    [got] = column(df, "truncated_conversation")
    assert got == models.truncated(text, 0, 101, 1, None, True)


def test_render_keeps_every_turn_of_a_hot_conversation(spark):
    rows = [(1 if i % 3 == 0 else i, i, "user" if i % 2 else "assistant", f"m{i}\nx") for i in range(9_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r["conversation_id"]: r["conversation"] for r in conversations_from_turns(turns).collect()}
    hot = [f"{'Customer' if t % 2 else 'Agent'}: {x.replace(chr(10), ' ')}" for c, t, _, x in rows if c == 1]
    assert got["1"].split("\n") == hot
    assert sum(len(v.split("\n")) for v in got.values()) == len(rows)


def test_every_role_but_system_is_spoken(spark):
    from convoeval.sources.turn_table import conversations_from_turns

    rows = [(1, 0, "system", "Acme x"), (1, 1, "customer", "a"), (1, 2, "agent", "b"), (1, 3, "tool", "c\nd"), (1, 4, None, "e")]
    rows += [(2, 0, "agent", None), (3, 0, "system", "Only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conversation_id"]: r["conversation"] for r in conversations_from_turns(turns).collect()}
    assert got == {"1": "customer: a\nagent: b\ntool: c d\nUnknown: e", "2": "agent: "}
    mapped = conversations_from_turns(turns, speakers={"customer": "Customer", "agent": "Agent"}).collect()
    assert {r["conversation"].split("\n")[0] for r in mapped} == {"Customer: a", "Agent: "}


def test_one_conversation_with_half_of_all_turns_both_ways(spark, monkeypatch):
    import convoeval.sources.turn_table as tt

    rows = [(1, i, "user" if i % 2 else "assistant", f"h{i}") for i in range(3_000)]
    rows += [(100 + i, 0, "user", f"s{i}") for i in range(2_990)]
    rows += [(5, None, "user", "null turn"), (5, 1, "assistant", "b"), (None, 0, "user", "no key"), (None, 2_000, "user", "far")]
    rows += [(6, -3, "user", "negative"), (6, 0, "assistant", "zero")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    fast = sorted(map(tuple, tt.conversations_from_turns(turns).collect()), key=str)
    monkeypatch.setattr(tt, "MOST_LONG", 0)
    slow = sorted(map(tuple, tt.conversations_from_turns(turns).collect()), key=str)
    assert fast == slow
    got = {r[0]: r[2] for r in fast}
    assert got["1"].split("\n") == [f"{'Customer' if i % 2 else 'Agent'}: h{i}" for i in range(3_000)]
    assert got["5"] == "Customer: null turn\nAgent: b" and got["6"] == "Customer: negative\nAgent: zero"
    assert got[None] == "Customer: no key\nCustomer: far"
    assert len(fast) == 2_990 + 4
