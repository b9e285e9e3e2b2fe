"""Agreement between judges, call statistics, distributions and histograms.

Every metric is an aggregate with few groups: rows are combined on the map side, so a label
or provider that holds most of the rows does not make a large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import normalise_label
from convoeval.operators.sampling import assert_unique_key

# The verdict labels in report order.
VERDICTS = ("true", "false")


def prediction_with_gold(
    predictions: DataFrame,
    gold: DataFrame,
    key: str = "conversation_id",
    prediction: str = "satisfied",
    gold_standard: str = "satisfied",
    check_keys: bool = False,
) -> DataFrame:
    """``key, prediction, gold_standard`` for keys that both tables have.

    A key that is not unique multiplies rows; ``check_keys`` raises then, at the cost of
    counting the keys of both tables.
    """
    if check_keys:
        assert_unique_key(predictions, key)
        assert_unique_key(gold, key)
    return predictions.select(key, F.col(prediction).alias("prediction")).join(
        gold.select(key, F.col(gold_standard).alias("gold_standard")), key, "inner"
    )


def exact_match(left: Column, right: Column) -> Column:
    """1 if two verdicts are the same label, else 0. Two missing verdicts match."""
    return (_label_or_none(left) == _label_or_none(right)).cast("int")


def _label_or_none(verdict: Column) -> Column:
    return F.coalesce(normalise_label(verdict), F.lit("none"))


def judged_true(verdict: Column) -> Column:
    """1 if a judge said true (in any case), else 0; no verdict is 0."""
    return F.coalesce(F.lower(verdict.cast("string")) == "true", F.lit(False)).cast("int")


def judged_transcript(predicted: Column, given: Column) -> Column:
    """The transcript to judge: the prediction's own if it has one, else the example's."""
    return F.coalesce(F.nullif(predicted, F.lit("")), F.nullif(given, F.lit("")))


def agreement_rate(pairs: DataFrame) -> DataFrame:
    """One row: pairs, and the share with equal verdicts (a missing verdict disagrees)."""
    same = F.coalesce(F.col("prediction") == F.col("gold_standard"), F.lit(False))
    return pairs.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg(same.cast("int")), 6).alias("agreement"),
    )


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Number of pairs per (gold_standard, prediction)."""
    return pairs.groupBy("gold_standard", "prediction").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """One row: observed and expected agreement and kappa of the pairs with both verdicts.

    Kappa is null if chance alone gives full agreement. Shares are multiplied as doubles:
    the product of two large counts does not fit a long.
    """
    # Pairs without a verdict are dropped by their count: a filter on the verdicts would be
    # pushed down and compute them a second time.
    both = F.col("prediction").isNotNull() & F.col("gold_standard").isNotNull()
    cells = pairs.groupBy("gold_standard", "prediction").agg(F.count_if(both).alias("n")).filter(F.col("n") > 0)
    # Each cell adds to the margins of two labels.
    margins = (
        cells.select(
            F.inline(
                F.array(
                    F.struct(
                        F.col("prediction").alias("label"),
                        F.col("n").alias("predicted"),
                        F.lit(0).cast("bigint").alias("gold"),
                        F.when(F.col("prediction") == F.col("gold_standard"), F.col("n")).otherwise(0).alias("same"),
                    ),
                    F.struct(
                        F.col("gold_standard").alias("label"),
                        F.lit(0).cast("bigint").alias("predicted"),
                        F.col("n").alias("gold"),
                        F.lit(0).cast("bigint").alias("same"),
                    ),
                )
            )
        )
        .groupBy("label")
        .agg(F.sum("predicted").alias("predicted"), F.sum("gold").alias("gold"), F.sum("same").alias("same"))
    )
    sums = margins.agg(
        F.sum("gold").alias("total"),
        F.sum("same").alias("same"),
        F.sum(F.col("predicted").cast("double") * F.col("gold").cast("double")).alias("by_chance"),
    )
    total = F.col("total").cast("double")
    shares = sums.select(
        F.coalesce("total", F.lit(0)).alias("total"),
        (F.col("same") / total).alias("observed"),
        (F.col("by_chance") / total / total).alias("expected"),
    )
    return shares.select(
        "total",
        F.round("observed", 6).alias("observed"),
        F.round("expected", 6).alias("expected"),
        F.when(
            F.col("expected") < 1,
            F.round((F.col("observed") - F.col("expected")) / (1 - F.col("expected")), 6),
        ).alias("kappa"),
    )


def verdict_distribution(df: DataFrame, field: str = "satisfied") -> DataFrame:
    """Rows and percent of all rows for ``true`` and ``false``, in this order.

    Other and missing labels count in the total only. A label without rows has no percent.
    """
    label = F.col(field).cast("string")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(label == v).alias(v) for v in VERDICTS)
    )
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(v).alias("satisfied"), F.col(v).alias("n"))
            for i, v in enumerate(VERDICTS)
        )
    )
    return counts.select("total", F.inline(rows)).select(
        "position",
        "satisfied",
        "n",
        F.when(F.col("n") > 0, F.round(100 * F.col("n") / F.col("total"), 1)).alias("percent"),
    )


def token_statistics(df: DataFrame, by: str | None = None) -> DataFrame:
    """Calls, failures and tokens of a table of answers, optionally per group.

    A call succeeded if it used input tokens. Each average is over the rows that used such
    tokens, and 0 if there are none.
    """
    used_in, used_out = F.col("input_tokens") > 0, F.col("output_tokens") > 0
    ok = F.count_if(used_in)

    def total(used: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(used, F.col(name))), F.lit(0)).cast("bigint")

    def average(used: Column, name: str) -> Column:
        return F.coalesce(F.round(F.avg(F.when(used, F.col(name))), 6), F.lit(0.0))

    return (df.groupBy(by) if by else df.groupBy()).agg(
        F.count(F.lit(1)).alias("total_examples"),
        ok.alias("successful_calls"),
        (F.count(F.lit(1)) - ok).alias("failed_calls"),
        total(used_in, "input_tokens").alias("total_input_tokens"),
        total(used_out, "output_tokens").alias("total_output_tokens"),
        average(used_in, "input_tokens").alias("avg_input_tokens"),
        average(used_out, "output_tokens").alias("avg_output_tokens"),
    )


def success_rate(df: DataFrame) -> DataFrame:
    """One row: rows, and the share of rows without an error."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.count_if(F.col("error").isNull()) / F.count(F.lit(1)), 6).alias("success_rate"),
    )


def throughput(answers: DataFrame) -> DataFrame:
    """One row: calls, seconds from the first start to the last end, calls per second.

    Expects the raw ``call`` column of ``infer``.
    """
    seconds = F.max("call.finished_at") - F.min("call.started_at")
    return answers.agg(F.count("call.started_at").alias("calls"), seconds.alias("seconds")).withColumn(
        "calls_per_second", F.when(F.col("seconds") > 0, F.col("calls") / F.col("seconds"))
    )


def histogram(df: DataFrame, value: str, low: float, width: float) -> DataFrame:
    """Rows per bin of equal width; bin 0 begins at ``low``. Missing values are left out."""
    bin_number = F.floor((F.col(value).cast("double") - float(low)) / float(width)).cast("bigint")
    # Missing values are dropped by their count: a filter on the value would be pushed down
    # and compute the value a second time.
    return (
        df.groupBy(bin_number.alias("bin"))
        .agg(F.count(bin_number).alias("n"))
        .filter(F.col("n") > 0)
        .withColumn("bin_start", float(low) + F.col("bin") * float(width))
    )


def metric_score(df: DataFrame, metric: Column, *by: str) -> DataFrame:
    """Examples and the mean of a 0/1 metric as a percent, optionally per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"), F.round(100 * F.avg(metric), 6).alias("score")
    )
