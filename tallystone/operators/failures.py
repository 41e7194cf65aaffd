"""Where a categoriser fails, and how two runs differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.ledger import half_even_ratio
from tallystone.functions.text import crude_merchant, strip
from tallystone.vocab import UNKNOWN

# What counts as sure, unsure, and too short a description.
CONFIDENT = "0.80"
UNSURE = "0.60"
THIN_DESCRIPTION = 15


def polysemous_merchants(labelled: DataFrame) -> DataFrame:
    """Merchants with more than one gold label, by their first two words."""
    return (
        labelled.groupBy(crude_merchant(F.col("description")).alias("merchant_key"))
        .agg(F.count_distinct("gold").alias("labels"))
        .filter("labels > 1")
    )


def side_by_side(predictions: DataFrame, model: str, rules: str) -> DataFrame:
    """Both systems' answers on one row, in one aggregation instead of a self-join."""
    answer = F.struct("predicted", "confidence", "correct", "gold", "agreed")
    return (
        predictions.filter(F.col("system").isin(model, rules)).groupBy("transaction_id")
        .agg(F.max(F.when(F.col("system") == model, answer)).alias("m"),
             F.max(F.when(F.col("system") == rules, answer)).alias("r"))
        .filter("m is not null")
    )


def failure_rows(predictions: DataFrame, labelled: DataFrame, model: str, rules: str) -> DataFrame:
    """One row per (transaction, failure mode); modes overlap."""
    facts = labelled.select(
        "transaction_id", crude_merchant(F.col("description")).alias("merchant_key"),
        (F.length(strip(F.col("description"))) < THIN_DESCRIPTION).alias("thin"),
    )
    many = polysemous_merchants(labelled).select("merchant_key", F.lit(True).alias("polysemous"))
    both = side_by_side(predictions, model, rules).join(facts, "transaction_id").join(
        many, "merchant_key", "left"
    )
    abstained = F.col("m.predicted") == UNKNOWN
    wrong = ~F.col("m.correct") & ~abstained
    rules_right = F.coalesce(F.col("r.correct"), F.lit(False))
    modes = {
        "confident_but_wrong": wrong & (F.col("m.confidence") >= F.lit(CONFIDENT).cast("decimal(4,3)")),
        "abstention_would_have_been_better": wrong & (F.col("m.confidence") < F.lit(UNSURE).cast("decimal(4,3)")),
        "rules_right_model_wrong": wrong & rules_right & (F.col("r.predicted") != UNKNOWN),
        "model_right_rules_wrong": F.col("m.correct") & ~rules_right,
        "thin_description": wrong & F.col("thin"),
        "polysemous_merchant": wrong & F.coalesce("polysemous", F.lit(False)),
        "annotation_passes_disagreed": wrong & F.coalesce(~F.col("m.agreed"), F.lit(False)),
        "abstained": abstained,
    }
    named = F.array_compact(F.array(*[F.when(c, n) for n, c in modes.items()]))
    return both.select(
        "transaction_id", F.explode(named).alias("mode"), F.col("m.gold").alias("gold"),
        F.col("m.predicted").alias("predicted"),
    )


def failure_modes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode").agg(F.count("*").alias("rows"))


def failure_pairs(rows: DataFrame, k: int) -> DataFrame:
    """The label pairs behind each mode, most frequent first."""
    pairs = rows.filter(F.col("predicted") != UNKNOWN).groupBy("mode", "gold", "predicted").agg(
        F.count("*").alias("n")
    )
    order = W.partitionBy("mode").orderBy(F.col("n").desc(), "gold", "predicted")
    return pairs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def failure_summary(predictions: DataFrame, keys: list[str]) -> DataFrame:
    answered = F.col("predicted") != UNKNOWN
    right, wrong = answered & F.col("correct"), answered & ~F.col("correct")

    def mean(which):
        n = F.count_if(which)
        total = F.sum(F.when(which, (F.col("confidence") * 1000).cast("bigint")).otherwise(0))
        return F.when(n > 0, half_even_ratio(total, n * 1000))

    return predictions.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(answered).alias("answered"),
        F.count_if(right).alias("correct"), F.count_if(wrong).alias("wrong"),
        F.count_if(~answered).alias("abstained"),
        mean(right).alias("mean_confidence_right"), mean(wrong).alias("mean_confidence_wrong"),
    )


def label_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """F1 per label in two runs, only labels the benchmark contains."""
    b = before.select("label", F.col("support").alias("sb"), F.col("f1").alias("before"))
    a = after.select("label", F.col("support").alias("sa"), F.col("f1").alias("after"))
    return b.join(a, "label", "full").select(
        "label", F.coalesce("sb", "sa").alias("support"), "before", "after",
        (F.col("after") - F.col("before")).cast("decimal(18,4)").alias("delta"),
    ).filter("support > 0")


def macro_decomposition(before: DataFrame, after: DataFrame) -> DataFrame:
    """How much of a macro F1 move is better answers and how much a smaller denominator."""
    b = before.select("label", (F.col("f1") * 10000).cast("bigint").alias("fb"))
    a = after.select("label", (F.col("f1") * 10000).cast("bigint").alias("fa"))
    sums = b.join(a, "label", "full").agg(
        F.count("fb").alias("labels_before"), F.count("fa").alias("labels_after"),
        F.coalesce(F.sum("fb"), F.lit(0)).alias("sb"), F.coalesce(F.sum("fa"), F.lit(0)).alias("sa"),
        # at most the label space: a bounded list
        F.array_join(F.sort_array(F.collect_list(
            F.when(F.col("fa").isNull(), F.col("label")))), ",").alias("no_longer_predicted"),
    )
    unit = F.lit("0.0001").cast("decimal(9,4)")
    base = half_even_ratio(F.col("sb"), F.col("labels_before") * 10000)
    held = half_even_ratio(F.col("sa"), F.col("labels_before") * 10000)
    reported = half_even_ratio(F.col("sa"), F.col("labels_after") * 10000)
    return sums.select(
        "labels_before", "labels_after",
        (F.col("sb") * unit).cast("decimal(18,4)").alias("summed_before"),
        (F.col("sa") * unit).cast("decimal(18,4)").alias("summed_after"),
        base.alias("macro_before"), reported.alias("macro_after"), held.alias("macro_held"),
        (held - base).cast("decimal(18,4)").alias("gain_answers"),
        (reported - held).cast("decimal(18,4)").alias("gain_denominator"), "no_longer_predicted",
    )
