"""Why spending changed: labelled periods, merchant drivers, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.ledger import (
    MONEY, is_spending, money_sum, month_key, month_start, sum_when, unclassified,
)
from tallystone.operators.reports import with_previous_month

PERIOD_SUMS = [
    "gross_spending", "refunds", "net_spending", "unclassified_debits", "transfer_debits",
    "inconsistent_debits",
]


def spend_class(label: Column, amount: Column) -> Column:
    """First matching rule decides; a label outside the taxonomy stops the job."""
    return (
        F.when(unclassified(label), "unclassified")
        .when(label == "TRANSFER", "transfer")
        .when(is_spending(label) & (amount < 0), "spending")
        .when((label == "REFUND") & (amount > 0), "refund")
        .when((label == "INCOME") & (amount >= 0), "income")
        .when(is_spending(label) | label.isin("REFUND", "INCOME"), "inconsistent")
        .otherwise(
            F.raise_error(F.concat(label, F.lit(" is not a recognised transaction label")))
        )
    )


def spend_periods(ledger: DataFrame) -> DataFrame:
    label, amount = F.col("effective_label"), F.col("amount")
    kind, out = F.col("kind"), -F.col("amount")
    gross = sum_when(kind == "spending", out)
    refunds = sum_when(kind == "refund", F.col("amount"))
    suggested = ~unclassified(F.col("effective_label")) & F.col("confirmed_label").isNull()
    debit = F.col("amount") < 0
    return (
        ledger.withColumn("kind", spend_class(label, amount))
        .groupBy("tenant_id", "currency", month_start("posted_on").alias("month_start"))
        .agg(
            gross.alias("gross_spending"),
            refunds.alias("refunds"),
            (gross - refunds).cast(MONEY).alias("net_spending"),
            sum_when((kind == "unclassified") & debit, out).alias("unclassified_debits"),
            sum_when((kind == "transfer") & debit, out).alias("transfer_debits"),
            sum_when((kind == "inconsistent") & debit, out).alias("inconsistent_debits"),
            F.count_if(kind == "unclassified").alias("unclassified_rows"),
            F.count_if(suggested).alias("suggested_rows"),
            F.count_if(kind == "inconsistent").alias("inconsistent_rows"),
        )
    )


def period_change(periods: DataFrame) -> DataFrame:
    both = with_previous_month(periods, ["tenant_id", "currency"], ["net_spending"])
    return both.select(
        "tenant_id", "currency", month_key("month_start").alias("month"),
        F.col("previous_net_spending").alias("previous"),
        F.col("current_net_spending").alias("current"),
        (F.col("current_net_spending") - F.col("previous_net_spending")).cast(MONEY).alias("delta"),
    )


def spend_evidence(ledger: DataFrame) -> DataFrame:
    """The rows behind the drivers with what each contributes; refunds count negative."""
    return (
        ledger.withColumn("kind", spend_class(F.col("effective_label"), F.col("amount")))
        .filter(F.col("kind").isin("spending", "refund"))
        .select(
            "tenant_id", "currency", "merchant", "id", "posted_on",
            (-F.col("amount")).cast("decimal(18,2)").alias("contribution"),
            F.col("effective_label").alias("label"),
            F.col("confirmed_label").isNotNull().alias("confirmed"),
        )
    )


def merchant_drivers(ledger: DataFrame) -> DataFrame:
    monthly = (
        spend_evidence(ledger)
        .groupBy("tenant_id", "currency", "merchant", month_start("posted_on").alias("month_start"))
        .agg(F.sum("contribution").alias("spend"))
    )
    return with_previous_month(monthly, ["tenant_id", "currency", "merchant"], ["spend"]).select(
        "tenant_id", "currency", "merchant", month_key("month_start").alias("month"),
        F.col("previous_spend").alias("previous"), F.col("current_spend").alias("current"),
        (F.col("current_spend") - F.col("previous_spend")).cast(MONEY).alias("delta"),
    )


def top_drivers(drivers: DataFrame, k: int) -> DataFrame:
    """Largest movements first, names break ties; the limit runs before the shuffle."""
    order = W.partitionBy("tenant_id", "currency", "month").orderBy(
        F.abs("delta").desc(), "merchant"
    )
    return (
        drivers.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("tenant_id", "currency", "month", "merchant", "delta", "position")
    )


def driver_breaks(change: DataFrame, drivers: DataFrame) -> DataFrame:
    """Months whose merchant deltas do not add up to the net change."""
    summed = drivers.groupBy("tenant_id", "currency", "month").agg(
        money_sum(F.col("delta")).alias("driver_delta")
    )
    return (
        change.join(summed, ["tenant_id", "currency", "month"], "full")
        .filter(F.coalesce("delta", F.lit(0)) != F.coalesce("driver_delta", F.lit(0)))
        .select("tenant_id", "currency", "month", "delta", "driver_delta")
    )
