"""Merchants that bill on a cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.ledger import MONEY, half_even_ratio
from tallystone.vocab import CADENCES

# Fewest charges, and tolerances in percent.
MIN_OCCURRENCES = 3
CADENCE_PERCENT = 25
REGULARITY_PERCENT = 35
AMOUNT_PERCENT = 25


def daily_charges(charges: DataFrame, keys: list[str]) -> DataFrame:
    """One row per merchant and day: how often it charged and one of the amounts.

    Partial sums run before the shuffle, so a merchant with a third of the ledger arrives
    as at most one row per calendar day and task.
    """
    return charges.filter("kind <> 'TRANSFER'").groupBy(*keys, "posted_on").agg(
        F.count("*").alias("charges"), F.min("amount").alias("amount")
    )


def day_gaps(charges: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("posted_on")
    return daily_charges(charges, keys).select(
        *keys, "posted_on", "charges",
        F.date_diff("posted_on", F.lag("posted_on").over(order)).alias("gap_days"),
    )


def _twice_median(values):
    """Twice the median of a sorted array, exact for integers and decimals."""
    size = F.size(values)
    return F.get(values, F.floor((size - 1) / 2).cast("int")) + F.get(
        values, F.floor(size / 2).cast("int")
    )


def recurring_charges(charges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recurring charges per merchant (or finer ``keys``).

    The arrays hold one entry per calendar day, whatever the number of charges: a
    merchant that charged twice on a day is out before any array is looked at. All
    tolerances are compared as integers or exact decimals, with nothing divided.
    """
    keys = keys or ["merchant"]
    grouped = (
        daily_charges(charges, keys).groupBy(*keys)
        .agg(F.max("charges").alias("busiest"), F.count("*").alias("occurrences"),
             F.sort_array(F.collect_list(F.struct("posted_on", "amount"))).alias("points"))
        .filter((F.col("busiest") == 1) & (F.col("occurrences") >= MIN_OCCURRENCES))
    )
    gaps = F.transform(
        F.sequence(F.lit(1), F.size("points") - 1),
        lambda i: F.date_diff(F.get("points", i)["posted_on"], F.get("points", i - 1)["posted_on"]),
    )
    shaped = (
        grouped.withColumn("gaps", gaps)
        .withColumn("gap2", _twice_median(F.sort_array("gaps")).cast("bigint"))
        .withColumn("amounts", F.transform("points", lambda p: p["amount"]))
        .withColumn("amount2", _twice_median(F.sort_array("amounts")))
        .withColumn("drift2", F.array_max(F.transform("gaps", lambda g: F.abs(g * 2 - F.col("gap2")))))
        .withColumn("latest", F.element_at("amounts", -1))
    )
    cadence = per_year = F.lit(None)
    for name, days, times in reversed(CADENCES):
        near = F.abs(F.col("gap2") - 2 * days) * 100 <= CADENCE_PERCENT * 2 * days
        cadence = F.when(near, name).otherwise(cadence)
        per_year = F.when(near, times).otherwise(per_year)
    regular = F.col("drift2") * 100 <= F.col("gap2") * REGULARITY_PERCENT
    wobble = F.array_max(F.transform("amounts", lambda a: F.abs(a * 2 - F.col("amount2"))))
    stable = wobble * 100 <= F.abs("amount2") * AMOUNT_PERCENT
    found = shaped.withColumn("cadence", cadence).withColumn("per_year", per_year).filter(
        regular & F.col("cadence").isNotNull() & stable
    )
    # 0.7 * min(n, 12) / 12 + 0.3 * (1 - drift / 0.35), over the common denominator 840
    depth = F.least(F.col("occurrences"), F.lit(12))
    score = half_even_ratio(
        F.lit(49) * depth * F.col("gap2") + F.lit(252) * F.col("gap2") - F.lit(720) * F.col("drift2"),
        F.lit(840) * F.col("gap2"),
    )
    return found.select(
        *keys, "cadence", "occurrences",
        (F.col("amount2") / 2).cast("decimal(20,3)").alias("typical_amount"),
        F.col("latest").alias("latest_amount"),
        (F.col("latest") * F.col("per_year")).cast(MONEY).alias("annual_cost"),
        F.least(score, F.lit("0.9900").cast("decimal(18,4)")).alias("confidence"),
        (F.col("latest") * 2 != F.col("amount2")).alias("price_changed"),
    )


def most_expensive(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.abs("annual_cost").desc(), "merchant").limit(k)
