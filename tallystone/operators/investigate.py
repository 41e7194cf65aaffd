"""Charges under investigation: duplicate candidates, period changes, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.ledger import MONEY, money_sum
from tallystone.vocab import POLICY_ID, POLICY_TERMS, POLICY_THRESHOLD

WINDOW_MINUTES = 5  # fixed value
SAME = ["merchant", "amount", "posted_on"]


def duplicate_minutes(charges: DataFrame) -> DataFrame:
    """Pairs of minutes, one to five apart, that hold the same charge.

    All charges of one minute are one row here with their number, so a charge repeated a
    million times in a minute costs one row and its pairs are n_left * n_right. Each
    minute looks up its five followers by equality; nothing is compared pairwise.
    """
    minutes = charges.groupBy(*SAME, "minute_of_day").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"),
        F.min_by("id", "seq").alias("first_id"),
    )
    ahead = minutes.select(
        *SAME, F.col("minute_of_day").alias("minute_left"), F.col("n").alias("n_left"),
        F.col("first_seq").alias("seq_left"), F.col("first_id").alias("id_left"),
        F.explode(F.sequence(F.lit(1), F.lit(WINDOW_MINUTES))).alias("minutes_apart"),
    ).withColumn("minute_right", F.col("minute_left") + F.col("minutes_apart"))
    later = minutes.select(
        *SAME, F.col("minute_of_day").alias("minute_right"), F.col("n").alias("n_right"),
        F.col("first_seq").alias("seq_right"), F.col("first_id").alias("id_right"),
    )
    return ahead.join(later, [*SAME, "minute_right"])


def duplicate_pairs(charges: DataFrame) -> DataFrame:
    """Each charge with every later minute that repeats it: how many, and the first one.

    Where a minute holds one charge, the usual case, the row is the pair itself; more
    are the ``partners`` in that minute, so nothing is lost and nothing is squared.
    """
    pairs = duplicate_minutes(charges).select(
        *SAME, F.col("minute_left").alias("minute_of_day"), "minutes_apart",
        F.col("n_right").alias("partners"), F.col("id_right").alias("first_partner"),
    )
    return charges.select("id", *SAME, "minute_of_day").join(pairs, [*SAME, "minute_of_day"])


def duplicate_members(charges: DataFrame) -> DataFrame:
    """Charges that stand in any pair, with their partners on both sides."""
    both = duplicate_minutes(charges)

    def side(mine, other):
        return both.select(
            *SAME, F.col(f"minute_{mine}").alias("minute_of_day"), F.col(f"n_{other}").alias("n"),
            F.struct(F.col(f"seq_{other}").alias("seq"), F.col(f"id_{other}").alias("id")).alias("f"),
        )

    per_minute = side("left", "right").unionByName(side("right", "left")).groupBy(
        *SAME, "minute_of_day"
    ).agg(F.sum("n").alias("partners"), F.min("f").alias("first"))
    return charges.join(per_minute, [*SAME, "minute_of_day"]).select(
        "seq", "id", "period", *SAME, "partners", F.col("first.seq").alias("partner_seq"),
        F.col("first.id").alias("partner_id"),
    )


def first_pair(members: DataFrame, keys: list[str]) -> DataFrame:
    """The first pair in source order.

    The smallest sequence number in any pair must be a left side, and its smallest
    partner its right side.
    """
    return members.groupBy(*keys).agg(
        F.min(F.struct("seq", "partner_seq", "id", "partner_id")).alias("p"),
        F.count("*").alias("members"),
    ).select(*keys, F.col("p.id").alias("left_id"), F.col("p.partner_id").alias("right_id"), "members")


def period_summary(charges: DataFrame, keys: list[str]) -> DataFrame:
    """Total per period beside the period before it that has charges."""
    order = W.partitionBy(*keys).orderBy("period")
    per = charges.groupBy(*keys, "period").agg(money_sum(F.col("amount")).alias("total"))
    return per.select(
        *keys, "period", "total", F.lag("period").over(order).alias("prior_period"),
        F.lag("total").over(order).alias("prior"),
    ).withColumn("change", (F.col("total") - F.col("prior")).cast(MONEY))


def signed_drivers(charges: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Merchants behind each change: this period minus the prior one, zero moves left out.

    Each merchant total serves its own period and, as the past, the period that follows.
    """
    per = charges.groupBy(*keys, "period", "merchant").agg(F.sum("amount").alias("amount"))
    changed = summary.filter("prior_period is not null").select(*keys, "period", "prior_period")
    now = per.join(changed, [*keys, "period"]).select(*keys, "period", "merchant", "amount")
    past = per.withColumnRenamed("period", "prior_period").join(changed, [*keys, "prior_period"]).select(
        *keys, "period", "merchant", (-F.col("amount")).alias("amount")
    )
    return (
        now.unionByName(past).groupBy(*keys, "period", "merchant")
        .agg(money_sum(F.col("amount")).alias("delta")).filter("delta <> 0")
    )


def policy_breaks(charges: DataFrame, threshold: str = POLICY_THRESHOLD) -> DataFrame:
    """Charges above the threshold without a receipt."""
    return charges.filter(
        (F.col("amount") > F.lit(threshold).cast("decimal(18,2)")) & ~F.col("receipt")
    ).withColumn("policy_id", F.lit(POLICY_ID))


def charge_context(charges: DataFrame, threshold: str = POLICY_THRESHOLD) -> DataFrame:
    over = F.col("amount") > F.lit(threshold).cast("decimal(18,2)")
    return charges.withColumn("policy_id", F.lit(POLICY_ID)).withColumn("over_threshold", over)


def policy_citations(queries: DataFrame, text: str) -> DataFrame:
    """The policy for each query that mentions one of its terms."""
    hit = F.lower(F.col(text)).rlike("|".join(POLICY_TERMS))
    return queries.filter(hit).withColumn("policy_id", F.lit(POLICY_ID))


def review_proposals(members: DataFrame, charges: DataFrame) -> DataFrame:
    """Proposals for duplicate candidates of the latest period; nothing is changed."""
    latest = charges.agg(F.max("period").alias("period"))
    return members.join(latest, "period", "left_semi").select(
        F.concat(F.lit("REVIEW-"), F.col("id")).alias("proposal_id"), F.col("id").alias("charge_id"),
        F.lit("possible_duplicate").alias("reason"), F.lit("proposal_only").alias("status"),
    )
