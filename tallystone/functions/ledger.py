"""Column expressions over a ledger row: labels, months, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.vocab import SPENDING_LABELS, UNKNOWN

MONEY = "decimal(28,2)"


def money_sum(amount: Column) -> Column:
    return F.sum(amount).cast(MONEY)


def sum_when(condition: Column, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast(MONEY)


def effective_label(confirmed="confirmed_label", suggested="suggested_label") -> Column:
    """A person's decision, else the categoriser's suggestion."""
    return F.coalesce(F.col(confirmed), F.col(suggested))


def month_start(day) -> Column:
    return F.trunc(day, "MM")


def month_key(day) -> Column:
    return F.date_format(day, "yyyy-MM")


def in_month(day: Column, year: int, month: int) -> Column:
    """Half-open month range on a plain column, so it reaches the scan as a filter."""
    first = f"{year:04d}-{month:02d}-01"
    return (day >= F.to_date(F.lit(first))) & (
        day < F.add_months(F.to_date(F.lit(first)), 1)
    )


def unclassified(label: Column) -> Column:
    return label.isNull() | (label == UNKNOWN)


def is_spending(label: Column) -> Column:
    return label.isin(SPENDING_LABELS)


def branch(label: Column) -> Column:
    """Report branch of a label; a label outside the taxonomy stops the report."""
    return (
        F.when(unclassified(label), "unclassified")
        .when(label == "INCOME", "income")
        .when(label == "TRANSFER", "transfers")
        .when(label == "REFUND", "refunds")
        .when(is_spending(label), "spending")
        .otherwise(
            F.raise_error(F.concat(label, F.lit(" is not a recognised transaction label")))
        )
    )


def sub_branch(label: Column) -> Column:
    """Second level: the category for spending, the reason for unclassified rows."""
    return (
        F.when(label.isNull(), "never_examined")
        .when(label == UNKNOWN, "examined_no_answer")
        .when(is_spending(label), label)
    )


def evidence_rank(label: Column, confirmed: Column) -> Column:
    """0 ASSUMED .. 3 SOURCED, so that the weakest child is a min()."""
    return F.when(~unclassified(label) & confirmed, 2).otherwise(0)


def evidence_name(rank: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(n) for n in ("ASSUMED", "DERIVED", "USER_CONFIRMED", "SOURCED")]),
        F.coalesce(rank, F.lit(0)) + 1,
    )


def needs_review(threshold: float | str) -> Column:
    """Nobody confirmed it, and no suggestion settles it.

    A suggestion without a confidence is not selected: the comparison is null.
    """
    return F.col("confirmed_label").isNull() & (
        F.col("suggested_label").isNull()
        | (F.col("suggested_label") == UNKNOWN)
        | (F.col("suggested_confidence") < F.lit(str(threshold)).cast("decimal(4,3)"))
    )


def queue_state() -> Column:
    """Why a row waits for review, in the queue's own words."""
    label = F.col("suggested_label")
    return (
        F.when(label.isNull(), "never examined")
        .when(label == UNKNOWN, "examined, no answer")
        .otherwise(
            F.concat_ws(" ", F.col("suggested_source"), label,
                        F.coalesce(F.col("suggested_confidence").cast("string"), F.lit("None")))
        )
    )


def half_even_ratio(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """Exact ratio rounded half to even; zero where there is nothing to divide by.

    Quotient and remainder are whole numbers, so a tie is seen as one.
    """
    whole = "decimal(38,0)"
    scaled = F.abs(numerator.cast(whole)) * F.lit(10**places).cast("decimal(9,0)")
    scaled, d = scaled.cast(whole), F.nullif(F.abs(denominator.cast(whole)), F.lit(0).cast(whole))
    rest = (scaled % d).cast(whole)
    quotient = ((scaled - rest).cast(whole) / d).cast("decimal(28,0)")
    twice = (rest * 2).cast(whole)
    up = (twice > d) | ((twice == d) & (quotient % 2 == 1))
    negative = (numerator < 0) != (denominator < 0)
    value = (quotient + F.when(up, 1).otherwise(0)) * F.lit("0." + "0" * (places - 1) + "1" if places else "1").cast(
        f"decimal(9,{places})"
    )
    return F.coalesce(F.when(negative, -value).otherwise(value), F.lit(0)).cast(
        f"decimal(18,{places})"
    )
