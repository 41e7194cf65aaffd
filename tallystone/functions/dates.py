"""Bank dates: parsing under a known order and reading the order off a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.text import strip

# The time suffix, and the shapes a date may take once it is gone.
TIME_SUFFIX = r"[ T]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
NUMERIC = r"^(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{2,4})$"
# How a date begins whose month has a name or whose day of one digit stands behind its year.
NAMED_OR_SHORT = r"(?U)^(?:[0-9]{1,4}[-/\s]|[A-Za-z]{3,9}\s+[0-9])"
YEAR_FIRST_SHORT_DAY = r"^\d{4}(?:-\d{1,2}-|/\d{1,2}/)\d\z"
# A year of four digits in front, with a day of two digits at most or any.
YEAR_LED = r"^\d{4}[/.\-]\d{1,2}[/.\-]\d{2,4}$"
YEAR_MONTH_DAY = r"^\d{4}(?:[/.\-]\d{1,2}[/.\-]\d{2}|-\d{1,2}-\d|/\d{1,2}/\d)\z"
# Two parts and a year; short years are in this century, long ones may begin with zeros.
YEAR_LAST = r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\z"
SHORT_YEAR = r"[/.\-]0{0,2}\d{2}$"
# Numeric dates with a year behind whose first or second part is above twelve.
FIRST_ABOVE_TWELVE = r"^(?:0?(?:1[3-9]|[2-9]\d)|[1-9]\d{2})[/.\-]\d{1,2}[/.\-]\d{2,4}$"
SECOND_ABOVE_TWELVE = r"^\d{1,3}[/.\-](?:1[3-9]|[2-9]\d)[/.\-]\d{2,4}$"
# What may be a date with a month in three letters, or in more.
NAMED_SHORT = (r"(?sU)^(?:[0-9]{1,2}(?:\s+[A-Za-z]{3}\s+[0-9]{4}|-[A-Za-z]{3}-[0-9]{2,4})"
               r"|[A-Za-z]{3}\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{4}\s+[A-Za-z]{3}\s+[0-9].*)$")
NAMED_LONG = (r"(?sU)^(?:[0-9]{1,2}\s+[A-Za-z]{4,9}\s+[0-9]{4}|[A-Za-z]{4,9}\s+[0-9]{1,2},\s+[0-9]{4}"
              r"|[0-9]{4}\s+[A-Za-z]{4,9}\s+[0-9].*)$")
# Each named shape and its year-month-day form; two-digit years turn at 69.
NAMED = [
    (r"^(\d{1,2})(?: ([A-Za-z]{3,9}) |-([A-Za-z]{3})-)(\d{4})$", "$4 $2$3 $1"),
    (r"^(?:([A-Za-z]{3,9}) (\d{1,2}),|([A-Za-z]{3}) (\d{1,2})) (\d{4})$", "$5 $1$3 $2$4"),
    (r"^(\d{1,2})-([A-Za-z]{3})-([0-5]\d|6[0-8])$", "20$3 $2 $1"),
    (r"^(\d{1,2})-([A-Za-z]{3})-(\d{2})$", "19$3 $2 $1"),
]

ISO, MONTH_FIRST, DAY_FIRST, AMBIGUOUS = "ISO", "MONTH_FIRST", "DAY_FIRST", "AMBIGUOUS"

# The functions below take text that ``clean`` has been applied to, so that a caller
# cleans each cell once and keeps the generated code small.


def clean(raw: Column) -> Column:
    return without_time(strip(raw))


def without_time(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, TIME_SUFFIX, "")).otherwise(text)


def _named_date(text: Column) -> Column:
    turned = F.regexp_replace(text, r"(?U)\s+", " ")
    for shape, year_first in NAMED:
        turned = F.regexp_replace(turned, shape, F.lit(year_first))
    return F.when(text.rlike(NAMED_SHORT), F.try_to_date(turned, "yyyy MMM d")).when(
        text.rlike(NAMED_LONG), F.try_to_date(turned, "yyyy MMMM d")
    )


def _numeric_date(text: Column, order: Column) -> Column:
    """All numeric shapes brought to year-month-day, then read once."""
    parts = F.translate(text, "/.", "--")
    first, year = F.substring_index(parts, "-", 1), F.substring_index(parts, "-", -1)
    second = F.substring_index(F.substring_index(parts, "-", 2), "-", -1)
    long_year = F.when(text.rlike(SHORT_YEAR), F.concat(F.lit("20"), F.right(year, F.lit(2)))).otherwise(
        F.lpad(year, 4, "0"))
    turned = F.when(order == DAY_FIRST, F.concat_ws("-", long_year, second, first)).otherwise(
        F.concat_ws("-", long_year, first, second))
    return (
        F.when(text.rlike(YEAR_MONTH_DAY), parts.try_cast("date"))
        .when(text.rlike(YEAR_LED), F.try_to_date(parts, "yyyy-M-d"))
        .when((order != AMBIGUOUS) & text.rlike(YEAR_LAST), turned.try_cast("date"))
    )


def parse_date(text: Column, order: Column) -> Column:
    """One date under the order of its column; null where it cannot be read."""
    return F.coalesce(_numeric_date(text, order), _named_date(text))


def date_error(text: Column, order: Column, parsed: Column) -> Column:
    """Why ``parsed`` is null; null where it is not."""
    return (
        F.when(parsed.isNotNull(), F.lit(None).cast("string"))
        .when(F.coalesce(text, F.lit("")) == "", "cannot parse an empty date")
        .when((order == AMBIGUOUS) & text.rlike(NUMERIC) & ~text.rlike(YEAR_LED),
              "date order is ambiguous")
        .otherwise("not a date")
    )


def describes_itself(text: Column) -> Column:
    """The shape of the text says which part is which."""
    return year_led(text) | reads_without_order(text)


def reads_without_order(text: Column) -> Column:
    """A date beside the numeric shapes that end in two digits: a day of one digit behind its year, or a named month."""
    return text.rlike(NAMED_OR_SHORT) & (
        (text.rlike(YEAR_FIRST_SHORT_DAY) & F.translate(text, "/", "-").try_cast("date").isNotNull())
        | _named_date(text).isNotNull())


def numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def year_led(text: Column) -> Column:
    return text.rlike(YEAR_LED)


def date_like(text: Column) -> Column:
    return numeric(text) | describes_itself(text)


def says_day_first(text: Column) -> Column:
    return F.coalesce(text.rlike(FIRST_ABOVE_TWELVE), F.lit(False))


def says_month_first(text: Column) -> Column:
    return F.coalesce(text.rlike(SECOND_ABOVE_TWELVE), F.lit(False))


def column_order(day_first: Column, month_first: Column, described: Column) -> Column:
    """Verdict for a column from its three pieces of evidence."""
    return (
        F.when(day_first & month_first, AMBIGUOUS)
        .when(day_first, DAY_FIRST)
        .when(month_first, MONTH_FIRST)
        .when(described, ISO)
        .otherwise(AMBIGUOUS)
    )


def month_series(start: Column, months: Column) -> Column:
    """Month starts stepped from the original date, clamped to each month's end."""
    return F.transform(F.sequence(F.lit(0), months - 1), lambda i: F.add_months(start, i))


def whole_months(start: Column, end: Column) -> Column:
    """Whole months in [start, end): how often one can step and stay within it."""
    rough = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when((rough > 0) & (F.add_months(start, rough) > end), rough - 1).otherwise(rough)
