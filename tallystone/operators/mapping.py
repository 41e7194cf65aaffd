"""Working out which column of a bank file is which, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import dates
from tallystone.functions.text import AMOUNT_CHARACTERS, strip, strip_cell, stripped_amount
from tallystone.vocab import HEADER_ALIASES

FIELDS = ["date", "description", "merchant", "external_id", "amount", "debit", "credit"]


def canonical_header(header: Column) -> Column:
    kept = F.regexp_replace(F.lower(header), r"(?U)[^\p{L}\p{N}\s]", " ")
    return strip(F.regexp_replace(kept, r"(?U)\s+", " "))


def _alias_lookup(canonical: Column, part: int) -> Column:
    """Field (0) or preference rank (1) of a canonical header; null when it names nothing."""
    pairs = []
    for field, aliases in HEADER_ALIASES.items():
        for rank, alias in enumerate(aliases):
            pairs += [F.lit(alias), F.lit(field if part == 0 else rank)]
    return F.try_element_at(F.create_map(*pairs), canonical)


def header_fields(headers: DataFrame) -> DataFrame:
    """Every header with the field its name suggests and how preferred the name is."""
    return headers.select("file_id", F.posexplode("header").alias("position", "column")).select(
        "file_id", "position", "column",
        _alias_lookup(canonical_header(F.col("column")), 0).alias("field"),
        _alias_lookup(canonical_header(F.col("column")), 1).alias("rank"),
    )


def looks_like_reference(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^\p{Nd}]", "")
    return (
        ~F.contains(text, F.lit("."))
        & ~F.contains(text, F.lit(","))
        & ~(text.startswith("-") | text.startswith("("))
        & (F.length(digits) >= 9)
    )


def column_evidence(headers: DataFrame, records: DataFrame) -> DataFrame:
    """What the values of each column say, over all rows: dates, money, date order.

    Cells are judged where they are read and summed per file and place, so records meet
    no join, a file of any length is no one task's work, and headers meet one row a place.
    """
    cells = records.select("file_id", F.posexplode_outer("cells").alias("position", "cell")).select(
        "file_id", "position", strip_cell(F.coalesce("cell", F.lit(""))).alias("value"))
    seen = cells.select("*", dates.without_time(F.col("value")).alias("day"))
    # every date of digits that shows its order is of the numeric shape, and neither is an amount
    seen = seen.select("*", dates.numeric(F.col("day")).alias("numeric"))
    seen = seen.select("*", F.when(F.col("numeric"), dates.year_led(F.col("day"))).otherwise(
        dates.reads_without_order(F.col("day"))).alias("described"))
    text, numeric = F.col("value"), F.col("numeric")
    date_like = numeric | F.col("described")
    money = ~date_like & text.rlike(AMOUNT_CHARACTERS) & stripped_amount(text).isNotNull() & ~looks_like_reference(text)
    counts, signs = ["filled", "date_like", "money_like"], ["described", "day_first", "month_first"]
    counted = seen.select(
        "file_id", "position", (text != "").alias("filled"), date_like.alias("date_like"),
        money.alias("money_like"), "described",
        (numeric & dates.says_day_first(F.col("day"))).alias("day_first"),
        (numeric & dates.says_month_first(F.col("day"))).alias("month_first"),
    ).groupBy("file_id", "position").agg(
        *[F.count_if(c).alias(c) for c in counts], *[F.bool_or(c).alias(c) for c in signs])
    # one entry for each place of the file's longest record
    places = counted.groupBy("file_id").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("position").isNotNull(), F.struct("position", F.struct(*counts, *signs))))).alias("places"))
    facts = headers.join(places, "file_id").select(
        "file_id", "places", F.posexplode("header").alias("position", "column")
    ).select("file_id", "position", "column", F.try_element_at("places", F.col("position")).alias("at"))

    def most(name):
        return F.coalesce((F.col("at.filled") > 0) & (F.col(f"at.{name}") * 10 >= F.col("at.filled") * 7), F.lit(False))

    return facts.select(
        "file_id", "position", "column",
        most("date_like").alias("holds_dates"), most("money_like").alias("holds_money"),
        dates.column_order(*[F.col(f"at.{sign}") for sign in ("day_first", "month_first", "described")]).alias("date_order"),
    ).dropDuplicates(["file_id", "position", "column"])


def detect_mapping(headers: DataFrame, records: DataFrame) -> DataFrame:
    """One row per file: chosen columns, date order, problems, uncertain, resolved.

    Arrays here hold one entry per header column, so a file's row stays small however
    many records the file has.
    """
    facts = column_evidence(headers, records).join(
        header_fields(headers), ["file_id", "position", "column"]
    )
    per_file = facts.groupBy("file_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("position", "column", "field", "rank", "holds_dates", "holds_money",
                         "date_order")
            )
        ).alias("cols")
    )

    def candidates(field):
        return F.array_sort(
            F.transform(
                F.filter("cols", lambda c: c["field"] == field),
                lambda c: F.struct(c["rank"], c["column"], c["holds_dates"], c["holds_money"]),
            )
        )

    named = per_file
    for field in HEADER_ALIASES:
        named = named.withColumn(f"c_{field}", candidates(field))

    def chosen(field):
        return F.get(f"c_{field}", F.lit(0))

    holders = F.filter("cols", lambda c: c["holds_dates"])
    date_named = F.when(chosen("date")["holds_dates"], chosen("date")["column"])
    doubts = [
        F.when(~chosen("date")["holds_dates"],
               F.concat(F.lit("date: column '"), chosen("date")["column"],
                        F.lit("' does not contain dates")))
    ]
    for field in ("amount", "debit", "credit"):
        doubts.append(
            F.when(~chosen(field)["holds_money"],
                   F.concat(F.lit(f"{field}: column '"), chosen(field)["column"],
                            F.lit("' does not contain amounts")))
        )
    doubts.append(
        F.when(
            date_named.isNull() & (F.size(holders) > 1),
            F.concat(F.lit("date: several columns hold dates ("),
                     F.array_join(F.transform(holders, lambda c: c["column"]), ", "), F.lit(")")),
        )
    )
    preferred = [
        F.when(
            F.size(f"c_{field}") > 1,
            F.concat(F.lit(f"{field}: chose '"), chosen(field)["column"], F.lit("' over "),
                     F.array_join(
                         F.transform(F.slice(f"c_{field}", F.lit(2), F.size(f"c_{field}")), lambda c: c["column"]), ", ")),
        )
        for field in HEADER_ALIASES
    ]
    money = {f: F.when(chosen(f)["holds_money"], chosen(f)["column"]) for f in ("amount", "debit", "credit")}
    found = named.select(
        "file_id", "cols",
        F.coalesce(date_named, F.get(holders, F.lit(0))["column"]).alias("date"),
        chosen("description")["column"].alias("described"),
        chosen("merchant")["column"].alias("merchant"),
        *[c.alias(f) for f, c in money.items()],
        F.array_compact(F.array(*doubts)).alias("uncertain"),
        F.array_compact(F.array(*preferred)).alias("resolved"),
    )
    split = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    missing = F.array_compact(F.array(
        F.when(F.col("date").isNull(), "no date column found"),
        F.when(F.coalesce("described", "merchant").isNull(), "no description or merchant column found"),
        F.when(F.col("amount").isNull() & ~split, "no amount, debit or credit column found"),
    ))
    problems = F.when(F.size(missing) > 0, missing).when(
        F.col("amount").isNotNull() & split,
        F.array(F.lit("both an amount column and a debit/credit pair")),
    ).otherwise(F.array().cast("array<string>"))
    order = F.get(F.filter("cols", lambda c: c["column"] == F.col("date")), F.lit(0))["date_order"]
    return found.withColumn("problems", problems).select(
        "file_id", "date", F.coalesce("described", "merchant").alias("description"), "merchant",
        F.lit(None).cast("string").alias("external_id"), "amount", "debit", "credit",
        (F.size("problems") == 0).alias("mapped"),
        F.when(F.size("problems") == 0, F.coalesce(order, F.lit(dates.AMBIGUOUS)))
        .otherwise(F.lit(dates.AMBIGUOUS)).alias("date_order"),
        "problems", "uncertain", "resolved",
    )


def apply_overrides(detected: DataFrame, supplied: DataFrame, headers: DataFrame) -> DataFrame:
    """A supplied mapping replaces the detected one; differences and unknown columns listed."""
    d = detected.alias("d").join(supplied.alias("s"), "file_id", "left").join(headers, "file_id")
    given = F.col("s.date").isNotNull()
    pick = {f: F.when(given, F.col(f"s.{f}")).otherwise(F.col(f"d.{f}")) for f in FIELDS}
    changed = F.array_compact(F.array(*[
        F.when(given & F.col("d.mapped") & ~F.col(f"s.{f}").eqNullSafe(F.col(f"d.{f}")), f)
        for f in FIELDS
    ]))
    named = F.array_compact(F.array(*[F.col(f"s.{f}") for f in FIELDS]))
    return d.select(
        "file_id", *[c.alias(f) for f, c in pick.items()],
        (given | F.col("d.mapped")).alias("mapped"),
        F.coalesce("s.date_order", "d.date_order").alias("date_order"),
        F.coalesce("s.amount_sign", F.lit("outflow-negative")).alias("amount_sign"),
        changed.alias("overridden"),
        F.when(given, F.array_except(named, F.col("header"))).otherwise(
            F.array().cast("array<string>")
        ).alias("unknown_columns"),
    )
