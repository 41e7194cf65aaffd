"""Statement rows rendered as banks write them: the parsers' input.

The oracle never sees this text; its answer is the value the text was rendered from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The header each shape of bank file carries.
HEADERS = {
    0: ["Transaction Date", "Description", "Amount"],
    1: ["Date", "Name", "Money Out", "Money In"],
    2: ["Post Date", "Trans. Date", "Details", "Amount", "Balance"],
    3: ["When", "Narrative", "Debit", "Credit", "Settled"],
    4: ["Date", "Description", "Amount", "Debit"],
    5: ["Date", "Description", "Amount"],
    6: ["Date", "Description", "Amount"],
}
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "MMM d yyyy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyy-MM-dd HH:mm:ss", "yyyy.M.dd",
]


def render_amount(amount: Column, style: Column) -> Column:
    plain, grouped = F.abs(amount).cast("string"), F.format_number(F.abs(amount), 2)
    negative = amount < 0
    sign = F.when(negative, "-").otherwise("")
    return (
        F.when(style == 0, F.concat(sign, F.lit("$"), grouped))
        .when(style == 1, F.when(negative, F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(F.concat(F.lit("+"), plain)))
        .when(style == 2, F.concat(grouped, sign))
        .when(style == 3, F.concat(F.lit(" "), sign, plain, F.lit(" ")))
        .otherwise(F.concat(F.lit("£ "), sign, plain))
    )


def render_amount_comma(amount: Column) -> Column:
    """European: point groups, comma decimals."""
    text = F.translate(F.format_number(F.abs(amount), 2), ".,", ",.")
    return F.concat(F.when(amount < 0, "-").otherwise(""), text, F.lit(" €"))


def render_description(merchant: Column, style: Column, number: Column) -> Column:
    tail = F.lpad(number.cast("string"), 4, "1")
    return (
        F.when(style == 0, F.concat(F.lit("SQ *"), F.lower(merchant), F.lit("  #"), tail))
        .when(style == 1, F.concat(F.lit("TST* "), merchant, F.lit(" 08/17")))
        .when(style == 2, F.concat(merchant, F.lit(" "), tail))
        .when(style == 3, F.concat(F.lit("  paypal *"), merchant, F.lit(" #12  ")))
        .when(style == 4, F.concat(merchant, F.lit(" 08/17/2026")))
        .otherwise(F.regexp_replace(merchant, " ", "   "))
    )


def render_date(day: Column, style: Column) -> Column:
    text = F.date_format(day, DATE_FORMATS[0])
    for index, pattern in enumerate(DATE_FORMATS[1:], start=1):
        text = F.when(style == index, F.date_format(day.cast("timestamp"), pattern)).otherwise(text)
    return text


def bank_headers(rows: DataFrame) -> DataFrame:
    """One header per file."""
    table = F.create_map(*[
        part for shape, names in HEADERS.items()
        for part in (F.lit(shape).cast("bigint"), F.array(*[F.lit(n) for n in names]))
    ])
    return rows.select("file_id", "shape").distinct().select(
        "file_id", F.element_at(table, F.col("shape").cast("bigint")).alias("header")
    )


def bank_records(rows: DataFrame) -> DataFrame:
    """Statement rows as (file_id, line, cells) with faults written into the text.

    Each kind of cell is a column of its own before the shapes pick theirs, which keeps
    the generated code small enough to be compiled.
    """
    fault, shape, day = F.col("fault"), F.col("shape"), F.col("posted_on")
    empty = F.lit("")
    blank, unread = fault == "blank", fault == "amount"
    at = F.col("_at")

    def written_as(pattern):
        return F.date_format(at, pattern)

    # a day of twelve at most, where day and month cannot be told apart
    unclear = F.make_date(F.year(day), F.month(day), F.pmod(F.col("part_id"), F.lit(12)).cast("int") + 1)
    first = (
        F.when(shape.isin(0, 4), written_as("MM/dd/yyyy"))
        .when(shape.isin(2, 3), written_as("dd MMM yyyy"))
        .when(F.coalesce(shape != 5, F.lit(True)), written_as("dd/MM/yyyy"))
    )
    second = F.when(shape == 2, written_as("yyyy-MM-dd HH:mm:ss")).when(shape == 3, written_as("MMM d, yyyy"))
    timed = rows.select(
        "file_id", "account_id", "line", "fault", "shape", "merchant", "part_id", "amount",
        F.when(F.col("flipped"), -F.col("amount")).otherwise(F.col("amount")).cast("string").alias("_signed"),
        F.abs("amount").cast("string").alias("_size"),
        F.when(F.coalesce(shape.isin(0, 1, 2, 3, 4, 5), F.lit(False)), day).otherwise(unclear).cast("timestamp").alias("_at"),
    )

    def dated(text):
        return F.when(blank, empty).when(fault == "date", "PENDING").otherwise(text)

    parts = timed.select(
        "file_id", "account_id", "line", "fault", "shape",
        dated(first).alias("_first"), dated(second).alias("_second"),
        F.when(fault.isin("blank", "description"), " ").otherwise(
            F.concat(F.lit("SQ *"), F.col("merchant"), F.lit(" #"), F.col("part_id").cast("string"))
        ).alias("_text"),
        F.when(blank, empty).when(unread, "OOPS").otherwise(F.col("_signed")).alias("_signed"),
        F.when(blank, empty).when(unread, "OOPS").when(
            (F.col("amount") < 0) | (fault == "both"), F.col("_size")).otherwise(empty).alias("_out"),
        F.when(blank | unread, empty).when(
            (F.col("amount") > 0) | (fault == "both"), F.col("_size")).otherwise(empty).alias("_into"),
    )
    cells = parts.select(
        "file_id", "account_id", "line", "fault",
        F.when(shape == 0, F.array("_first", "_text", "_signed"))
        .when(shape == 1, F.array("_first", "_text", "_out", "_into"))
        .when(shape == 2, F.array("_first", "_second", "_text", "_signed", F.lit("1")))
        .when(shape == 3, F.array("_first", "_text", "_out", "_into", "_second"))
        .when(shape == 4, F.array("_first", "_text", "_signed", "_signed"))
        .when(shape == 5, F.array("_text", "_text", "_signed"))
        .otherwise(F.array("_first", "_text", "_signed")).alias("_cells"),
    )
    ragged = F.when(fault == "surplus", F.concat("_cells", F.array(F.lit("extra")))).when(
        fault == "short", F.slice("_cells", F.lit(1), F.size("_cells") - 1)
    ).otherwise(F.col("_cells"))
    # rendered once, as if read from a file: the generator stops the text being re-derived
    return cells.select("file_id", "account_id", "line", F.explode(F.array(ragged)).alias("cells"))
