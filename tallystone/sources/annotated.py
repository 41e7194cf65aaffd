"""Labelled annotation files, prediction logs, strict charge files, text run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions.text import normalise_description, parse_amount, strip
from tallystone.operators.evaluate import label_set
from tallystone.operators.ranking import running_last
from tallystone.sources.bankfiles import (
    files_without_header, named_columns, read_lines, records_from_lines, split_header,
)

# Columns of an annotation file and what the optional ones default to.
REQUIRED = ["transaction_id", "description", "amount", "annotator_a_label", "annotator_b_label",
            "final_label", "acceptable_labels", "ambiguity_note"]
DEFAULTS = {"posted_on": "1970-01-01", "account_type": "unknown", "source": "manual_annotation",
            "bank_format": "unspecified"}
PREDICTION_SCHEMA = "predictions/1"
# Columns and limits of a charge file.
CHARGE_COLUMNS = ["id", "posted_on", "posted_time", "merchant", "category", "amount", "receipt"]
MAX_ID, MAX_TEXT, MAX_AMOUNT, MONTHS = 64, 80, "1000000.00", 2


def typed_labels(rows: DataFrame) -> DataFrame:
    """Annotation text as typed rows; ``error`` names the first thing wrong with a row."""
    def given(name):
        return F.nullif(strip(F.col(name)), F.lit(""))

    optional = {
        name: F.coalesce(given(name), F.lit(default)) if name in rows.columns else F.lit(default)
        for name, default in DEFAULTS.items()
    }
    staged = rows.select(
        *[c for c in rows.columns if c not in REQUIRED and c not in DEFAULTS],
        *[given(c).alias(c) for c in REQUIRED], *[c.alias(n) for n, c in optional.items()],
    ).withColumns({
        "accepted": label_set(F.col("acceptable_labels")),
        "money": parse_amount(F.col("amount")),
        "day": F.try_to_date("posted_on", "yyyy-MM-dd"),
    })
    error = (
        F.when(F.col("transaction_id").isNull(), "transaction_id is blank")
        .when(F.col("description").isNull(), "description is blank")
        .when(F.col("money").isNull(), "amount is not a valid amount")
        .when(F.col("annotator_a_label").isNull(), "annotator_a_label is blank")
        .when((F.size("accepted") > 0) & F.col("ambiguity_note").isNull(), "acceptable_labels without an ambiguity_note")
        .when(F.col("day").isNull(), "posted_on is not an ISO date")
    )
    return staged.select(
        *[c for c in rows.columns if c not in REQUIRED and c not in DEFAULTS],
        "transaction_id", F.col("day").alias("posted_on"), "description",
        normalise_description(F.col("description")).alias("merchant"),
        F.col("money").alias("amount"), "account_type", "source", "bank_format",
        F.col("annotator_a_label").alias("primary_label"), F.col("annotator_b_label").alias("secondary_label"),
        F.col("final_label").alias("adjudicated_label"), F.col("accepted").alias("acceptable"),
        (F.size("accepted") > 0).alias("ambiguous"), F.col("ambiguity_note").alias("note"),
        error.alias("error"),
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of all annotation files; in a file without a required column each row says so."""
    headers, rows = split_header(records_from_lines(read_lines(spark, path)))
    named = typed_labels(named_columns(headers, rows, [*REQUIRED, *DEFAULTS]).drop("cells", "columns"))
    lacking = F.when(F.col("missing").isNotNull(), F.concat(F.lit("required column missing: "), "missing"))
    return named.join(missing_columns(headers), "file_id", "left").withColumn(
        "error", F.coalesce(lacking, "error")).drop("missing")


def missing_columns(headers: DataFrame) -> DataFrame:
    """Files that lack a required column, with what they lack."""
    lacking = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.col("header"))
    return headers.select("file_id", F.array_join(lacking, ", ").alias("missing")).filter("missing <> ''")


def refused_labelled_files(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, reason) of annotation files that cannot be used at all."""
    bare = files_without_header(headers).select("file_id", F.lit("no header").alias("reason"))
    lacking = missing_columns(headers.filter(F.size("header") > 0)).select(
        "file_id", F.concat(F.lit("required column missing: "), "missing").alias("reason"))
    empty = headers.filter(F.size("header") > 0).join(rows.select("file_id").distinct(), "file_id", "left_anti").select(
        "file_id", F.lit("no rows").alias("reason"))
    return bare.unionByName(lacking).unionByName(empty)


# ---- prediction log ------------------------------------------------------------------


def write_predictions(predictions: DataFrame, digest: DataFrame, folder: str) -> None:
    """One JSON folder per system beside a one-row header naming the dataset's digest.

    The count guard runs as a job before anything is written.
    """
    short = predictions.groupBy("system").agg(F.count("*").alias("n")).withColumn("k", F.lit(1)).join(
        digest.select(F.col("rows"), F.lit(1).alias("k")), "k").filter("n <> rows").limit(1)
    if not short.isEmpty():
        raise ValueError("a system has not answered every row; a partial run is not recorded")
    predictions.write.mode("errorifexists").partitionBy("system").json(f"{folder}/rows")
    digest.withColumn("schema", F.lit(PREDICTION_SCHEMA)).write.mode("errorifexists").json(f"{folder}/header")


def prediction_header(spark: SparkSession, folder: str) -> DataFrame:
    """The header of a log: schema, digest and number of rows of the dataset it was made for."""
    known = spark.read.json(f"{folder}/header").filter(F.col("schema") == PREDICTION_SCHEMA)
    if known.isEmpty():
        raise ValueError(f"{folder}: not a prediction log of schema {PREDICTION_SCHEMA}")
    return known


def read_predictions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Recorded predictions; a log of another schema or one that lacks rows is refused."""
    expected = prediction_header(spark, folder).first()["rows"]
    rows = spark.read.schema(schema).json(f"{folder}/rows")
    short = rows.groupBy("system").agg(F.count("*").alias("n")).filter(F.col("n") != expected).limit(1).collect()
    if short:
        raise ValueError(f"{folder}: {short[0]['system']} has {short[0]['n']} rows of {expected}")
    return rows


# ---- charge files --------------------------------------------------------------------


def judge_charges(rows: DataFrame) -> DataFrame:
    """String rows with the reason each is refused, or null.

    Ids must be unique within a file: the later copies are refused.
    """
    firsts = rows.groupBy("file_id", "id").agg(F.min("line").alias("first_line"))
    # the null-safe match keeps rows whose id cell is missing
    known = rows.alias("r").join(
        firsts.alias("f"),
        (F.col("r.file_id") == F.col("f.file_id")) & F.col("r.id").eqNullSafe(F.col("f.id")),
    ).select("r.*", "f.first_line")

    def good(name, limit):
        text = F.col(name)
        return F.coalesce(
            (strip(text) != "") & (F.length(text) <= limit) & ~text.rlike(r"[\x00-\x1f]"), F.lit(False))

    amount = F.col("amount").try_cast("decimal(38,10)")
    sound = F.coalesce(
        (amount > 0) & (amount <= F.lit(MAX_AMOUNT).cast("decimal(18,2)")) & (F.round(amount, 2) == amount)
        & ~F.col("amount").rlike(r"\.\d{2}\d*[1-9]"), F.lit(False))
    clock = F.coalesce(F.col("posted_time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))
    day = F.when(F.col("posted_on").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("posted_on", "yyyy-MM-dd"))
    reason = (
        F.when(F.col("cells") != len(CHARGE_COLUMNS), "wrong field count")
        .when(~good("id", MAX_ID) | (F.col("line") > F.col("first_line")), "invalid id")
        .when(~good("merchant", MAX_TEXT) | ~good("category", MAX_TEXT), "invalid text")
        .when(day.isNull(), "invalid date")
        .when(~clock, "needs a local HH:MM time")
        .when(~sound, "invalid amount")
        .when(~F.coalesce(F.col("receipt").isin("true", "false"), F.lit(False)), "invalid receipt flag")
    )
    minute = F.substring("posted_time", 1, 2).try_cast("int") * 60 + F.substring("posted_time", 4, 2).try_cast("int")
    return known.withColumn("reason", reason).select(
        "file_id", "line", "id", "reason", day.alias("posted_on"), minute.alias("minute_of_day"),
        strip(F.col("merchant")).alias("merchant"), strip(F.col("category")).alias("category"),
        F.when(F.col("reason").isNull(), amount).cast("decimal(18,2)").alias("amount"),
        (F.col("receipt") == "true").alias("has_receipt"),
    )


def charge_files(judged: DataFrame) -> DataFrame:
    """Per file: rows, refused rows, months, and whether it may be used."""
    months = F.count_distinct(F.when(F.col("reason").isNull(), F.date_format("posted_on", "yyyy-MM")))
    return judged.groupBy("file_id").agg(
        F.count("*").alias("rows"), F.count(F.col("reason")).alias("refused"), months.alias("months")
    ).withColumn("accepted", (F.col("refused") == 0) & (F.col("months") == MONTHS))


def read_charges(spark: SparkSession, path: str) -> DataFrame:
    """Judged rows of all charge files; a file with another header is one refused row."""
    headers, rows = split_header(records_from_lines(read_lines(spark, path)))
    wanted = F.coalesce(F.col("header") == F.array(*[F.lit(c) for c in CHARGE_COLUMNS]), F.lit(False))
    judged = judge_charges(named_columns(headers.filter(wanted), rows, CHARGE_COLUMNS).drop("columns"))
    refused = headers.filter(~wanted).select(
        "file_id", F.lit(1).cast("bigint").alias("line"), F.lit("wrong header").alias("reason"))
    return judged.unionByName(refused, allowMissingColumns=True)


# ---- text run reports ----------------------------------------------------------------

# The lines of a rendered report.
SECTION = r"^(--- .*|SUMMARY.*)$"
LABEL_ROW = r"^\s{2}([A-Z][A-Z_]+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s*$"
HEADLINE = r"^\s*(macro F1|weighted F1|accuracy \(all rows\)|coverage|abstentions)\s+([\d.]+)\s*$"
TOKENS = r"tokens: (\d+) in, (\d+) out"
COST = r"cost: total ([\d.]+), per row ([\d.]+)"
LATENCY = r"latency: mean (\d+)ms\s+p50 (\d+)ms\s+p95 (\d+)ms"


def report_sections(lines: DataFrame) -> DataFrame:
    """Every line with the section heading above it."""
    heading = F.nullif(F.regexp_extract("text", SECTION, 1), F.lit(""))
    return running_last(
        lines, ["file_id"], F.floor(F.col("line_no") / 65536), "line_no", heading, "section"
    ).filter("section like '--- %'")


def report_label_scores(lines: DataFrame) -> DataFrame:
    rows = report_sections(lines).filter(F.col("text").rlike(LABEL_ROW))

    def part(group, kind):
        return F.regexp_extract("text", LABEL_ROW, group).cast(kind)

    return rows.select(
        "file_id", "section", part(1, "string").alias("label"), part(2, "decimal(9,4)").alias("precision"),
        part(3, "decimal(9,4)").alias("recall"), part(4, "decimal(9,4)").alias("f1"),
        part(5, "bigint").alias("support"),
    )


def report_metrics(lines: DataFrame) -> DataFrame:
    """Headline, token, cost and latency figures as (file, section, metric, value) rows."""
    names = {TOKENS: ["input tokens", "output tokens"], COST: ["cost total", "cost per row"],
             LATENCY: ["latency mean", "latency p50", "latency p95"]}

    def pair(metric, value):
        return F.struct(metric.alias("metric"), value.alias("value"))

    found = [F.when(F.col("text").rlike(HEADLINE), pair(
        F.regexp_extract("text", HEADLINE, 1), F.regexp_extract("text", HEADLINE, 2)))]
    for pattern, metrics in names.items():
        found += [
            F.when(F.col("text").rlike(pattern), pair(F.lit(m), F.regexp_extract("text", pattern, i + 1)))
            for i, m in enumerate(metrics)
        ]
    return report_sections(lines).select(
        "file_id", "section", F.explode(F.array_compact(F.array(*found))).alias("m")
    ).select("file_id", "section", "m.metric", F.col("m.value").cast("decimal(28,6)").alias("value"))
