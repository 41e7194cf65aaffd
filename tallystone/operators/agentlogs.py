"""Scoring tool-call logs: selection, arguments, and whether answers are grounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.ledger import half_even_ratio
from tallystone.functions.text import decimal_places, number_raws, number_texts

VALUE = "decimal(38,18)"
PLACES = 18
# Shapes of JSON strings, with the colon behind those that are keys, and whole numbers.
JSON_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'
JSON_INTEGER = r"(?<![\w.+\-])(-?\d+)(?![\w.])"


def canonical_arguments(arguments: Column) -> Column:
    """Call arguments as entries sorted by key; compared as they are, never as joined text."""
    return F.array_sort(F.map_entries(arguments))


def trace_scores(calls: DataFrame, gold: DataFrame) -> DataFrame:
    """Expected, actual, correctly selected and exact calls per run.

    Both sides become counts per (run, name, arguments); the smaller count is the
    multiset intersection, summed up by name and by run.
    """
    one, none = F.lit(1), F.lit(0)

    def side(rows, expected, actual):
        return rows.select(
            "run_id", "name", canonical_arguments(F.col("arguments")).alias("args"),
            expected.alias("e"), actual.alias("a"),
        )

    per_call = side(gold, one, none).unionByName(side(calls, none, one)).groupBy(
        "run_id", "name", "args"
    ).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    per_name = per_call.groupBy("run_id", "name").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum(F.least("e", "a")).alias("exact")
    )
    return per_name.groupBy("run_id").agg(
        F.sum("e").alias("expected_calls"), F.sum("a").alias("actual_calls"),
        F.sum(F.least("e", "a")).alias("correctly_selected"), F.sum("exact").alias("exact_arguments"),
    )


def perfect_when_empty(numerator: Column, denominator: Column) -> Column:
    """Nothing expected and nothing done counts as one, something for nothing as zero."""
    return F.when(
        denominator == 0, F.when(numerator == 0, F.lit(1)).otherwise(0).cast("decimal(18,4)")
    ).otherwise(half_even_ratio(numerator, denominator))


def number_key(number: Column) -> Column:
    """What two numbers share when they are equal, of any length.

    The value as a decimal where it fits, else the digits without what adds nothing.
    """
    digits = F.translate(number, ",", "")
    bare = F.regexp_replace(F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
    return F.coalesce(digits.try_cast(VALUE).cast("string"), F.regexp_replace(bare, r"\.$", ""))


def numeric_tokens(rows: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Every number of a text with its raw form, value, key and decimal places.

    A number too long for a decimal has no value; its key still says which number it is.
    """
    found = F.arrays_zip(number_texts(text).alias("number"), number_raws(text).alias("raw"))
    return rows.select(*keys, F.posexplode(found).alias("position", "t")).select(
        *keys, "position", F.col("t.raw").alias("raw"),
        F.translate(F.col("t.number"), ",", "").try_cast(VALUE).alias("value"),
        number_key(F.col("t.number")).alias("key"), decimal_places(F.col("t.number")).alias("places"),
    )


def payload_numbers(payload: Column) -> Column:
    """Numbers a JSON payload holds at any depth: text is scanned, whole numbers taken.

    Whole strings are matched one behind the other, so that none begins at the closing quote
    of the one before; those with a colon behind them are keys and left out. Texts are
    decoded before they are scanned, so an escaped line end is no letter; true, false and
    fractions that are not text are left out.
    """
    strings = F.filter(F.regexp_extract_all(payload, F.lit(JSON_STRING), F.lit(0)), lambda s: ~s.endswith(":"))
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    scanned = F.flatten(F.transform(decoded, number_texts))
    bare = F.regexp_replace(payload, JSON_STRING, " ")
    return F.concat(scanned, F.regexp_extract_all(bare, F.lit(JSON_INTEGER), F.lit(1)))


def source_numbers(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Numbers an answer may use: the question's and those of successful calls."""
    asked = runs.select("run_id", F.explode(number_texts(F.col("question"))).alias("number"))
    told = calls.filter("ok").select("run_id", F.explode(payload_numbers(F.col("payload"))).alias("number"))
    return asked.unionByName(told).select(
        "run_id", F.translate("number", ",", "").try_cast(VALUE).alias("value"), number_key(F.col("number")).alias("key")
    ).distinct()


def round_to(value: Column, places: Column) -> Column:
    rounded = value
    for p in range(PLACES):
        rounded = F.when(places == p, F.bround(value, p).cast(VALUE)).otherwise(rounded)
    return rounded


def grounding(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Each number of each answer, and whether a source rounds to it.

    Sources are rounded once per precision the run's answer uses and matched by equality,
    so answers and sources of a run never meet pairwise. A number too long for a decimal
    is matched by its digits, unrounded.
    """
    answers = numeric_tokens(runs, F.col("final_text"), ["run_id"])
    needed = answers.select("run_id", "places").distinct()
    rounded = round_to(F.col("value"), F.col("places")).cast("string")
    offered = source_numbers(runs, calls).join(needed, "run_id").select(
        "run_id", "places", F.coalesce(rounded, "key").alias("key")
    ).distinct().withColumn("grounded", F.lit(True))
    return answers.join(offered, ["run_id", "places", "key"], "left").select(
        "run_id", "position", "raw", "value", "places", F.coalesce("grounded", F.lit(False)).alias("grounded")
    )


def grounding_scores(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("run_id").agg(
        F.count("*").alias("numeric_tokens"), F.count_if(F.col("grounded")).alias("grounded_tokens"),
        F.count_if(~F.col("grounded")).alias("fabrications"),
    )


def run_scores(runs: DataFrame, calls: DataFrame, gold: DataFrame) -> DataFrame:
    """Trace and grounding per run, and whether a planted fault was handled."""
    target = calls.join(
        runs.filter("fault_tool is not null").select("run_id", F.col("fault_tool").alias("name")), ["run_id", "name"]
    ).groupBy("run_id").agg(F.bool_and(~F.col("ok") | (F.col("payload") == "{}")).alias("unusable"))
    trace = trace_scores(calls, gold)
    grounds = grounding_scores(grounding(runs, calls))
    joined = runs.select("run_id", "stopped_reason", "fault_tool").join(trace, "run_id", "left").join(
        grounds, "run_id", "left").join(target, "run_id", "left")
    counted = [c for c in trace.columns + grounds.columns if c != "run_id"]
    filled = joined.fillna(0, counted)
    return filled.withColumn(
        "fault_passed",
        F.when(F.col("fault_tool").isNotNull(),
               F.coalesce("unusable", F.lit(False)) & (F.col("fabrications") == 0)),
    ).drop("unusable", "fault_tool")


def run_set_report(scores: DataFrame) -> DataFrame:
    sums = scores.agg(
        F.count("*").alias("tasks"),
        *[F.sum(c).alias(c) for c in ("expected_calls", "actual_calls", "correctly_selected",
                                      "exact_arguments", "numeric_tokens", "grounded_tokens")],
        F.count_if(F.col("fabrications") > 0).alias("answers_with_fabrication"),
        F.count(F.col("fault_passed")).alias("fault_tasks"),
        F.count_if(F.col("fault_passed")).alias("fault_passed"),
        F.count_if(F.col("stopped_reason") == "provider_failure").alias("provider_failures"),
        F.count_if(F.col("stopped_reason") == "turn_limit").alias("turn_limit_stops"),
    )
    c = F.col
    return sums.select(
        "*", perfect_when_empty(c("correctly_selected"), c("actual_calls")).alias("selection_precision"),
        perfect_when_empty(c("correctly_selected"), c("expected_calls")).alias("selection_recall"),
        F.when(c("correctly_selected") > 0, half_even_ratio(c("exact_arguments"), c("correctly_selected"))).alias("argument_accuracy"),
        F.when(c("numeric_tokens") > 0, half_even_ratio(c("grounded_tokens"), c("numeric_tokens"))).alias("numeric_grounding"),
        F.when(c("fault_tasks") > 0, half_even_ratio(c("fault_passed"), c("fault_tasks"))).alias("fault_pass_rate"),
    )
