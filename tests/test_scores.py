"""Scoring, thresholds, routing, scenarios and logs on worked examples."""

from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallystone.operators import agentlogs, evaluate, labelling, scenario


def answers(spark, rows):
    return spark.createDataFrame(
        [("s", g, p, a) for g, p, a in rows], "system string, gold string, predicted string, acceptable array<string>")


def test_even_confusion(spark):
    cells = evaluate.answer_cells(answers(spark, [("A", "A", []), ("A", "B", []), ("B", "A", []), ("B", "B", [])]), ["system"])
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.label_scores(cells, ["system"]).collect()}
    half = Decimal("0.5000")
    assert got == {"A": (half,) * 3, "B": (half,) * 3}


def test_accepted_alternative_credits_gold(spark):
    cells = evaluate.answer_cells(answers(spark, [("A", "C", ["A", "C"]), ("A", "UNKNOWN", [])]), ["system"])
    head = evaluate.system_scores(cells, ["system"]).first()
    assert (head["correct"], head["abstentions"], str(head["accuracy_when_answered"])) == (1, 1, "1.0000")
    got = {r["label"]: str(r["recall"]) for r in evaluate.label_scores(cells, ["system"]).collect()}
    assert got == {"A": "0.5000", "C": "0.0000"}


def test_kappa(spark):
    def of(pairs):
        frame = spark.createDataFrame(pairs, "a string, b string")
        return evaluate.kappa(frame, "a", "b", []).first()["kappa"]

    assert of(list(zip("AABB", "AABA"))) == Decimal("0.5000")
    assert of([("A", "A"), ("A", "A")]) is None
    assert of(list(zip("AABB", "BBAA"))) == Decimal("-1.0000")


def test_threshold_choice_is_inside(spark):
    rows = [("s", "0.85", True), ("s", "0.90", True), ("s", "0.95", True), ("s", "0.40", False), ("s", "0.30", False), ("s", "0.10", False)]
    frame = spark.createDataFrame(rows, "system string, confidence string, correct boolean").withColumn(
        "confidence", F.col("confidence").cast("decimal(4,3)"))
    sweep = evaluate.threshold_sweep(frame, ["0.00", "0.50", "0.80", "1.00"], ["system"])
    got = {str(r["threshold"]): (r["queued"], str(r["accuracy_when_answered"])) for r in sweep.collect()}
    assert got["0.000"] == (0, "0.5000") and got["0.500"] == (3, "1.0000") and got["1.000"] == (6, "0.0000")
    assert str(evaluate.choose_threshold(sweep, ["system"]).first()["threshold"]) == "0.500"


def test_percentiles_are_observed_values(spark):
    frame = spark.createDataFrame([("s", v) for v in (5, 1, 9, 3)], "system string, ms int")
    row = evaluate.nearest_rank(frame, ["system"], "ms", [50, 95]).first()
    assert (row["p50_ms"], row["p95_ms"]) == (3, 9)


def test_digest_ignores_order_and_sees_change(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    one = evaluate.dataset_digest(rows, ["a", "b"], []).first()
    assert one == evaluate.dataset_digest(rows.orderBy(F.desc("a")).repartition(7), ["a", "b"], []).first()
    other = rows.withColumn("b", F.when(F.col("a") == "7", "x").otherwise(F.col("b")))
    assert one != evaluate.dataset_digest(other, ["a", "b"], []).first()


def test_rules_tie_goes_to_the_alphabet(spark):
    frame = spark.createDataFrame([("M", "TRANSFER"), ("M", "INCOME")], "merchant string, gold string")
    row = labelling.fit_rules(frame).first()
    assert (row["rule_label"], row["hits"], row["total"]) == ("INCOME", 1, 2)


def test_model_sees_only_escalated_rows_and_is_checked(spark):
    views = spark.createDataFrame(
        [("1", "KNOWN", "a", -1.0, "card"), ("2", "NEW", "b", -1.0, "card"), ("3", "NEW", "c", -1.0, "card"), ("4", "NEW", "d", 5.0, "card")],
        "id string, merchant string, description string, amount double, account_type string")
    rules = spark.createDataFrame([("KNOWN", "LIVING_GYM")] * 3, "merchant string, gold string")

    def model(frame):
        labels = {"b": "LIVING_DINING", "c": "HACKED", "d": "UNKNOWN"}
        return pd.DataFrame({
            "raw_label": [labels[d] for d in frame["description"]], "raw_confidence": [Decimal("1.5")] * len(frame),
            "failed": [False] * len(frame)})

    ruled = labelling.predict_rules(views, labelling.fit_rules(rules))
    out = labelling.hybrid(ruled, lambda rows: labelling.check_answers(labelling.call_model(rows, model, 2)), "id")
    got = {r["id"]: (r["predicted"], float(r["confidence"]), r["reason"]) for r in out.collect()}
    assert got == {"1": ("LIVING_GYM", 1.0, "rules"), "2": ("LIVING_DINING", 1.0, "model"),
                   "3": ("UNKNOWN", 0.0, "abstain"), "4": ("INCOME", 0.5, "weak rule")}


def crossings(spark, values):
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "pair_id int, month_index int, delta12 int")
    row = scenario.break_even(frame).first()
    return row["first_crossing_month"], row["stable_break_even_month"]


def test_break_even(spark):
    assert crossings(spark, [-300, -100, 50, 200]) == (3, 3)
    assert crossings(spark, [500, -200, -50, 300, 600]) == (1, 4)
    assert crossings(spark, [10, -10, 10, -10, 10]) == (1, 5)
    assert crossings(spark, [-1, -2]) == (None, None) and crossings(spark, [1, 2]) == (1, 1)


def test_fabricated_figures_are_named(spark):
    runs = spark.createDataFrame([("r", "What about 10 orders?", "It is $4,300 for 10, rounded 1.2")],
                                 "run_id string, question string, final_text string")
    calls = spark.createDataFrame([("r", True, '{"a": {"b": ["1.25"]}, "ok": true}'), ("r", False, '{"x": "4300"}')],
                                  "run_id string, ok boolean, payload string")
    got = {r["raw"]: r["grounded"] for r in agentlogs.grounding(runs, calls).collect()}
    assert got == {"$4,300": False, "10": True, "1.2": True}


def test_trace_counts_each_call_once(spark):
    def calls(rows):
        return spark.createDataFrame([("r", n, a) for n, a in rows], "run_id string, name string, arguments map<string,string>")

    row = agentlogs.trace_scores(calls([("a", {"x": "1"}), ("b", {})]), calls([("a", {"x": "2"}), ("c", {})])).first()
    assert (row["correctly_selected"], row["exact_arguments"], row["expected_calls"], row["actual_calls"]) == (1, 0, 2, 2)


@pytest.mark.parametrize("payload, numbers", [
    ('{"a":["total",": $43.50"]}', ["43.50"]), ('{"k 1":":7","b":[":",":8 9"]}', ["7", "8", "9"]),
    ('{"a \\"5\\" b":"6","c":{":3":4}}', ["6", "4"]), ('{"a" : ["x:","1"], "b":":"}', ["1"]), ('["1",": 2",3]', ["1", "2", "3"]),
    ('{"a":"ends with \\\\","b":": 5"}', ["5"]), ('{}', []),
])
def test_payload_texts_that_begin_with_a_colon(spark, payload, numbers):
    found = spark.createDataFrame([(payload,)], "payload string").select(agentlogs.payload_numbers(F.col("payload")).alias("n")).first()["n"]
    assert found == numbers


def test_payload_numbers_behind_escapes(spark):
    payload = '{"a 9": "Total:\\n4300", "b": "x\\t4,300.50", "c": ["\\"7\\"", {"d": 25}], "e": "\\u0031\\u0032", "f": 1234567890123456789012345}'
    frame = spark.createDataFrame([(payload,)], "payload string")
    numbers = frame.select(agentlogs.payload_numbers(F.col("payload")).alias("n")).first()["n"]
    assert numbers == ["4300", "4,300.50", "7", "12", "25", "1234567890123456789012345"]


def test_long_numbers_are_grounded_by_their_digits(spark):
    runs = spark.createDataFrame([(1, "q", "it is 1234567890123456789012345 or 1234567890123456789012346")], "run_id int, question string, final_text string")
    calls = spark.createDataFrame([(1, True, '{"n": 1234567890123456789012345}')], "run_id int, ok boolean, payload string")
    found = agentlogs.grounding(runs, calls).orderBy("position").collect()
    assert [r["grounded"] for r in found] == [True, False]


def test_arguments_are_not_compared_as_text(spark):
    def side(arguments):
        return spark.createDataFrame([(1, "search", arguments)], "run_id int, name string, arguments map<string,string>")

    exact = lambda a, b: agentlogs.trace_scores(side(a), side(b)).first()["exact_arguments"]
    assert exact({"a": "b=c"}, {"a=b": "c"}) == 0
    assert exact({"a": None}, {}) == 0
    assert exact({"a": "1", "b": "2"}, {"b": "2", "a": "1"}) == 1
