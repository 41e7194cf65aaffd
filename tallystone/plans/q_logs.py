"""Scores of agent run logs. The oracles know the numbers that were written in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import agentlogs
from tallystone.plans.derived import duck, ratio4, view
from tallystone.plans.registry import query
from tallystone.session import portions

RUNS_A_TASK = 50_000


def _runs(spark, sf):
    rows = view(spark, sf, "agent_runs")
    run, total, twice = F.col("run_id").cast("string"), F.col("total"), F.col("double_total")
    style = F.col("style")
    answer = (
        F.when(style == 0, F.concat(F.lit("Total $"), F.format_number(total, 2), F.lit(".")))
        .when(style == 1, F.concat(F.lit("Total "), total.cast("string"), F.lit(" and double $ "), F.format_number(twice, 2)))
        .when(style == 2, F.concat(F.lit("About "), F.bround(total, 0).cast("bigint").cast("string"), F.lit(" for order "), run))
        .when(style == 3, F.concat(F.lit("Total "), (total + 1).cast("decimal(18,2)").cast("string"), F.lit(" (v1.2.3, a4)")))
        .otherwise(F.lit("Discount 12% on 4 lines, limit 3,000"))
    )
    return rows.select(
        "run_id", "stopped_reason",
        F.concat(F.lit("Check order "), run, F.lit(" against the limit of $3,000.00")).alias("question"),
        answer.alias("final_text"),
        F.when(F.col("kind") == "fault", "summarize").alias("fault_tool"),
    )


def _calls(spark, sf, rows=None):
    rows = view(spark, sf, "agent_runs") if rows is None else rows
    run = F.col("run_id").cast("string")
    found = F.concat(
        F.lit('{"order": '), run, F.lit(', "total 99": "$'), F.format_number("total", 2),
        F.lit('", "paid": true, "share": 0.25, "lines": [4, {"qty 5": 7, "note": "about\\n12% off\\tsaid \\"ok\\" \\u0041"}]}'))
    ok = F.col("kind") != "fault"
    summed = F.when(ok, F.concat(F.lit('{"double": "'), F.col("double_total").cast("string"), F.lit('"}'))).otherwise(
        F.lit('{"error": "no answer after 30 seconds"}'))
    args = F.create_map(F.lit("order"), run)
    more = F.create_map(F.lit("order"), run, F.lit("verbose"), F.lit("no"))

    def call(name, arguments, good, payload):
        return F.struct(F.lit(name).alias("name"), arguments.alias("arguments"), good.alias("ok"), payload.alias("payload"))

    made = F.array_compact(F.array(
        call("search", more, F.lit(True), found), call("summarize", args, ok, summed),
        F.when(F.expr("run_id % 6 = 0"), call("search", more, F.lit(True), found)),
    ))
    return rows.select("run_id", F.explode(made).alias("c")).select("run_id", "c.*")


def _gold(spark, sf):
    rows = view(spark, sf, "agent_runs")
    run = F.col("run_id")
    wanted = F.when(run % 4 == 0, run + 1).otherwise(run).cast("string")

    def call(name, arguments):
        return F.struct(F.lit(name).alias("name"), arguments.alias("arguments"))

    calls = F.array_compact(F.array(
        call("search", F.create_map(F.lit("verbose"), F.lit("no"), F.lit("order"), wanted)),
        F.when(run % 3 != 0, call("summarize", F.create_map(F.lit("order"), run.cast("string")))),
        F.when(run % 8 == 0, call("lookup", F.create_map(F.lit("order"), run.cast("string")))),
    ))
    return rows.select("run_id", F.explode(calls).alias("c")).select("run_id", "c.*")


_TRACE = """
select run_id, 1 + (run_id % 3 <> 0)::int + (run_id % 8 = 0)::int as expected_calls, 2 + (run_id % 6 = 0)::int as actual_calls,
  1 + (run_id % 3 <> 0)::int as correctly_selected, (run_id % 4 <> 0)::int + (run_id % 3 <> 0)::int as exact_arguments
from agent_runs"""
_TOKENS = """
select run_id, kind, case when style in (0, 3) then 1 when style in (1, 2) then 2 else 3 end as numeric_tokens,
  case style when 0 then 1 when 1 then 1 + (kind <> 'fault')::int when 2 then 2 when 3 then 0 else 3 end as grounded_tokens
from agent_runs"""


@query("f25_trace_scores", duck("agent_runs", """
select run_id, expected_calls::bigint as expected_calls, actual_calls::bigint as actual_calls,
  correctly_selected::bigint as correctly_selected, exact_arguments::bigint as exact_arguments from t""", t=_TRACE))
def f25(spark, sf):
    return agentlogs.trace_scores(_calls(spark, sf), _gold(spark, sf))


@query("i3_multiset_intersection", duck("agent_runs", """
select 'search' as name, count(*) filter (where run_id % 4 <> 0) as n from agent_runs
union all select 'summarize', count(*) filter (where run_id % 3 <> 0) from agent_runs"""))
def i3(spark, sf):
    def keyed(rows):
        return rows.select("run_id", "name", agentlogs.canonical_arguments(F.col("arguments")).alias("args"))

    common = keyed(_gold(spark, sf)).intersectAll(keyed(_calls(spark, sf)))
    return common.groupBy("name").agg(F.count("*").alias("n"))


@query("c13_number_tokens", duck("agent_runs", """
select run_id, pos::int as position, value::decimal(28,2) as value, places::int as places from (
  select run_id, 0 as pos, total as value, 2 as places from agent_runs where style in (0, 1)
  union all select run_id, 1, double_total, 2 from agent_runs where style = 1
  union all select run_id, 0, round_even(total, 0)::decimal(18,2), 0 from agent_runs where style = 2
  union all select run_id, 1, run_id::decimal(18,2), 0 from agent_runs where style = 2
  union all select run_id, 0, total + 1, 2 from agent_runs where style = 3
  union all select run_id, unnest([0, 1, 2]), unnest([12, 4, 3000])::decimal(18,2), 0 from agent_runs where style = 4)"""))
def c13(spark, sf):
    runs = _runs(spark, sf)
    return agentlogs.numeric_tokens(runs, F.col("final_text"), ["run_id"]).select(
        "run_id", "position", F.col("value").cast("decimal(28,2)").alias("value"), "places")


@query("c25_payload_numbers", duck("agent_runs", """
select run_id, n::decimal(28,2) as value, count(*) as times from (
  select run_id, unnest([run_id::decimal(28,2), total, 4, 7, 12]) as n
  from (select *, unnest(range(0, case when run_id % 6 = 0 then 2 else 1 end)) as c from agent_runs)
  union all select run_id, case when kind = 'fault' then 30 else double_total end from agent_runs) group by all"""))
def c25(spark, sf):
    numbers = F.explode(agentlogs.payload_numbers(F.col("payload")))
    # a run gives several numbers, and a task counts its own before they are moved
    runs = portions(view(spark, sf, "agent_runs"), RUNS_A_TASK)
    return _calls(spark, sf, runs).select("run_id", numbers.alias("n")).select(
        "run_id", F.translate("n", ",", "").cast("decimal(28,2)").alias("value")
    ).groupBy("run_id", "value").agg(F.count("*").alias("times"))


@query("f26_grounding", duck("agent_runs", """
select run_id, numeric_tokens::bigint as numeric_tokens, grounded_tokens::bigint as grounded_tokens,
  (numeric_tokens - grounded_tokens)::bigint as fabrications from k""", k=_TOKENS))
def f26(spark, sf):
    return agentlogs.grounding_scores(agentlogs.grounding(_runs(spark, sf), _calls(spark, sf)))


@query("f27_run_set_report", duck("agent_runs", f"""
select *, {ratio4("correctly_selected", "actual_calls")} as selection_precision, {ratio4("correctly_selected", "expected_calls")} as selection_recall,
  {ratio4("exact_arguments", "correctly_selected")} as argument_accuracy, {ratio4("grounded_tokens", "numeric_tokens")} as numeric_grounding,
  {ratio4("fault_passed", "fault_tasks")} as fault_pass_rate
from (select count(*) as tasks, sum(expected_calls)::bigint as expected_calls, sum(actual_calls)::bigint as actual_calls,
   sum(correctly_selected)::bigint as correctly_selected, sum(exact_arguments)::bigint as exact_arguments,
   sum(numeric_tokens)::bigint as numeric_tokens, sum(grounded_tokens)::bigint as grounded_tokens,
   count(*) filter (where numeric_tokens > grounded_tokens) as answers_with_fabrication,
   count(*) filter (where r.kind = 'fault') as fault_tasks,
   count(*) filter (where r.kind = 'fault' and numeric_tokens = grounded_tokens) as fault_passed,
   count(*) filter (where stopped_reason = 'provider_failure') as provider_failures,
   count(*) filter (where stopped_reason = 'turn_limit') as turn_limit_stops
 from agent_runs r join t using (run_id) join k using (run_id))""", t=_TRACE, k=_TOKENS))
def f27(spark, sf):
    scores = agentlogs.run_scores(_runs(spark, sf), _calls(spark, sf), _gold(spark, sf))
    return agentlogs.run_set_report(scores)
