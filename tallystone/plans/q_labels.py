"""Splits, rules, hybrid labelling, scoring, failures, annotation checks, subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import identity
from tallystone.functions.ledger import half_even_ratio
from tallystone.operators import annotation_checks, evaluate, failures, labelling, subset
from tallystone.plans.derived import duck, ratio4, view
from tallystone.plans.registry import query
from tallystone.sources.stores import merge_unseen
from tallystone.vocab import LABEL_SPACE, OWNERS, SPENDING_LABELS

_LABELS = ", ".join(f"'{n}'" for n in LABEL_SPACE)
# Usage prices per million tokens.
PRICES = ("1.00", "5.00")


def _rows(spark, sf):
    return view(spark, sf, "labelled").withColumn(
        "acceptable", evaluate.label_set(F.col("acceptable"))
    ).withColumn("ambiguous", F.size("acceptable") > 0)


def _predictions(spark, sf):
    rows = view(spark, sf, "predictions").withColumn(
        "acceptable", evaluate.label_set(F.col("acceptable"))
    )
    return rows.withColumn("correct", evaluate.is_correct(
        F.col("predicted"), F.col("gold"), F.col("acceptable")))


_JUDGED = """select *, case when predicted = 'UNKNOWN' then false
   when acceptable is not null then list_contains(string_split(acceptable, '|'), predicted)
   else predicted = gold end as correct from predictions"""


@query("c16_gold_label", duck("labelled", """
select transaction_id, gold, agreed, case when acceptable is not null
   then list_contains(string_split(acceptable, '|'), 'LIVING_DINING') else gold = 'LIVING_DINING' end as correct
from labelled"""))
def c16(spark, sf):
    guess = F.lit("LIVING_DINING")
    return _rows(spark, sf).select(
        "transaction_id", evaluate.gold_label().alias("gold"), evaluate.annotators_agree().alias("agreed"),
        evaluate.is_correct(guess, evaluate.gold_label(), F.col("acceptable")).alias("correct"),
    )


@query("c17_recorded_correct", duck("predictions", "select transaction_id, system, correct from j", j=_JUDGED))
def c17(spark, sf):
    return _predictions(spark, sf).select("transaction_id", "system", "correct")


# ---- scores ------------------------------------------------------------------------


def _scores(source: str, keys: str) -> str:
    return f"""
select {keys}, label, support, predicted, {ratio4("tp", "predicted")} as precision, {ratio4("tp", "support")} as recall,
  {ratio4("2 * pi * ri", "(pi + ri) * 10000")} as f1
from (select *, ({ratio4("tp", "predicted")} * 10000)::bigint as pi, ({ratio4("tp", "support")} * 10000)::bigint as ri
  from (select {keys}, label, coalesce(sum(support), 0)::bigint as support,
          coalesce(sum(predicted), 0)::bigint as predicted, coalesce(sum(tp), 0)::bigint as tp
    from (select {keys}, gold as label, count(*) as support, 0 as predicted, count(*) filter (where correct) as tp
          from {source} group by all
          union all select {keys}, predicted, 0, count(*), 0 from {source} where predicted <> 'UNKNOWN' group by all)
    group by {keys}, label))"""


def _heads(source: str, scores: str, keys: str) -> str:
    return f"""
select h.*, macro_f1, weighted_f1, {ratio4("correct", "total")} as accuracy,
  {ratio4("total - abstentions", "total")} as coverage,
  case when total > abstentions then {ratio4("correct", "total - abstentions")} end as accuracy_when_answered
from (select {keys}, count(*) as total, count(*) filter (where correct) as correct,
        count(*) filter (where predicted = 'UNKNOWN') as abstentions from {source} group by all) h
join (select {keys}, {ratio4("sum((f1 * 10000)::bigint)", "count(*) * 10000")} as macro_f1,
        {ratio4("sum((f1 * 10000)::bigint * support)", "sum(support) * 10000")} as weighted_f1
      from {scores} group by all) using ({keys})"""


_STRATA = """
select *, 'overall' as stratum from j
union all select *, case when acceptable is null then 'unambiguous' else 'ambiguous' end from j
union all select *, case when agreed then 'annotators agreed' else 'annotators disagreed' end from j
where agreed is not null"""


@query("f10_label_scores", duck("predictions", _scores("j", "system"), j=_JUDGED))
def f10(spark, sf):
    cells = evaluate.answer_cells(_predictions(spark, sf), ["system"])
    return evaluate.label_scores(cells, ["system"])


@query("f10_system_scores", duck("predictions", _heads("j", "s", "system"), j=_JUDGED,
                                 s=_scores("j", "system")))
def f10_system(spark, sf):
    cells = evaluate.answer_cells(_predictions(spark, sf), ["system"])
    return evaluate.system_scores(cells, ["system"])


@query("f14_strata", duck("predictions", _heads("st", "s", "system, stratum"), j=_JUDGED, st=_STRATA,
                          s=_scores("st", "system, stratum")))
def f14(spark, sf):
    keys = ["system", "stratum"]
    cells = evaluate.answer_cells(evaluate.strata(_predictions(spark, sf)), keys)
    return evaluate.system_scores(cells, keys)


@query("f15_best_system", duck("predictions", """
select system, macro_f1 from h
order by macro_f1 desc, list_position(['rules', 'model', 'hybrid'], system) limit 1""",
    j=_JUDGED, s=_scores("j", "system"), h=_heads("j", "s", "system")))
def f15(spark, sf):
    cells = evaluate.answer_cells(_predictions(spark, sf), ["system"])
    best = evaluate.best_system(evaluate.system_scores(cells, ["system"]), ["rules", "model", "hybrid"])
    return best.select("system", "macro_f1")


@query("f11_top_confusions", duck("predictions", """
select system, gold, predicted, n, position from (
  select *, row_number() over (partition by system order by n desc, gold, predicted) as position
  from (select system, gold, predicted, count(*) as n from predictions where gold <> predicted group by all))
where position <= 10"""))
def f11(spark, sf):
    cells = evaluate.answer_cells(_predictions(spark, sf), ["system"])
    return evaluate.top_confusions(cells, ["system"], 10).withColumn("n", F.col("n").cast("bigint"))


def _kappa(rows: str, a: str, b: str) -> str:
    # agreement below chance makes kappa negative
    return f"""
select n as double_annotated, agreed, {ratio4("agreed", "n")} as raw_agreement,
  case when n * n <> e then {ratio4("n * agreed - e", "n * n - e")} end as kappa
from (select count(*)::hugeint as n, count(*) filter (where {a} = {b})::hugeint as agreed from {rows}),
  (select sum(x * y)::hugeint as e from
     (select {a} as l, count(*)::hugeint as x from {rows} group by 1)
     join (select {b} as l, count(*)::hugeint as y from {rows} group by 1) using (l))"""


@query("f12_kappa", duck("", "select double_annotated::bigint as double_annotated, agreed::bigint as agreed, raw_agreement, kappa from k",
                         k=_kappa("labels", "quality", "toxic")))
def f12(spark, sf):
    flags = view(spark, sf, "labels")
    return evaluate.kappa(flags, "quality", "toxic", [])


@query("f13_annotator_agreement", duck("labelled", "select double_annotated::bigint as double_annotated, agreed::bigint as agreed, raw_agreement, kappa from k",
    two="select * from labelled where secondary_label is not null",
    k=_kappa("two", "primary_label", "secondary_label")))
def f13(spark, sf):
    two = _rows(spark, sf).filter("secondary_label is not null")
    return evaluate.kappa(two, "primary_label", "secondary_label", [])


_SWEEP = f"""
select system, t::decimal(4,3) as threshold, {ratio4("answered", "total")} as coverage,
  {ratio4("rgt", "answered")} as accuracy_when_answered, total - answered as queued,
  answered, rgt, total, all_right
from (select system, t, count(*) filter (where confidence >= t) as answered,
        count(*) filter (where confidence >= t and correct) as rgt, count(*) as total,
        count(*) filter (where correct) as all_right
      from j, (select (unnest(range(0, 21)) * 0.05)::decimal(4,3) as t) group by all)"""


@query("f17_threshold_sweep", duck("predictions", """
select system, threshold, coverage, accuracy_when_answered, queued from sweep""", j=_JUDGED, sweep=_SWEEP))
def f17(spark, sf):
    sweep = evaluate.threshold_sweep(_predictions(spark, sf), evaluate.THRESHOLDS, ["system"])
    return sweep.select("system", "threshold", "coverage", "accuracy_when_answered", "queued")


@query("e12_threshold_answered", duck("predictions", """
select system, threshold, answered, rgt as right_answers, total from sweep""", j=_JUDGED, sweep=_SWEEP))
def e12(spark, sf):
    sweep = evaluate.threshold_sweep(_predictions(spark, sf), evaluate.THRESHOLDS, ["system"])
    return sweep.select("system", "threshold", "answered", F.col("right").alias("right_answers"), "total")


@query("f18_threshold_choice", duck("predictions", """
select system, arg_min(threshold, threshold) as threshold from (
  select *, rank() over (partition by system order by
    ((total - all_right) - (answered - rgt))::hugeint * all_right + rgt::hugeint * (total - all_right) desc) as r from sweep)
where r = 1 group by system""", j=_JUDGED, sweep=_SWEEP))
def f18(spark, sf):
    sweep = evaluate.threshold_sweep(_predictions(spark, sf), evaluate.THRESHOLDS, ["system"])
    return evaluate.choose_threshold(sweep, ["system"])


_DONE = "select * from model_calls where not failed"


@query("f24_usage", duck("model_calls", f"""
select system, calls, input_tokens, output_tokens, mean_latency_ms, p50_latency_ms, p95_latency_ms, failures,
  rejected, rows, cost, round(cost / rows, 8)::decimal(18,8) as cost_per_row
from (select *, ((input_tokens * 1 + output_tokens * 5)::decimal(18,0) * 0.000001::decimal(6,6))::decimal(28,10) as cost from (
  select system, count(*) as rows, count(*) filter (where failed) as failures,
    count(*) filter (where rejected and not failed) as rejected from model_calls group by system)
  join (select system, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
    round_even(sum(latency_ms) / count(*), 0)::bigint as mean_latency_ms,
    list_sort(list(latency_ms)) as ls, ls[greatest(1, (50 * count(*) + 99) // 100)] as p50_latency_ms,
    ls[greatest(1, (95 * count(*) + 99) // 100)] as p95_latency_ms from done group by system) using (system))""",
    done=_DONE))
def f24(spark, sf):
    return evaluate.usage(view(spark, sf, "model_calls"), *PRICES)


_LINE = """concat_ws(chr(31), transaction_id, posted_on::varchar, description, merchant, amount::varchar,
  account_type, coalesce(primary_label, ''), coalesce(secondary_label, ''), coalesce(adjudicated_label, ''))"""


@query("f29_dataset_digest", duck("labelled", f"""
select count(*) as rows, sum(('0x' || substr(d, 1, 15))::bigint)::decimal(38,0) as digest_a,
  sum(('0x' || substr(d, 16, 15))::bigint)::decimal(38,0) as digest_b
from (select sha256({_LINE}) as d from labelled)"""))
def f29(spark, sf):
    columns = ["transaction_id", "posted_on", "description", "merchant", "amount", "account_type",
               "primary_label", "secondary_label", "adjudicated_label"]
    return evaluate.dataset_digest(view(spark, sf, "labelled"), columns, [])


# ---- split, rules, routing ---------------------------------------------------------

_SPLIT = """
select *, case when ('0x' || substr(sha256('merchant-split-v1' || chr(31) || merchant), 1, 8))::bigint % 10000 < 3000
  then 'holdout' else 'development' end as side from labelled"""
_RULES = """
select merchant, label as rule_label, n as hits, total, (n / total)::decimal(9,6) as consistency from (
  select merchant, gold as label, count(*) as n, sum(count(*)) over (partition by merchant)::bigint as total,
    row_number() over (partition by merchant order by count(*) desc, gold) as r
  from {source} group by merchant, gold) where r = 1"""
_DEV = _RULES.format(source="(select * from split where side = 'development')")
_RULED = """
select s.transaction_id, s.merchant, s.amount, s.row_no, s.gold,
  case when r.merchant is not null then 'merchant' when k.hit then 'keyword' when amount > 0 then 'sign' else 'abstain' end as reason,
  case reason when 'merchant' then r.rule_label when 'keyword' then 'TRANSFER' when 'sign' then 'INCOME' else 'UNKNOWN' end as predicted,
  case reason when 'merchant' then r.consistency when 'keyword' then 0.7 when 'sign' then 0.5 else 0 end::decimal(9,6) as confidence
from split s left join rules r on r.merchant = s.merchant,
  lateral (select contains(u, 'TRANSFER') or contains(u, 'XFER') or contains(u, 'TFR TO') or contains(u, 'TFR FROM')
             or contains(u, 'ZELLE') as hit from (select upper(s.description || ' ' || s.merchant) as u)) k"""
# The stand-in model: a fixed answer per row, some outside the taxonomy, some failed.
_ANSWERS = """
select *, case when row_no % 29 = 0 then 'GAMBLING' when row_no % 5 = 0 then 'LIVING_OTHER' when row_no % 23 = 0 then 'UNKNOWN' else gold end as raw_label,
  cast((row_no % 140 - 10) * 0.01 as decimal(9,6)) as raw_confidence, row_no % 37 = 0 as failed from {rows}"""
_CHECKED = f"""
select transaction_id, not failed and raw_label not in ({_LABELS}) as rejected, failed,
  case when failed or raw_label not in ({_LABELS}) then 'UNKNOWN' else raw_label end as predicted,
  case when failed or raw_label not in ({_LABELS}) then 0 else greatest(0, least(1, raw_confidence)) end::decimal(9,6) as confidence
from ans"""
_PIPE = {"split": _SPLIT, "rules": _DEV, "ruled": _RULED,
         "ans": _ANSWERS.format(rows="ruled"), "checked": _CHECKED}


def _split(spark, sf):
    return labelling.merchant_split(view(spark, sf, "labelled"))


def _fitted(spark, sf):
    return labelling.fit_rules(_split(spark, sf).filter("side = 'development'"))


def _answers(rows):
    """Precomputed model answers joined in by row; the contract checks follow."""
    return labelling.check_answers(
        rows.sparkSession.sql(_ANSWERS.format(rows="{rows}"), rows=rows)
    )


@query("j1_merchant_split", duck("labelled", "select transaction_id, side from split", split=_SPLIT))
def j1(spark, sf):
    return _split(spark, sf).select("transaction_id", "side")


@query("j1_split_refusals", duck("labelled", """
select gold, count(*) as rows, count(distinct merchant) as merchants, case when max(side) = 'development' then 'holdout' else 'development' end as empty_side
from split group by gold having count(distinct side) = 1""", split=_SPLIT.replace("3000", "100")))
def j1_refusals(spark, sf):
    # each label is a dataset of its own, of which one merchant in a hundred is to be held out
    return labelling.split_refusals(view(spark, sf, "labelled"), ["gold"], 1)


@query("n9_split_disjoint", duck("labelled", """
select side, count(*) as rows, count(distinct merchant) as merchants, 0::bigint as on_both from split group by side""",
    split=_SPLIT))
def n9(spark, sf):
    per = _split(spark, sf).groupBy("merchant", "side").agg(F.count("*").alias("rows"))
    sides = per.groupBy("merchant").agg(F.count("*").alias("sides"))
    return per.join(sides, "merchant").groupBy("side").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("merchants"),
        F.count_if(F.col("sides") > 1).alias("on_both"),
    )


@query("f16_fit_rules", duck("labelled", _RULES.format(source="labelled")))
def f16(spark, sf):
    return labelling.fit_rules(view(spark, sf, "labelled"))


@query("m2_rule_predictions", duck("labelled", """
select transaction_id, predicted, confidence, reason from ruled""", split=_SPLIT, rules=_DEV, ruled=_RULED))
def m2(spark, sf):
    return labelling.predict_rules(_split(spark, sf), _fitted(spark, sf)).select(
        "transaction_id", "predicted", "confidence", "reason"
    )


@query("e7_rule_lookup", duck("labelled", """
select side, count(*) as rows, count(*) filter (where reason = 'merchant') as known
from ruled join split using (transaction_id) group by side""", split=_SPLIT, rules=_DEV, ruled=_RULED))
def e7(spark, sf):
    return labelling.predict_rules(_split(spark, sf), _fitted(spark, sf)).groupBy("side").agg(
        F.count("*").alias("rows"), F.count_if(F.col("reason") == "merchant").alias("known")
    )


@query("m3_model_contract", duck("labelled", "select * from checked", **_PIPE))
def m3(spark, sf):
    return _answers(_split(spark, sf)).select("transaction_id", "rejected", "failed", "predicted", "confidence")


_HYBRID = """
select r.transaction_id,
  case when r.predicted <> 'UNKNOWN' and r.confidence >= 0.75 then r.predicted when c.predicted <> 'UNKNOWN' then c.predicted
       else r.predicted end as predicted,
  case when r.predicted <> 'UNKNOWN' and r.confidence >= 0.75 then r.confidence when c.predicted <> 'UNKNOWN' then c.confidence
       else r.confidence end as confidence,
  case when r.predicted <> 'UNKNOWN' and r.confidence >= 0.75 then 'rules' when c.predicted <> 'UNKNOWN' then 'model'
       when r.predicted <> 'UNKNOWN' then 'weak rule' else 'abstain' end as reason
from ruled r join checked c using (transaction_id)"""


def _hybrid(spark, sf):
    ruled = labelling.predict_rules(_split(spark, sf), _fitted(spark, sf))
    return labelling.hybrid(ruled, _answers, "transaction_id")


@query("m4_hybrid_routing", duck("labelled", _HYBRID, **_PIPE))
def m4(spark, sf):
    return _hybrid(spark, sf).select("transaction_id", "predicted", "confidence", "reason")


@query("m4_escalation_rate", duck("labelled", f"""
select count(*) as rows, count(*) filter (where reason <> 'rules') as escalated,
  {ratio4("count(*) filter (where reason <> 'rules')", "count(*)")} as escalation_rate from hyb""",
    **_PIPE, hyb=_HYBRID))
def m4_rate(spark, sf):
    return labelling.escalation_rate(_hybrid(spark, sf))


_CASCADE = """
select transaction_id, r.predicted, r.confidence, 'rules' as source from ruled r where r.predicted <> 'UNKNOWN'
union all select transaction_id, c.predicted, c.confidence, 'model' from ruled r join checked c using (transaction_id)
where r.predicted = 'UNKNOWN'"""


def _cascade(spark, sf):
    return labelling.cascade(_split(spark, sf), _fitted(spark, sf), _answers, "transaction_id")


@query("m5_cascade", duck("labelled", _CASCADE, **_PIPE))
def m5(spark, sf):
    return _cascade(spark, sf)


@query("f37_run_accounting", duck("labelled", """
select source, count(*) as rows, count(*) filter (where predicted = 'UNKNOWN') as abstained,
  case when source = 'model' then count(*) * 0.001913::decimal(9,6) else 0 end::decimal(28,6) as estimated_cost
from cas group by source""", **_PIPE, cas=_CASCADE))
def f37(spark, sf):
    return labelling.run_accounting(_cascade(spark, sf), "0.001913")


@query("m1_categoriser_view", duck("labelled", """
select transaction_id, merchant, description, amount, account_type from labelled"""))
def m1(spark, sf):
    return view(spark, sf, "labelled").select("transaction_id", *labelling.VIEW)


@query("e8_gold_with_predictions", duck("predictions", """
select p.system, count(*) as predictions, (select count(*) from labelled) as rows,
  count(*) = (select count(*) from labelled) as complete, count(*) filter (where p.predicted = l.gold) as exact
from predictions p join labelled l using (transaction_id) group by p.system"""))
def e8(spark, sf):
    gold = view(spark, sf, "labelled").select("transaction_id", F.col("gold").alias("label"))
    total = gold.agg(F.count("*").alias("rows")).withColumn("k", F.lit(1))
    said = view(spark, sf, "predictions").select("transaction_id", "system", "predicted")
    matched = said.join(gold, "transaction_id").groupBy("system").agg(
        F.count("*").alias("predictions"), F.count_if(F.col("predicted") == F.col("label")).alias("exact")
    )
    return matched.withColumn("k", F.lit(1)).join(total, "k").select(
        "system", "predictions", "rows", (F.col("predictions") == F.col("rows")).alias("complete"), "exact"
    )


# ---- failures ----------------------------------------------------------------------

_KEY = r"array_to_string(list_filter(regexp_split_to_array(upper(description), '\s+'), lambda w: w <> '')[1:2], ' ')"
_POLY = f"""select {_KEY} as merchant_key, count(distinct gold) as labels from labelled
 group by 1 having count(distinct gold) > 1"""
_FAILED = f"""
select transaction_id, gold, predicted, unnest(list_filter([
   case when wrong and confidence >= 0.80 then 'confident_but_wrong' end,
   case when wrong and confidence < 0.60 then 'abstention_would_have_been_better' end,
   case when wrong and rc and rp <> 'UNKNOWN' then 'rules_right_model_wrong' end,
   case when correct and not rc then 'model_right_rules_wrong' end,
   case when wrong and length(trim(description)) < 15 then 'thin_description' end,
   case when wrong and merchant_key in (select merchant_key from poly) then 'polysemous_merchant' end,
   case when wrong and agreed = false then 'annotation_passes_disagreed' end,
   case when predicted = 'UNKNOWN' then 'abstained' end], lambda x: x is not null)) as mode
from (select m.*, r.correct as rc, r.predicted as rp, l.description, {_KEY} as merchant_key,
        not m.correct and m.predicted <> 'UNKNOWN' as wrong
      from j m join j r on r.transaction_id = m.transaction_id and r.system = 'rules'
      join labelled l on l.transaction_id = m.transaction_id where m.system = 'model')"""


def _failure_rows(spark, sf):
    return failures.failure_rows(
        _predictions(spark, sf), view(spark, sf, "labelled"), "model", "rules"
    )


@query("f19_failure_modes", duck("predictions", "select mode, count(*) as rows from f group by mode",
                                 j=_JUDGED, poly=_POLY, f=_FAILED))
def f19(spark, sf):
    return failures.failure_modes(_failure_rows(spark, sf))


@query("f19_failure_pairs", duck("predictions", """
select mode, gold, predicted, n, position from (
  select *, row_number() over (partition by mode order by n desc, gold, predicted) as position
  from (select mode, gold, predicted, count(*) as n from f where predicted <> 'UNKNOWN' group by all))
where position <= 5""", j=_JUDGED, poly=_POLY, f=_FAILED))
def f19_pairs(spark, sf):
    return failures.failure_pairs(_failure_rows(spark, sf), 5)


@query("f20_failure_summary", duck("predictions", f"""
select system, count(*) as rows, count(*) filter (where predicted <> 'UNKNOWN') as answered,
  count(*) filter (where correct) as correct, count(*) filter (where predicted <> 'UNKNOWN' and not correct) as wrong,
  count(*) filter (where predicted = 'UNKNOWN') as abstained,
  {ratio4("sum((confidence * 1000)::bigint) filter (where correct)", "count(*) filter (where correct) * 1000")} as mean_confidence_right,
  {ratio4("sum((confidence * 1000)::bigint) filter (where predicted <> 'UNKNOWN' and not correct)",
          "count(*) filter (where predicted <> 'UNKNOWN' and not correct) * 1000")} as mean_confidence_wrong
from j group by system""", j=_JUDGED))
def f20(spark, sf):
    return failures.failure_summary(_predictions(spark, sf), ["system"])


@query("f21_polysemous_merchants", duck("labelled", "select * from poly", poly=_POLY))
def f21(spark, sf):
    return failures.polysemous_merchants(view(spark, sf, "labelled"))


@query("e9_model_beside_rules", duck("predictions", """
select m.correct as model_correct, r.correct as rules_correct, count(*) as rows
from j m join j r using (transaction_id) where m.system = 'model' and r.system = 'rules' group by all""", j=_JUDGED))
def e9(spark, sf):
    return failures.side_by_side(_predictions(spark, sf), "model", "rules").groupBy(
        F.col("m.correct").alias("model_correct"), F.col("r.correct").alias("rules_correct")
    ).agg(F.count("*").alias("rows"))


_B, _A = "(select * from s where system = 'rules')", "(select * from s where system = 'model')"


def _two_runs(spark, sf):
    cells = evaluate.answer_cells(_predictions(spark, sf), ["system"])
    scores = evaluate.label_scores(cells, ["system"])
    return scores.filter("system = 'rules'"), scores.filter("system = 'model'")


@query("f23_label_movement", duck("predictions", f"""
select label, coalesce(b.support, a.support) as support, b.f1 as before, a.f1 as after,
  (a.f1 - b.f1)::decimal(18,4) as delta
from {_B} b full join {_A} a using (label) where coalesce(b.support, a.support) > 0""",
    j=_JUDGED, s=_scores("j", "system")))
def f23(spark, sf):
    return failures.label_movement(*_two_runs(spark, sf))


@query("f22_macro_decomposition", duck("predictions", f"""
select lb as labels_before, la as labels_after, (sb * 0.0001::decimal(9,4))::decimal(18,4) as summed_before,
  (sa * 0.0001::decimal(9,4))::decimal(18,4) as summed_after, macro_before, macro_after, macro_held,
  (macro_held - macro_before)::decimal(18,4) as gain_answers, (macro_after - macro_held)::decimal(18,4) as gain_denominator,
  no_longer_predicted
from (select *, {ratio4("sb", "lb * 10000")} as macro_before, {ratio4("sa", "lb * 10000")} as macro_held,
        {ratio4("sa", "la * 10000")} as macro_after
  from (select count(b.f1) as lb, count(a.f1) as la, sum((b.f1 * 10000)::bigint)::bigint as sb,
     sum((a.f1 * 10000)::bigint)::bigint as sa,
     coalesce(string_agg(label, ',' order by label) filter (where a.f1 is null), '') as no_longer_predicted
     from {_B} b full join {_A} a using (label)))""", j=_JUDGED, s=_scores("j", "system")))
def f22(spark, sf):
    return failures.macro_decomposition(*_two_runs(spark, sf))


@query("i1_label_union", duck("predictions", """
select system, gold as label from predictions union select system, predicted from predictions where predicted <> 'UNKNOWN'"""))
def i1(spark, sf):
    rows = view(spark, sf, "predictions")
    seen = rows.select("system", F.explode(F.array_compact(F.array(
        "gold", F.when(F.col("predicted") != "UNKNOWN", F.col("predicted"))))).alias("label"))
    return seen.distinct()


@query("i2_label_difference", duck("predictions", """
select 'never predicted' as side, system, label from (select system, gold as label from predictions except select system, predicted from predictions)
union all select 'never gold', system, label from (select system, predicted as label from predictions except select system, gold from predictions)"""))
def i2(spark, sf):
    rows = view(spark, sf, "predictions")
    gold, predicted = (rows.select("system", F.col(side).alias("label")) for side in ("gold", "predicted"))
    return evaluate.label_difference(gold, predicted, ["system"]).withColumn("side", F.lit("never predicted")).unionByName(
        evaluate.label_difference(predicted, gold, ["system"]).withColumn("side", F.lit("never gold")))


_CATEGORY_VALUES = ", ".join(f"('{n}', '{n.split('_')[0]}')" for n in SPENDING_LABELS)


@query("i4_category_ownership", duck("txn", f"""
select owner, count(distinct category) as categories, count(id) as rows from (values {_CATEGORY_VALUES}) c(category, owner)
left join txn on suggested_label = category group by owner"""))
def i4(spark, sf):
    # ownership of the categories the ledger uses, and its rows per owner
    owned = spark.createDataFrame(
        [(n, o) for n in SPENDING_LABELS for o in OWNERS if n.startswith(o + "_")], "category string, owner string"
    )
    used = view(spark, sf, "txn").groupBy(F.col("suggested_label").alias("category")).agg(F.count("*").alias("n"))
    return owned.join(used, "category", "left").groupBy("owner").agg(
        F.count("*").alias("categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    )


@query("n5_category_owned_once", duck("txn", f"""
select category, 1::bigint as owners, count(id) as rows from (values {_CATEGORY_VALUES}) c(category, owner)
left join txn on suggested_label = category group by category"""))
def n5(spark, sf):
    claims = spark.createDataFrame(
        [(n, o) for n in SPENDING_LABELS for o in OWNERS if n.startswith(o + "_")], "category string, owner string"
    ).groupBy("category").agg(F.count_distinct("owner").alias("owners"))
    used = view(spark, sf, "txn").groupBy(F.col("suggested_label").alias("category")).agg(F.count("*").alias("n"))
    return claims.join(used, "category", "left").select("category", "owners", F.coalesce("n", F.lit(0)).alias("rows"))


@query("f34_remembered_labels", duck("labelled", """
select merchant, arg_max(primary_label, row_no) as label from labelled where row_no % 5 <> 0 group by merchant"""))
def f34(spark, sf):
    rows = view(spark, sf, "labelled").select("merchant", "row_no", F.when(
        F.expr("row_no % 5 <> 0"), F.col("primary_label")).alias("label"))
    return labelling.remembered_labels(rows)


@query("d14_annotation_worklist", duck("labelled", """
select 'b' as pass, transaction_id from labelled where secondary_label is null
union all select 'final', transaction_id from labelled
where secondary_label <> primary_label and adjudicated_label is null"""))
def d14(spark, sf):
    rows = view(spark, sf, "labelled")
    passes = [labelling.annotation_worklist(rows, which).select(F.lit(which).alias("pass"), "transaction_id")
              for which in ("b", "final")]
    return passes[0].unionByName(passes[1])


# ---- annotation checks -------------------------------------------------------------

# The labelled rows as annotation text, with faults written in.
_ANNOTATED = """
select row_no + 2 as line,
  case when row_no % 401 = 0 then ' ' when row_no % 301 = 1 and row_no > 1 then 'E-2' else transaction_id end as transaction_id,
  case when row_no % 251 = 0 then '' else description end as description,
  case when row_no % 331 = 0 then '12.x' else cast(amount as string) end as amount,
  case when row_no % 211 = 0 then '' when row_no % 223 = 0 then 'LIVING_DINNER' else primary_label end as annotator_a_label,
  case when row_no % 227 = 0 then 'NOPE' else secondary_label end as annotator_b_label,
  case when row_no % 229 = 0 then 'X' else adjudicated_label end as final_label,
  case when row_no % 45 = 5 then gold when row_no % 60 = 5 then concat('GAMES|', gold) when row_no % 100 = 5 then 'LIVING_GYM|INCOME' else acceptable end as acceptable_labels,
  case when row_no % 40 = 5 then 'either reading' else '' end as ambiguity_note
from {labelled}"""
_ROW_ERRORS = f"""
select line, unnest(list_filter([
  case when trim(transaction_id) = '' then 'id_blank' end,
  case when trim(transaction_id) <> '' and line > min(line) over (partition by trim(transaction_id)) then 'id_duplicate' end,
  case when description = '' then 'description_blank' end,
  case when amount = '12.x' then 'amount_unreadable' end,
  case when annotator_a_label = '' then 'first_label_blank' end,
  case when annotator_a_label <> '' and annotator_a_label not in ({_LABELS}) then 'first_label_invalid' end,
  case when annotator_b_label not in ({_LABELS}) then 'second_label_invalid' end,
  case when final_label not in ({_LABELS}) then 'final_label_invalid' end,
  case when contains(acceptable_labels, 'GAMES') then 'accepted_label_invalid' end,
  case when acceptable_labels is not null and ambiguity_note = '' then 'ambiguity_unexplained' end,
  case when acceptable_labels is not null and not contains(acceptable_labels, '|') then 'one_accepted_label' end,
  case when acceptable_labels is not null and g <> '' and not list_contains(string_split(acceptable_labels, '|'), g) then 'gold_not_accepted' end
 ], lambda x: x is not null)) as code
from (select *, coalesce(final_label, annotator_a_label) as g from ann)"""


@query("f28_row_findings", duck("labelled", """
select 'error' as severity, code, count(*) as n, array_to_string(list(line order by line)[1:10], ',') as lines
from errs group by code""", ann=_ANNOTATED.replace("{labelled}", "labelled"), errs=_ROW_ERRORS))
def f28(spark, sf):
    rows = spark.sql(_ANNOTATED, labelled=view(spark, sf, "labelled"))
    return annotation_checks.error_findings(annotation_checks.row_errors(rows))


@query("f28_error_lines", duck("labelled", "select code, line from errs", ann=_ANNOTATED.replace("{labelled}", "labelled"), errs=_ROW_ERRORS))
def f28_lines(spark, sf):
    # every line with every fault; the findings name the first ten
    return annotation_checks.row_errors(spark.sql(_ANNOTATED, labelled=view(spark, sf, "labelled"))).select("code", "line")


@query("f28_dataset_findings", duck("labelled", """
select * from (
 select 'error' as severity, 'unresolved_disagreement' as code, count(*) filter (where agreed = false and adjudicated_label is null) as n from labelled
 union all select 'warning', 'overruled_agreement', count(*) filter (where agreed and adjudicated_label <> primary_label) from labelled
 union all select 'warning', 'ambiguous_share', case when count(acceptable) * 5 > count(*) then count(acceptable) else 0 end from labelled
 union all select 'warning', 'few_double_annotated', case when count(secondary_label) < 50 then count(secondary_label) else 0 end from labelled
 union all select 'warning', 'thin_classes', count(*) from (select gold from labelled group by gold having count(*) < 5)
 union all select 'warning', 'few_merchants', case when count(distinct merchant) < 10 then count(distinct merchant) else 0 end from labelled)
where n > 0"""))
def f28_dataset(spark, sf):
    return annotation_checks.dataset_findings(_rows(spark, sf))


@query("h5_top_merchants", duck("labelled", f"""
select merchant, n, {ratio4("n", "total")} as share from (select merchant, count(*) as n, (select count(*) from labelled) as total
from labelled group by merchant order by n desc, merchant limit 3)"""))
def h5(spark, sf):
    return annotation_checks.top_merchants(view(spark, sf, "labelled"))


# ---- subset ------------------------------------------------------------------------

_PEOPLE = r"""
select line_id, description, case when lower(description) like '%zelle%' then upper(person) end as person from peer_lines"""
_ALIASES = """
select person, 'PERSON_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as alias
from (select person, row_number() over (order by sha256(person)) as n from (select distinct person from people where person is not null))"""


@query("g8_alias_numbers", duck("peer_lines", "select * from aliases", people=_PEOPLE, aliases=_ALIASES))
def g8(spark, sf):
    return subset.numbered_aliases(view(spark, sf, "peer_lines"))


@query("c12_masked_counterparties", duck("peer_lines", """
select line_id, case when alias is null then description when line_id % 2 = 0 then 'Zelle payment to ' || alias
  else 'ZELLE TRANSFER FROM ' || alias end as masked from people left join aliases using (person)""",
    people=_PEOPLE, aliases=_ALIASES))
def c12(spark, sf):
    lines = view(spark, sf, "peer_lines").drop("person")
    return subset.mask_counterparties(lines, subset.numbered_aliases(lines)).select("line_id", "masked")


_CAPPED = """
select *, row_number() over (partition by merchant order by account_id, fingerprint, occurrence) as position,
  count(*) over (partition by merchant) as n from subset_rows"""
_BANDS = """
select *, least(((row_number() over (order by abs(amount), merchant) - 1) * 4) // count(*) over (), 3)::int as band
from capped where n = 1"""
_SIZES = """
select band, case when band < 3 then w // 4 else w - coalesce(sum(least(pool, w // 4)) filter (where band < 3) over (), 0) end as quota
from (select band, count(*) as pool from banded group by band),
  (select greatest(50000 - count(*), 0) as w from capped where n > 1 and position <= 3)"""
_CHOSEN = """
select evaluation_id, merchant, 'repeated' as kind from capped where n > 1 and position <= 3
union all
select evaluation_id, merchant, 'singleton' from (select *, row_number() over (partition by band
   order by sha256('seed-7' || evaluation_id), evaluation_id) as drawn from banded) join sizes using (band) where drawn <= quota"""


@query("g6_capped_merchants", duck("subset_rows", """
select evaluation_id, merchant, position from capped where n > 1 and position <= 3""", capped=_CAPPED))
def g6(spark, sf):
    return subset.cap_merchants(view(spark, sf, "subset_rows"), 3).select("evaluation_id", "merchant", "position")


@query("g7_amount_bands", duck("subset_rows", "select evaluation_id, band from banded", capped=_CAPPED, banded=_BANDS))
def g7(spark, sf):
    return subset.amount_bands(subset.singletons(view(spark, sf, "subset_rows"))).select("evaluation_id", "band")


@query("j2_evaluation_subset", duck("subset_rows", _CHOSEN, capped=_CAPPED, banded=_BANDS, sizes=_SIZES))
def j2(spark, sf):
    return subset.choose_subset(view(spark, sf, "subset_rows"), 3, 50000, "seed-7").select(
        "evaluation_id", "merchant", "kind"
    )


@query("a8_selection_manifest", duck("subset_rows", """
select c.account_id, count(*) as selected, sum(('0x' || substr(sha256(evaluation_id), 1, 15))::bigint)::decimal(38,0) as digest_a
from chosen join subset_rows c using (evaluation_id) group by c.account_id""",
    capped=_CAPPED, banded=_BANDS, sizes=_SIZES, chosen=_CHOSEN))
def a8(spark, sf):
    chosen = subset.choose_subset(view(spark, sf, "subset_rows"), 3, 50000, "seed-7")
    return evaluate.dataset_digest(chosen, ["evaluation_id"], ["account_id"]).select(
        "account_id", F.col("rows").alias("selected"), "digest_a"
    )


@query("c24_evaluation_id", duck("subset_rows", "select fingerprint, evaluation_id from subset_rows"))
def c24(spark, sf):
    return view(spark, sf, "subset_rows").select("fingerprint", identity.evaluation_id(
        F.col("account_id"), F.col("fingerprint"), F.col("occurrence")).alias("evaluation_id"))


@query("a12_dataset_merge", duck("labelled", """
select transaction_id, primary_label from labelled where row_no % 3 <> 0
union all select transaction_id, gold from labelled where row_no % 3 = 0"""))
def a12(spark, sf):
    rows = view(spark, sf, "labelled")
    # two sides that overlap and together hold every row
    existing = rows.filter("row_no % 3 <> 0").select("transaction_id", "primary_label")
    incoming = rows.filter("row_no % 3 <> 1").select("transaction_id", F.col("gold").alias("primary_label"))
    return merge_unseen(existing, incoming, ["transaction_id"])
