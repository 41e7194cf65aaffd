"""Readers and stores over text that is rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import scenario
from tallystone.operators.ranking import apart, running_total
from tallystone.plans.derived import duck, view
from tallystone.plans.q_scenario import _BASE, _COMPONENTS, _impacts
from tallystone.plans.registry import query
from tallystone.sources import annotated, bankfiles, stores

_HEIGHT = "(1 + case when part_id % 10 = 0 then 1 else 0 end)"
_BLANK = "(case when part_id % 15 = 0 then 1 else 0 end)"
_TEXT = """case when part_id % 10 = 0 then concat(merchant, ', first', chr(10), 'second "half"')
  when part_id % 7 = 0 then concat('say "hi" to ', merchant)
  when part_id % 11 = 0 then concat('5" ', merchant) else merchant end"""


def _lines(rows, whole):
    """Statement rows as lines of CSV text: quoted commas, quotes and newlines, stray
    quotes, blank lines."""
    rows = rows.select(
        "file_id", "id", "line", "part_id", "posted_on", "amount", F.expr(_TEXT).alias("said"),
        F.expr(_HEIGHT).alias("height"), F.expr(_BLANK).alias("blank"),
    )
    placed = running_total(
        rows, ["file_id"], F.floor(F.col("line") / 65536), ["line", "id"],
        (F.col("height") + F.col("blank")).cast("bigint"), "upto", whole,
    ).withColumn("above", F.col("upto") - F.col("height") - F.col("blank"))
    quoted = F.concat(F.lit('"'), F.replace("said", F.lit('"'), F.lit('""')), F.lit('"'))
    said = F.when(F.expr("part_id % 10 = 0 or part_id % 7 = 0"), quoted).otherwise(F.col("said"))
    text = F.concat_ws(",", F.col("posted_on").cast("string"), said, F.col("amount").cast("string"),
                       F.concat(F.lit('"'), "id", F.lit('"')))
    none, first = F.array().cast("array<string>"), F.col("above") == 0
    head = F.when(first, F.array(F.lit("Date,Details,Amount,Id"))).otherwise(none)
    parts = F.concat(head, F.split(text, "\n"), F.when(F.col("blank") == 1, F.array(F.lit(""))).otherwise(none))
    start = F.when(first, 1).otherwise(F.lit(2) + F.col("above"))
    return placed.select("file_id", start.alias("start"), F.posexplode(parts).alias("p", "text")).select(
        "file_id", (F.col("start") + F.col("p")).alias("line_no"), "text")


@query("a1_records_with_lines", duck("bank_rows", f"""
select file_id, (2 + sum({_HEIGHT} + {_BLANK}) over (partition by file_id order by line, id) - {_HEIGHT} - {_BLANK})::bigint as line,
  posted_on::varchar as date, {_TEXT} as details, amount::varchar as amount, id from bank_rows"""))
def a1(spark, sf):
    def named_rows(rows, whole):
        headers, records = bankfiles.split_header(bankfiles.records_from_lines(_lines(rows, whole), whole))
        return bankfiles.named_columns(headers, records, ["Date", "Details", "Amount", "Id"])

    # a file's rows are moved once and rendered, read as records and named where they lie
    named = apart(named_rows, ["file_id"], view(spark, sf, "bank_rows").select(
        "file_id", "id", "line", "part_id", "posted_on", "amount", "merchant"))
    return named.select("file_id", "line", F.col("Date").alias("date"), F.col("Details").alias("details"),
                        F.col("Amount").alias("amount"), F.col("Id").alias("id"))


_LABELLED_TEXT = """
select transaction_id, concat('  ', description, ' ') as description, cast(amount as string) as amount,
  case when row_no % 211 = 0 then ' ' else primary_label end as annotator_a_label, secondary_label as annotator_b_label,
  adjudicated_label as final_label, acceptable as acceptable_labels,
  case when acceptable is not null and row_no % 100 <> 5 then 'could be either' end as ambiguity_note,
  case when row_no % 4 = 0 then '' when row_no % 307 = 0 then '2024-02-30' else cast(posted_on as string) end as posted_on,
  case when row_no % 3 = 0 then '' else account_type end as account_type
from {labelled}"""


@query("a5_labelled_rows", duck("labelled", """
select transaction_id, case when annotator_a_label = ' ' then 'annotator_a_label is blank'
    when acceptable_labels is not null and ambiguity_note is null then 'acceptable_labels without an ambiguity_note'
    when posted_on = '2024-02-30' then 'posted_on is not an ISO date' end as error,
  case when posted_on = '' then date '1970-01-01' else try_cast(posted_on as date) end as posted_on,
  case when account_type = '' then 'unknown' else account_type end as account_type, 'manual_annotation' as source,
  amount::decimal(18,2) as amount, annotator_b_label as secondary_label, acceptable_labels is not null as ambiguous
from t""", t=_LABELLED_TEXT.replace("{labelled}", "labelled")))
def a5(spark, sf):
    rows = spark.sql(_LABELLED_TEXT, labelled=view(spark, sf, "labelled"))
    return annotated.typed_labels(rows).select(
        "transaction_id", "error", "posted_on", "account_type", "source",
        F.col("amount").cast("decimal(18,2)").alias("amount"), "secondary_label", "ambiguous")


# Charges as file text with one fault at most per row; a file per user.
_CHARGE_TEXT = """
select concat('U', cast(user_id as string)) as file_id, event_id + 2 as line, case when event_id % 97 = 0 then 6 else 7 end as cells,
  case when event_id % 101 = 0 then '' when event_id % 103 = 0 then 'SAME' else concat('C', cast(event_id as string)) end as id,
  case when event_id % 107 = 0 then '2024-02-30' when event_id % 2 = 0 then '2024-02-11' else cast(cast(ts as date) as string) end as posted_on,
  case when event_id % 109 = 0 then '9:05' when event_id % 113 = 0 then '24:00' else '09:05' end as posted_time,
  case when event_id % 127 = 0 then '   ' else concat(' ', event_type, ' ') end as merchant, 'Software' as category,
  case when event_id % 131 = 0 then '1.001' when event_id % 137 = 0 then 'NaN' when event_id % 139 = 0 then '1000000.01'
       when event_id % 149 = 0 then '0' else '12.50' end as amount,
  case when event_id % 151 = 0 then 'maybe' when event_id % 3 = 0 then 'false' else 'true' end as receipt
from {events}"""
_CHARGE_JUDGED = """
select file_id, line, id, case when cells <> 7 then 'wrong field count'
  when id = '' or line > min(line) over (partition by file_id, id) then 'invalid id'
  when trim(merchant) = '' then 'invalid text' when posted_on = '2024-02-30' then 'invalid date'
  when posted_time in ('9:05', '24:00') then 'needs a local HH:MM time' when amount <> '12.50' then 'invalid amount'
  when receipt = 'maybe' then 'invalid receipt flag' end as reason, posted_on from t"""


def _charges(spark, sf):
    return annotated.judge_charges(spark.sql(_CHARGE_TEXT, events=view(spark, sf, "events")))


@query("a9_charge_rows", duck("", "select file_id, line, id, reason from j",
                              t=_CHARGE_TEXT.replace("{events}", "events"), j=_CHARGE_JUDGED))
def a9(spark, sf):
    return _charges(spark, sf).select("file_id", "line", "id", "reason")


@query("a9_charge_files", duck("", """
select *, refused = 0 and months = 2 as accepted from (select file_id, count(*) as rows, count(reason) as refused,
  count(distinct posted_on[:7]) filter (where reason is null) as months from j group by file_id)""",
    t=_CHARGE_TEXT.replace("{events}", "events"), j=_CHARGE_JUDGED))
def a9_files(spark, sf):
    return annotated.charge_files(_charges(spark, sf))


# Rendered score reports, one per order: two systems with a headline block and label rows.
def _reports(spark, sf):
    orders = view(spark, sf, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    four = F.lpad((key % 10000).cast("string"), 4, "0")

    def block(header, shift):
        return [
            F.lit(header), F.lit("scored 135 rows"),
            F.concat(F.lit("  macro F1              0."), four),
            F.concat(F.lit("  abstentions           "), ((key + shift) % 90).cast("string")),
            F.lit(""), F.lit("  label                                  P       R      F1     n"),
            F.concat(F.lit("  LIVING_DINING                     0."), four, F.lit("  1.0000  0.5000    "), (key % 40).cast("string")),
            F.concat(F.lit("  INCOME                                 0  0.0000       0     "), F.lit(str(shift))),
        ]

    lines = F.array(
        F.lit("EVALUATION REPORT"), F.lit("  coverage              0.9999"), *block("--- rules", 1), F.lit(""),
        *block("--- model", 2), F.concat(F.lit("  tokens: "), key.cast("string"), F.lit(" in, 12 out")),
        F.lit("  cost: total 0.2583, per row 0.001913"), F.lit("  latency: mean 1472ms   p50 1407ms   p95 1781ms"),
        F.lit("SUMMARY"), F.lit("  coverage              0.1111"),
    )
    return orders.select(key.cast("string").alias("file_id"), F.posexplode(lines).alias("line_no", "text"))


@query("a10_report_label_scores", duck("", """
select o_orderkey::varchar as file_id, section, 'LIVING_DINING' as label, ((o_orderkey % 10000) * 0.0001::decimal(5,4))::decimal(9,4) as precision,
  1::decimal(9,4) as recall, 0.5::decimal(9,4) as f1, o_orderkey % 40 as support from orders, s
union all select o_orderkey::varchar, section, 'INCOME', 0, 0, 0, shift from orders, s""",
    s="select '--- rules' as section, 1 as shift union all select '--- model', 2"))
def a10_labels(spark, sf):
    return annotated.report_label_scores(_reports(spark, sf))


@query("a10_report_metrics", duck("", """
select o_orderkey::varchar as file_id, section, metric, value::decimal(28,6) as value from (
  select o_orderkey, section, unnest(['macro F1', 'abstentions']) as metric,
     unnest([((o_orderkey % 10000) * 0.0001::decimal(5,4))::decimal(18,4), ((o_orderkey + shift) % 90)::decimal(18,4)]) as value from orders, s
  union all select o_orderkey, '--- model', unnest(['input tokens', 'output tokens', 'cost total', 'cost per row', 'latency mean', 'latency p50', 'latency p95']),
     unnest([o_orderkey::decimal(18,6), 12, 0.2583, 0.001913, 1472, 1407, 1781]) from orders)""",
    s="select '--- rules' as section, 1 as shift union all select '--- model', 2"))
def a10(spark, sf):
    return annotated.report_metrics(_reports(spark, sf))


@query("g9_report_sections", duck("", """
select section, sum(n)::bigint as lines from (select unnest(['--- rules', '--- model']) as section, unnest([9, 11]) as n from orders) group by section"""))
def g9(spark, sf):
    return annotated.report_sections(_reports(spark, sf)).groupBy("section").agg(F.count("*").alias("lines"))


@query("a11_accepted_runs", duck("profiles cost_items", """
select o_orderkey as run_id from orders where o_orderkey % 11 <> 0 and o_orderkey % 4 <> 0"""))
def a11(spark, sf):
    orders = view(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    months = orders.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("month")).withColumn(
        "residual", F.when(F.expr("run_id % 11 = 0 and month = 1"), F.lit("0.01")).otherwise("0").cast("decimal(18,2)"))
    return stores.accepted_runs(orders, months, orders.filter("run_id % 4 = 0"))


@query("a11_run_components", duck("profiles cost_items", """
select pair_id as run_id, row_number() over (partition by pair_id order by abs(delta) desc, code) - 1 as position, code,
  round(current_cash, 2)::decimal(18,2) as current_cash, round(candidate_cash, 2)::decimal(18,2) as candidate_cash, round(delta, 2)::decimal(18,2) as delta
from comp""", **_BASE, comp=_COMPONENTS))
def a11_components(spark, sf):
    deltas = scenario.component_deltas(_impacts(spark, sf)).withColumnRenamed("pair_id", "run_id")
    return stores.run_components(deltas).withColumn("position", F.col("position").cast("bigint"))


@query("h3_recent_runs", duck("", """
select o_orderkey as run_id, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey limit 20"""))
def h3(spark, sf):
    runs = view(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return stores.recent_runs(runs)


@query("a13_account_registration", duck("", """
select c_nationkey as tenant_id, lower(c_mktsegment) || '-card' as account_key, arg_min(c_mktsegment || ' card', c_custkey) as display_name
from customer where not (c_nationkey % 5 = 0 and c_mktsegment = 'BUILDING') group by all"""))
def a13(spark, sf):
    customer = view(spark, sf, "customer")
    names = customer.select(
        F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("position"),
        F.concat(F.lit(" "), "c_mktsegment", F.lit(" card")).alias("display_name"))
    existing = customer.select(F.col("c_nationkey").alias("tenant_id")).distinct().filter(
        "tenant_id % 5 = 0").withColumn("account_key", F.lit("building-card"))
    return stores.register_accounts(names, existing)
