"""Ledgers derived from the given tables, as SQL that Spark and DuckDB both run.

Each text names its inputs in braces; ``spark_view`` binds them to DataFrames and
``duck`` renders the same texts as CTEs, so an operator and its oracle start from
identical rows. ``SHA[[x]]`` stands for the SHA-256 hex of a string, the one
function the two dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallystone.session import spread
from tallystone.vocab import SPENDING_LABELS

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_ROW_ID = (
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string), "
    "cast(cast(round(l_extendedprice * 100) as bigint) as string))"
)

DERIVED: dict[str, str] = {}

# One row per card or bank line; the account is the supplier, labels follow the keys.
DERIVED["txn_base"] = f"""
select {_ROW_ID} as id,
       l_suppkey as account_id, l_partkey as part_id, l_orderkey as order_id,
       l_linenumber as line_no, l_linestatus as line_status,
       cast(l_shipdate as date) as posted_on,
       case l_suppkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end as currency,
       cast(case when l_returnflag = 'R' or l_linenumber = 6 then 1 else -1 end
            * case when l_partkey % 17 = 0 then -1 else 1 end
            * cast(l_extendedprice as decimal(18,2)) as decimal(18,2)) as amount,
       cast(l_quantity as int) as quantity,
       cast(l_discount * 10 as decimal(4,3)) as score,
       case when l_partkey % 11 = 0 then null
            when l_partkey % 13 = 0 then 'UNKNOWN'
            when l_returnflag = 'R' then 'REFUND'
            when l_linenumber = 7 then 'TRANSFER'
            when l_linenumber = 6 then 'INCOME'
            else split_part('{",".join(SPENDING_LABELS)}', ',', cast(l_partkey % 29 as int) + 1)
       end as label
from {{lineitem}}
"""

DERIVED["txn"] = """
select id, account_id, part_id, order_id, line_no, posted_on, currency, amount, quantity,
       case when line_status = 'F' and part_id % 5 = 0 and label is not null
            then 'LIVING_OTHER' else label end as suggested_label,
       case when label is null or part_id % 19 = 0 then null else score end
           as suggested_confidence,
       case when line_status = 'F' then label end as confirmed_label
from {txn_base}
"""

DERIVED["accounts"] = """
select s_suppkey as account_id, s_nationkey as tenant_id, s_name as account_name
from {supplier}
"""

DERIVED["merchants"] = """
select p_partkey as part_id, upper(concat(p_name, ' ', p_type)) as merchant
from {part}
"""

# txn plus merchant text and tenant.
DERIVED["ledger"] = """
select t.*, m.merchant, a.tenant_id,
       concat('SQ *', m.merchant, ' #', cast(t.account_id as string)) as description,
       coalesce(t.confirmed_label, t.suggested_label) as effective_label
from {txn} t
join {merchants} m on t.part_id = m.part_id
join {accounts} a on t.account_id = a.account_id
"""

# Statement deliveries: monthly or longer windows, some incremental.
DERIVED["batches"] = """
select o_orderkey as batch_id, o_custkey % 100 as account_id,
       SHA[[concat(cast(o_custkey % 100 as string), cast(cast(floor(o_totalprice) as bigint) % 5000 as string))]]
           as source_sha256,
       case when o_orderkey % 10 = 0 then 'incremental' else 'snapshot' end as mode,
       cast(o_orderdate as date) as window_start,
       cast(o_orderdate as date) + cast(o_orderkey % 45 as int) as window_end
from {orders}
"""

# Card charges with a clock time; equal amounts occur because values are whole.
DERIVED["charges"] = """
select event_id as seq, concat('CH-', cast(event_id as string)) as id,
       cast(ts as date) as posted_on,
       hour(ts) * 60 + minute(ts) as minute_of_day,
       user_id as account_id, event_type as merchant,
       cast(round(value) * 100 as decimal(18,2)) as amount,
       event_id % 3 <> 0 as receipt,
       case when cast(ts as date) < date '2024-01-08' then '2024-W01'
            when cast(ts as date) < date '2024-01-15' then '2024-W02'
            when cast(ts as date) < date '2024-01-22' then '2024-W03'
            else '2024-W04' end as period
from {events}
"""

# Parsed statement lines: one file per account and year, dense enough to repeat charges.
DERIVED["bank_rows"] = """
select id, account_id, part_id, order_id, currency,
       concat(cast(account_id as string), '-', cast(year(posted_on) as string)) as file_id,
       year(posted_on) as file_year, 2 + order_id * 8 + line_no as line,
       account_id % 7 as shape, account_id % 14 >= 7 as flipped,
       make_date(year(posted_on), quarter(posted_on) * 3, cast(1 + part_id % 28 as int)) as posted_on,
       concat('SHOP ', cast(part_id % 4 as string)) as merchant,
       cast(case when part_id % 5 = 0 then 1 else -1 end * (1 + quantity % 5) as decimal(18,2)) as amount,
       concat('T', id) as external_id,
       case when part_id % 43 = 0 then 'blank' when part_id % 37 = 0 then 'surplus'
            when part_id % 41 = 0 then 'short' when part_id % 47 = 0 then 'date'
            when part_id % 53 = 0 then 'description' when part_id % 59 = 0 then 'amount'
            when part_id % 61 = 0 then 'both' else 'fine' end as fault
from {txn}
"""

# The part of it an earlier run already stored.
DERIVED["stored_rows"] = "select * from {bank_rows} where part_id % 3 = 0"

# Planted cadences: regular, jittered, irregular, wild, zero, same-day and transfer series.
DERIVED["series_keys"] = """
select c_custkey as k, concat('SERIES ', cast(c_custkey as string)) as merchant,
       cast(1 + c_custkey % 24 as int) as n,
       case c_custkey % 5 when 0 then 7 when 1 then 14 when 2 then 30 when 3 then 91 else 365 end as step,
       cast(case when c_custkey % 50 = 0 then 0 else -1 end * abs(cast(c_acctbal as decimal(18,2)))
            as decimal(18,2)) as base
from {customer}
"""
DERIVED["series"] = """
select merchant, kind, date '2010-01-01' + cast(day as int) as posted_on,
       cast(base * factor as decimal(18,2)) as amount
from (select merchant, base, case when k % 12 = 0 then 'TRANSFER' else 'SPENDING' end as kind,
        case when k % 9 = 0 then i * step + i * i * 2
             when k % 8 = 0 then floor((i + 1) / 2) * step
             when k % 4 = 0 and step > 7 then i * step + (i * k) % 5 - 2
             else i * step end as day,
        case when k % 10 = 0 then cast(1 + i % 4 as decimal(9,2))
             when k % 6 = 0 and i * 3 >= n * 2 then cast(1.12 as decimal(9,2))
             else cast(1 as decimal(9,2)) end as factor
      from (select *, EACH[[n]] as i from {series_keys}) x) y
union all
select 'GROCER', 'SPENDING', date '2010-01-01' + cast(k % 3000 as int), base from {series_keys}
"""

# Labelled benchmark rows: two annotators, adjudication, some accepted alternatives.
_NAMES = ("LIVING_DINING,LIVING_GROCERY,LIVING_PHONE,LIVING_GYM,INCOME,TRANSFER,REFUND,"
          "HOUSING_UTILITIES,COMMUTE_FUEL,HEALTH_PREMIUM,LIVING_TRAVEL,RELOCATION_MOVE")


def _name(offset: str) -> str:
    return f"split_part('{_NAMES}', ',', cast((gi + {offset}) % 12 as int) + 1)"


DERIVED["labelled"] = f"""
select *, coalesce(adjudicated_label, primary_label) as gold,
       case when secondary_label is null then null else primary_label = secondary_label end as agreed,
       case when row_no % 20 = 5 then concat(coalesce(adjudicated_label, primary_label), '|', {_name("4")}) end
           as acceptable
from (
  select *, case when secondary_label <> primary_label then
                   case when row_no % 26 = 0 then null when row_no % 2 = 1 then secondary_label else primary_label end
                 when row_no % 101 = 0 then {_name("3")} end as adjudicated_label
  from (
    select *, {_name("0")} as primary_label,
           case when row_no % 3 = 0 then null when row_no % 13 = 0 then {_name("1")} else {_name("0")} end
               as secondary_label
    from (
      select event_id as row_no, user_id, concat('E-', cast(event_id as string)) as transaction_id,
             cast(ts as date) as posted_on,
             concat(upper(event_type), '-', cast(user_id as string)) as merchant,
             case when event_id % 6 = 0 then concat(upper(event_type), '-', cast(user_id as string))
                  when event_id % 35 = 0 then concat('Tfr to savings ', cast(event_id as string))
                  else concat('SQ *', upper(event_type), '-', cast(user_id as string), ' #', cast(event_id % 100 as string))
             end as description,
             cast(case when event_id % 8 = 0 then 1 else -1 end * cast(value as decimal(18,2)) as decimal(18,2)) as amount,
             'card' as account_type,
             user_id * 5 + case when event_id % 10 = 0 then 1 else 0 end as gi
      from {{events}}) a) b) c
"""

# Three systems' recorded answers for every labelled row.
DERIVED["predictions"] = f"""
select transaction_id, row_no, 'rules' as system, gold, acceptable, agreed,
       case when row_no % 4 = 0 then 'UNKNOWN' when row_no % 7 = 0 then {_name("2")} else gold end as predicted,
       cast(case when row_no % 4 = 0 then 0 else 0.5 + (row_no % 6) * 0.1 end as decimal(4,3)) as confidence
from {{labelled}}
union all
select transaction_id, row_no, 'model', gold, acceptable, agreed,
       case when row_no % 31 = 0 then 'UNKNOWN' when row_no % 9 = 0 then {_name("1")}
            when row_no % 40 = 5 then {_name("4")} else gold end,
       cast(case when row_no % 31 = 0 then 0 when row_no % 9 = 0 then (20 + row_no % 75) * 0.01
            else (100 - row_no % 60) * 0.01 end as decimal(4,3))
from {{labelled}}
union all
select transaction_id, row_no, 'hybrid', gold, acceptable, agreed,
       case when row_no % 62 = 0 then 'UNKNOWN' when row_no % 11 = 0 then {_name("1")} else gold end,
       cast(case when row_no % 62 = 0 then 0 when row_no % 11 = 0 then (20 + row_no % 75) * 0.01
            else (100 - row_no % 50) * 0.01 end as decimal(4,3))
from {{labelled}}
"""

# One row per model call.
DERIVED["model_calls"] = """
select transaction_id, system, 400 + (row_no * 37) % 1900 as latency_ms, 900 + row_no % 700 as input_tokens,
       60 + row_no % 90 as output_tokens, row_no % 211 = 0 as failed, row_no % 97 = 0 as rejected
from {predictions} where system <> 'rules'
"""

# Peer payments and other lines for masking.
DERIVED["peer_lines"] = """
select o_orderkey as line_id, case when o_orderkey % 3 = 0 then
         concat(case when o_orderkey % 2 = 0 then 'Zelle payment to ' else 'ZELLE TRANSFER FROM ' end, person,
                case when o_orderkey % 5 = 0 then concat(' REF', cast(1000 + o_orderkey % 9000 as string)) else '' end)
         else concat('CARD PURCHASE FROM ', person) end as description, person
from (select *, concat('Person ', split_part('Ada,Bea,Cy,Dee,Eli,Fay,Gus,Hal,Ida,Jo', ',', cast(o_custkey % 10 as int) + 1), ' ',
        split_part('Stone,Brook,Field,Marsh,Ridge,Vale,Wood,Hill,Glen,Ford,Dale', ',', cast(o_custkey % 11 as int) + 1)) as person
      from {orders}) x
"""

# Candidates for an evaluation subset; many merchants have one row only.
DERIVED["subset_rows"] = """
select account_id, concat('M', cast(order_id as string)) as merchant, amount,
       SHA[[id]] as fingerprint, 1 as occurrence,
       concat(cast(account_id as string), '-', substr(SHA[[id]], 1, 8), '-1') as evaluation_id
from {txn}
"""

# Scenario profiles: every customer compares a current job with a candidate one.
_CATS = ",".join(SPENDING_LABELS)
DERIVED["profiles"] = """
select k as pair_id, side, cast(g + case when side = 'candidate' then (k % 13 - 3) * 2500 else 0 end as decimal(18,2)) as base_salary,
       cast(g as decimal(18,2)) as observed_gross, cast(g * 72 as decimal(18,2)) * cast(0.01 as decimal(3,2)) as observed_net,
       cast(0.20 + (k % 8) * 0.01 as decimal(4,2)) as marginal_rate,
       cast(case when side = 'candidate' then (k % 4) * 2500 else 0 end as decimal(18,2)) as signing_bonus,
       (k % 3) * 6 as repayment_months,
       cast((k % 5) * 0.02 as decimal(4,2)) as bonus_rate, cast(0.5 + (k % 5) * 0.1 as decimal(4,2)) as bonus_probability,
       cast(case when side = 'candidate' then (k % 6) * 1000 else 0 end as decimal(18,2)) as relocation,
       cast(0.5 + (k % 2) * 0.5 as decimal(4,2)) as match_rate, cast(0.03 + (k % 3) * 0.01 as decimal(4,2)) as match_limit,
       cast(0.02 + (k % 5) * 0.01 as decimal(4,2)) as employee_rate, (k % 4) * 12 as match_vesting_months,
       cast((k % 3) * 500 as decimal(18,2)) as hsa_annual, cast(120 + k % 80 as decimal(18,2)) as premium_monthly,
       cast((k % 7) * 10000 as decimal(18,2)) as equity_total, 48 as equity_months, 12 as equity_cliff,
       cast(0.30 + (k % 3) * 0.05 as decimal(4,2)) as withholding_rate,
       cast(case when side = 'candidate' then (k % 11) * 0.5 else 3 end as decimal(4,1)) as onsite_days,
       46 + k % 5 as working_weeks, cast(40 as decimal(4,1)) as weekly_hours, 15 + k % 50 as commute_minutes,
       cast(1 + k % 4 as int) as household_size,
       case k % 3 when 0 then 'EVEN' when 1 then 'PERCENTAGE' else 'FIXED' end as split_method,
       cast((k % 10) * 10 + 5 as decimal(5,1)) as user_weight, cast(150 + k % 300 as decimal(18,2)) as user_fixed,
       case when k % 3 = 0 then 'NJ' else 'AL' end as home, case when k % 4 = 0 then 'NY' else 'AL' end as work_place,
       date '2026-01-01' as horizon_start, date '2026-04-01' as move_date
from (select k, g, case when s = 0 then 'current' else 'candidate' end as side
      from (select c_custkey as k, 40000 + (c_custkey * 137) % 90000 as g, EACH[[sides]] as s
            from (select *, 2 as sides from {customer}) b) c) d
"""

DERIVED["item_keys"] = """
select k, case when s = 0 then 'current' else 'candidate' end as side, 8 as n
from (select c_custkey as k, EACH[[sides]] as s from (select *, 2 as sides from {customer}) b) c
"""
DERIVED["cost_items"] = f"""
select k as pair_id, side, i as seq, category,
       cast(20 + (k * (i + 3) * 7) % 900 as decimal(18,2)) + cast((k % 100) * 0.01 as decimal(3,2)) as amount,
       case when category like 'RELOCATION%' or i = 7 then 'ONE_TIME' when i % 4 = 0 then 'ANNUAL' else 'MONTHLY' end as period,
       case when category like 'RELOCATION%' or i = 7 then 'ONE_TIME_CASH' else 'RECURRING_CASH' end as flow,
       case when side = 'current' then date '2025-06-01' when i % 3 = 0 then date '2026-01-01' else date '2026-04-01' end as effective_date,
       case i % 3 when 0 then 'ASSUMED' when 1 then 'USER_CONFIRMED' else 'SOURCED' end as evidence,
       i % 2 = 0 and category not like 'COMMUTE%' as is_shared
from (select *, split_part('{_CATS}', ',', cast((k * 3 + i * 5) % 29 as int) + 1) as category
      from (select *, EACH[[n]] as i from {{item_keys}}) x) y
"""

# Run logs of an agent that calls tools; some answers carry altered figures.
DERIVED["agent_runs"] = """
select o_orderkey as run_id, case when o_orderkey % 7 = 0 then 'fault' else 'plain' end as kind,
       cast(o_totalprice as decimal(18,2)) as total, cast(o_totalprice * 2 as decimal(18,2)) as double_total,
       case when o_orderkey % 17 = 0 then 'turn_limit' when o_orderkey % 19 = 0 then 'provider_failure' else 'finished' end as stopped_reason,
       o_orderkey % 5 as style, o_custkey
from {orders}
"""

_EACH = re.compile(r"EACH\[\[(\w+)\]\]")
_TOKEN = re.compile(r"SHA\[\[(.*?)\]\]", re.S)
_NAME = re.compile(r"\{(\w+)\}")


def _inputs(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


# Tables that grow with the scale; the others are small dimensions.
FACTS = {"lineitem", "orders", "events", "documents", "customer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(frame) if name in FACTS else frame


_VIEWS: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame; analysed once per session, never cached."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _VIEWS:
        if name not in DERIVED:
            _VIEWS[key] = table(spark, sf_dir, name)
        else:
            text = _TOKEN.sub(r"sha2(\1, 256)", DERIVED[name])
            text = _EACH.sub(r"explode(sequence(0, \1 - 1))", text)
            inputs = {used: view(spark, sf_dir, used) for used in _inputs(text)}
            _VIEWS[key] = spark.sql(text, **inputs)
    return _VIEWS[key]


def duck(names: str | list[str], body: str, **extra: str) -> str:
    """``body`` preceded by the CTEs for ``names``, their inputs and ``extra``."""
    wanted = names.split() if isinstance(names, str) else names
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in DERIVED:
            return
        for used in _inputs(DERIVED[name]):
            visit(used)
        ordered.append(name)

    for name in wanted:
        visit(name)
    parts = []
    for name in ordered:
        text = _EACH.sub(r"unnest(range(0, \1))", _TOKEN.sub(r"sha256(\1)", DERIVED[name]))
        parts.append(f"{name} as ({_NAME.sub(r'\1', text)})")
    parts += [f"{name} as ({text})" for name, text in extra.items()]
    return (f"with {', '.join(parts)} " if parts else "") + body


def ratio4(numerator: str, denominator: str) -> str:
    """DuckDB: numerator / denominator to four places, halves to even, from integers of any sign."""
    n, d = f"(abs({numerator})::hugeint * 10000)", f"(abs({denominator})::hugeint)"
    up = f"(({n} % {d}) * 2 > {d} or (({n} % {d}) * 2 = {d} and ({n} // {d}) % 2 = 1))"
    sign = f"(case when (({numerator}) < 0) <> (({denominator}) < 0) then -1 else 1 end)"
    return (
        f"(case when {d} = 0 then 0.0000::decimal(18,4) else "
        f"(({sign} * ({n} // {d} + case when {up} then 1 else 0 end))::decimal(28,0)"
        f" * 0.0001::decimal(9,4))::decimal(18,4) end)"
    )
