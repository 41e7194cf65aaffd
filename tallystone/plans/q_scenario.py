"""Scenario comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import dates
from tallystone.operators import scenario
from tallystone.plans.derived import duck, view
from tallystone.plans.registry import query
from tallystone.session import written

MONTHS = 36
BOUNDS = (20000, 300000)


def _half_up(value: str, unit: int) -> str:
    """DuckDB: a six-place decimal divided by unit/10000 and rounded to cents, halves up."""
    n = f"(({value}) * 1000000::decimal(7,0))::hugeint"
    return f"((sign({n})::hugeint * ((abs({n}) * 2 + {unit}) // {2 * unit}))::decimal(28,0) * 0.01::decimal(3,2))::decimal(28,2)"


def _cents(value: str) -> str:
    return _half_up(value, 10000)


def _twelfth(value: str) -> str:
    return _half_up(value, 120000)


_NET = "greatest(least(observed_net + (base_salary - observed_gross) * (1 - marginal_rate), base_salary), 0)::decimal(28,6)"
_BONUS = "(base_salary * bonus_rate * bonus_probability * (1 - marginal_rate))::decimal(28,6)"
_HOURS = """(((onsite_days * 10)::bigint * working_weeks * commute_minutes * 2 * 1000000 * 2 + 600) // 1200)::decimal(28,0)
  * 0.000001::decimal(7,6)"""
_ITEMS = """
select c.*, null::date as ends_before, false as is_inherited from cost_items c
union all
select c.pair_id, 'candidate', c.seq, c.category, c.amount, c.period, c.flow, c.effective_date, c.evidence, c.is_shared, p.move_date, true
from cost_items c join profiles p on p.pair_id = c.pair_id and p.side = 'candidate'
where c.side = 'current' and c.flow = 'RECURRING_CASH' and c.effective_date < p.move_date
 and c.category not in (select o.category from cost_items o where o.pair_id = c.pair_id and o.side = 'candidate'
      and o.flow = 'RECURRING_CASH' and o.effective_date < p.move_date)"""
_SHARE = """(case when household_size = 1 then (amount * 100)::bigint
  when split_method = 'FIXED' then least((user_fixed * 100)::bigint, (amount * 100)::bigint)
  when split_method = 'PERCENTAGE' then (2 * (amount * 100)::bigint * (user_weight * 10)::bigint + 1000) // 2000
  else ((amount * 100)::bigint + household_size - 1) // household_size end)::decimal(18,0) * 0.01::decimal(3,2)"""
_COSTS = f"""
select pair_id, side, lower(category) || case when is_inherited then '_inherited_' else '_' end ||
   (row_number() over (partition by pair_id, side, split_part(category, '_', 1) order by is_inherited, seq) - 1) as code,
  split_part(category, '_', 1) as produced_by, period, effective_date, ends_before,
  (-(case when is_shared then {_SHARE} else amount end))::decimal(28,6) as cash, 0::decimal(28,6) as wealth, 0::decimal(28,6) as hours, evidence
from items join profiles using (pair_id, side)"""


def _impact(code, by, period, cash="0", wealth="0", hours="0", evidence="DERIVED", when="true"):
    return f"""select pair_id, side, '{code}' as code, '{by}' as produced_by, '{period}' as period,
 horizon_start as effective_date, null::date as ends_before, ({cash})::decimal(28,6) as cash,
 ({wealth})::decimal(28,6) as wealth, ({hours})::decimal(28,6) as hours, '{evidence}' as evidence from profiles where {when}"""


_PROFILE = " union all ".join([
    _impact("take_home_pay", "LIVING", "ANNUAL", _NET),
    _impact("signing_bonus", "LIVING", "ONE_TIME", "signing_bonus * (1 - marginal_rate)", when="signing_bonus > 0"),
    _impact("target_bonus", "LIVING", "ANNUAL", _BONUS, when="bonus_rate > 0"),
    _impact("relocation_reimbursement", "LIVING", "ONE_TIME", "relocation", evidence="ASSUMED", when="relocation > 0"),
    _impact("employer_retirement_match", "HEALTH", "ANNUAL", wealth="base_salary * least(employee_rate, match_limit) * match_rate"),
    _impact("employer_hsa_contribution", "HEALTH", "ANNUAL", wealth="hsa_annual", evidence="ASSUMED"),
    _impact("employee_health_premium", "HEALTH", "MONTHLY", "-premium_monthly", evidence="ASSUMED"),
    _impact("vested_equity", "LIVING", "HORIZON_CUMULATIVE",
            wealth="equity_total * 0.75::decimal(3,2) * (1 - withholding_rate)", when="equity_total > 0"),
    _impact("unvested_equity", "LIVING", "HORIZON_CUMULATIVE", when="equity_total > 0"),
    _impact("commute_time", "COMMUTE", "ANNUAL", hours=_HOURS, when="onsite_days > 0"),
])
_IMPACTS = "select * from prof union all select * from costs"
_ACTIVE = f"""
select pair_id, side, m as month_index, ms as month_start, code, produced_by, period,
  case when cash = 0 then 'NOT_CASH' when period = 'ONE_TIME' then 'ONE_TIME' when cash > 0 then 'INCOME' else 'SPENDING' end as bucket,
  (case when period = 'ANNUAL' then cash else cash * 12 end)::decimal(28,6) as cash12
from (select i.*, m, (date '2026-01-01' + to_months(m::int))::date as ms from impacts i, (select unnest(range(0, {MONTHS})) as m))
where period <> 'HORIZON_CUMULATIVE' and (ends_before is null or ms < ends_before)
 and case when period = 'ONE_TIME' then date_trunc('month', effective_date) = date_trunc('month', ms)
             or (m = 0 and effective_date < ms) else effective_date <= ms or m = 0 end"""
_MONTHLY = """
select *, sum(net12) over (partition by pair_id, side order by month_index) as closing12 from (
 select pair_id, side, month_index, month_start, coalesce(sum(cash12) filter (where bucket = 'INCOME'), 0) as income12,
  coalesce(sum(cash12) filter (where bucket = 'SPENDING'), 0) as spending12,
  coalesce(sum(cash12) filter (where bucket = 'ONE_TIME'), 0) as one_time12, sum(cash12) as net12
 from active group by all)"""
_DELTA = """
select pair_id, month_index, sum(net12) over (partition by pair_id order by month_index) as delta12 from (
 select pair_id, month_index, sum(case when side = 'candidate' then cash12 else -cash12 end) as net12 from active group by all)"""
_YEAR = "case period when 'MONTHLY' then cash * 12 when 'HORIZON_CUMULATIVE' then 0 else cash end"
_COMPONENTS = f"""
select coalesce(l.pair_id, r.pair_id) as pair_id, coalesce(l.code, r.code) as code,
  coalesce(l.v, 0)::decimal(28,6) as current_cash, coalesce(r.v, 0)::decimal(28,6) as candidate_cash,
  (coalesce(r.v, 0) - coalesce(l.v, 0))::decimal(28,6) as delta
from (select pair_id, code, sum({_YEAR}) as v from impacts where side = 'current' group by all) l
full join (select pair_id, code, sum({_YEAR}) as v from impacts where side = 'candidate' group by all) r
 on l.pair_id = r.pair_id and l.code = r.code"""
_BASE = dict(items=_ITEMS, costs=_COSTS, prof=_PROFILE, impacts=_IMPACTS)
_FULL = dict(_BASE, active=_ACTIVE, monthly=_MONTHLY)
_FINAL = f"""
select p.*, t.closing12 as target12, a.closing12 as achieved12,
  coalesce((select sum(cash12) from active x where x.pair_id = p.pair_id and x.side = 'candidate'
            and x.produced_by = 'COMMUTE'), 0) as commute12
from profiles p join monthly t on t.pair_id = p.pair_id and t.side = 'current' and t.month_index = {MONTHS - 1}
join monthly a on a.pair_id = p.pair_id and a.side = 'candidate' and a.month_index = {MONTHS - 1}
where p.side = 'candidate'"""
_SOLVE = dict(_FULL, final=_FINAL)


def _d(names, body, parts, **more):
    return duck(names, body, **parts, **more)


def _profiles(spark, sf):
    return view(spark, sf, "profiles")


def _impacts(spark, sf):
    return scenario.all_impacts(_profiles(spark, sf), view(spark, sf, "cost_items"), MONTHS)


def _active(spark, sf):
    return scenario.active_impacts(_impacts(spark, sf), _profiles(spark, sf), MONTHS)


def _projected(spark, sf):
    return scenario.project_months(_impacts(spark, sf), _profiles(spark, sf), MONTHS)


def _pairs(spark, sf):
    """Candidate profiles with both sides' horizon cash and the commute's part of it."""
    impacts, profiles = _impacts(spark, sf), _profiles(spark, sf)
    totals = scenario.side_totals(scenario.project_months(impacts, profiles, MONTHS))
    commute = scenario.commute_totals(scenario.cash_spans(impacts, profiles, MONTHS))
    return profiles.filter("side = 'candidate'").join(totals, "pair_id").join(commute, "pair_id", "left").withColumn(
        "commute12", F.coalesce("commute12", F.lit(0).cast(scenario.EXACT)))


@query("k1_cost_impacts", _d("profiles cost_items", "select * exclude (wealth, hours) from costs", _BASE))
def k1(spark, sf):
    items = scenario.inherit_until_move(view(spark, sf, "cost_items"), _profiles(spark, sf))
    return scenario.cost_impacts(items, _profiles(spark, sf)).drop("wealth", "hours")


@query("k2_household_share", duck("profiles cost_items", f"""
select pair_id, side, seq, ({_SHARE})::decimal(18,2) as share, (amount - {_SHARE})::decimal(18,2) as others
from cost_items join profiles using (pair_id, side)"""))
def k2(spark, sf):
    # profiles grow with the customers: neither side is ever held whole by the driver
    rows = view(spark, sf, "cost_items").join(_profiles(spark, sf).hint("merge"), scenario.SIDE)
    share = scenario.household_share(F.col("amount"))
    return rows.select(*scenario.SIDE, "seq", share.alias("share"),
                       (F.col("amount") - share).cast("decimal(18,2)").alias("others"))


@query("k3_net_pay_model", duck("profiles", f"""
select pair_id, side, {_cents(_NET)} as annual_net, 0.28::decimal(18,6) as effective_rate,
  ((abs(base_salary - observed_gross)::bigint * 2000000 + observed_gross::bigint) // (2 * observed_gross::bigint))::decimal(18,0) * 0.000001::decimal(7,6) as distance,
  abs(base_salary - observed_gross) * 5 > observed_gross as far, base_salary <> observed_gross as extrapolated from profiles"""))
def k3(spark, sf):
    view_ = scenario.tax_view(_profiles(spark, sf))
    return view_.withColumn("distance", F.col("distance").cast("decimal(24,6)"))


_INCOME = "('take_home_pay', 'signing_bonus', 'target_bonus', 'relocation_reimbursement')"
_BENEFITS = "('employer_retirement_match', 'employer_hsa_contribution', 'employee_health_premium')"


@query("k4_income_impacts", _d("profiles", f"select pair_id, side, code, period, cash, evidence from prof where code in {_INCOME}", dict(prof=_PROFILE)))
def k4(spark, sf):
    return scenario.profile_impacts(_profiles(spark, sf), MONTHS).filter(f"code in {_INCOME}").select(
        *scenario.SIDE, "code", "period", "cash", "evidence")


@query("k4_first_year_cash", duck("profiles", f"""
select pair_id, side, {_cents("(base_salary + signing_bonus + base_salary * bonus_rate * bonus_probability)::decimal(28,6)")} as first_year_cash,
  signing_bonus > 0 and repayment_months >= 6 as bonus_at_risk_in_month_6 from profiles"""))
def k4_cash(spark, sf):
    salary = F.col("base_salary")
    cash = salary + F.col("signing_bonus") + salary * F.col("bonus_rate") * F.col("bonus_probability")
    return _profiles(spark, sf).select(
        *scenario.SIDE, scenario.cents(cash).alias("first_year_cash"),
        ((F.col("signing_bonus") > 0) & (F.col("repayment_months") >= 6)).alias("bonus_at_risk_in_month_6"))


@query("k5_benefits", _d("profiles", f"""
select p.pair_id, p.side, code, cash, wealth, case when match_vesting_months = 0 then 1
  else least((18 * 2000000 + match_vesting_months) // (2 * match_vesting_months), 1000000) * 0.000001::decimal(7,6) end::decimal(18,6) as vested_in_month_18
from prof p join profiles using (pair_id, side) where code in {_BENEFITS}""", dict(prof=_PROFILE)))
def k5(spark, sf):
    profiles = _profiles(spark, sf)
    vested = profiles.select(*scenario.SIDE, scenario.vested_fraction(F.lit(18)).alias("vested_in_month_18"))
    return scenario.profile_impacts(profiles, MONTHS).filter(f"code in {_BENEFITS}").select(
        *scenario.SIDE, "code", "cash", "wealth").join(vested, scenario.SIDE)


@query("k6_equity", duck("profiles", """
select pair_id, side, m as months, (case when m < 12 then 0 else (equity_total::bigint * least(m, 48) * 100 * 2 + 48) // 96 end)::decimal(28,0) * 0.01::decimal(3,2) as gross_vested,
  (case when m < 12 then 0 else (equity_total::bigint * least(m, 48) * ((1 - withholding_rate) * 100)::bigint * 2 + 48) // 96 end)::decimal(28,0) * 0.01::decimal(3,2) as net_vested
from profiles, (select unnest([6, 12, 25, 60]) as m)"""))
def k6(spark, sf):
    rows = _profiles(spark, sf).withColumn("months", F.explode(F.array(*[F.lit(m) for m in (6, 12, 25, 60)])))
    months = F.col("months")
    elapsed = F.least(months, F.col("equity_months"))
    net = F.when(months < F.col("equity_cliff"), F.lit(0)).otherwise(
        F.col("equity_total") * elapsed * (1 - F.col("withholding_rate")) / F.col("equity_months"))
    return rows.select(
        *scenario.SIDE, "months",
        scenario.cents(scenario.equity_vested(months)).cast("decimal(31,2)").alias("gross_vested"),
        F.round(net, 2).cast("decimal(31,2)").alias("net_vested"))


@query("k7_committed_hours", duck("profiles", f"""
select pair_id, side, ({_HOURS})::decimal(28,6) as commute_hours, (({_HOURS}) + weekly_hours * working_weeks)::decimal(28,6) as committed_hours
from profiles"""))
def k7(spark, sf):
    hours = scenario.commute_hours()
    return _profiles(spark, sf).select(
        *scenario.SIDE, hours.alias("commute_hours"),
        scenario.exact(hours + F.col("weekly_hours") * F.col("working_weeks")).alias("committed_hours"))


@query("k8_active_impacts", _d("profiles cost_items", """
select pair_id, side, code, bucket, min(month_start) as first_month, max(month_start) as last_month,
  count(*) as months, sum(cash12)::decimal(28,6) as cash12 from active group by all""", dict(_BASE, active=_ACTIVE)))
def k8(spark, sf):
    return _active(spark, sf).groupBy(*scenario.SIDE, "code", "bucket").agg(
        F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"),
        F.count("*").alias("months"), F.sum("cash12").cast(scenario.EXACT).alias("cash12"))


@query("k9_monthly_projection", _d("profiles cost_items", f"""
select pair_id, side, month_index::int as month_index, month_start, {_twelfth("closing12 - net12")} as opening_cash, {_twelfth("income12")} as income,
  {_twelfth("spending12")} as spending, {_twelfth("one_time12")} as one_time, {_twelfth("closing12")} as closing_cash,
  0::decimal(28,2) as residual from monthly""", _FULL))
def k9(spark, sf):
    return scenario.monthly_report(_projected(spark, sf))


@query("g4_running_cash", _d("profiles cost_items", f"""
select pair_id, side, month_index::int as month_index, {_twelfth("closing12")} as closing_cash from monthly""", _FULL))
def g4(spark, sf):
    return _projected(spark, sf).select(*scenario.SIDE, "month_index", scenario.twelfth(F.col("closing12")).alias("closing_cash"))


@query("n4_residuals", _d("profiles cost_items", """
select side, count(*) as months, 0::bigint as unbalanced from monthly group by side""", _FULL))
def n4(spark, sf):
    return _projected(spark, sf).groupBy("side").agg(
        F.count("*").alias("months"), F.count_if(F.col("residual12") != 0).alias("unbalanced"))


@query("g5_break_even", _d("profiles cost_items", f"""
select pair_id, {MONTHS} as horizon_months, min(case when delta12 >= 0 then month_index + 1 end)::int as first_crossing_month,
  (case when max(case when delta12 < 0 then month_index end) is null then 1
        when max(case when delta12 < 0 then month_index end) = {MONTHS - 1} then null
        else max(case when delta12 < 0 then month_index end) + 2 end)::int as stable_break_even_month
from d group by pair_id""", dict(_BASE, active=_ACTIVE, d=_DELTA)))
def g5(spark, sf):
    return scenario.break_even(scenario.cumulative_delta(_projected(spark, sf)))


@query("e6_component_deltas", _d("profiles cost_items", "select * from comp", dict(_BASE, comp=_COMPONENTS)))
def e6(spark, sf):
    return scenario.component_deltas(_impacts(spark, sf))


@query("h2_top_movers", _d("profiles cost_items", """
select pair_id, code, direction, delta, position from (select *, row_number() over (partition by pair_id, direction order by abs(delta) desc, code) as position
 from (select *, case when delta > 0 then 'improvement' else 'regression' end as direction from comp where delta <> 0)) where position <= 3""",
    dict(_BASE, comp=_COMPONENTS)))
def h2(spark, sf):
    return scenario.top_movers(scenario.component_deltas(_impacts(spark, sf)), 3).select(
        "pair_id", "code", "direction", "delta", "position")


@query("k10_comparison", _d("profiles cost_items", f"""
select c.pair_id, {_twelfth("c.delta12")} as cash_delta, annualised_cash_delta, wealth_delta, hours_delta
from d c join (select pair_id, {_cents(f"sum(w * ({_YEAR}))")} as annualised_cash_delta, {_cents("sum(w * wealth)")} as wealth_delta,
   {_cents("sum(w * hours)")} as hours_delta from (select *, case when side = 'candidate' then 1 else -1 end as w from impacts) group by pair_id) i using (pair_id)
where c.month_index = {MONTHS - 1}""", dict(_BASE, active=_ACTIVE, d=_DELTA)))
def k10(spark, sf):
    return scenario.comparison(_impacts(spark, sf), _projected(spark, sf))


@query("k10_cumulative_delta", _d("profiles cost_items", f"""
select pair_id, month_index::int as month_index, {_twelfth("delta12")} as cumulative_delta from d""", dict(_BASE, active=_ACTIVE, d=_DELTA)))
def k10_delta(spark, sf):
    return scenario.cumulative_delta(_projected(spark, sf)).select(
        "pair_id", "month_index", scenario.twelfth(F.col("delta12")).alias("cumulative_delta"))


@query("e11_inherited_costs", _d("profiles cost_items", "select * from items", dict(items=_ITEMS)))
def e11(spark, sf):
    return scenario.inherit_until_move(view(spark, sf, "cost_items"), _profiles(spark, sf))


@query("h6_derivation", _d("profiles cost_items", f"""
select pair_id, side, path, level, {_cents("sum(amount)")} as amount,
  case when level = 0 then 'DERIVED' else ['ASSUMED', 'DERIVED', 'USER_CONFIRMED', 'SOURCED'][min(r) + 1] end as evidence
from (select pair_id, side, unnest(['first_year_disposable_cash', 'first_year_disposable_cash/' || lower(produced_by),
        'first_year_disposable_cash/' || lower(produced_by) || '/' || code]) as path, unnest([0, 1, 2]) as level, {_YEAR} as amount,
        case evidence when 'ASSUMED' then 0 when 'DERIVED' then 1 when 'USER_CONFIRMED' then 2 else 3 end as r
      from impacts where cash <> 0 and period <> 'HORIZON_CUMULATIVE') group by pair_id, side, path, level""", _BASE))
def h6(spark, sf):
    return scenario.derivation(_impacts(spark, sf))


@query("h7_simple_cash_tree", duck("", """
select c_custkey as pair_id, unnest(['cash', 'cash/net_pay', 'cash/housing', 'cash/housing/rent', 'cash/housing/utilities', 'cash/commute', 'cash/living']) as path,
  unnest([n - r - u - c - l, n, -(r + u), -r, -u, -c, -l]) as amount
from (select c_custkey, abs(c_acctbal::decimal(18,2)) as n, (500 + c_custkey % 700)::decimal(18,2) as r, (50 + c_custkey % 90)::decimal(18,2) as u,
  (c_custkey % 200)::decimal(18,2) as c, (300 + c_nationkey * 10)::decimal(18,2) as l from customer)""".replace(") as amount\n", "::decimal(18,2)[]) as amount\n")))
def h7(spark, sf):
    rows = view(spark, sf, "customer").selectExpr(
        "c_custkey as pair_id", "abs(cast(c_acctbal as decimal(18,2))) as net_pay",
        "cast(500 + c_custkey % 700 as decimal(18,2)) as rent", "cast(50 + c_custkey % 90 as decimal(18,2)) as utilities",
        "cast(c_custkey % 200 as decimal(18,2)) as commute", "cast(300 + c_nationkey * 10 as decimal(18,2)) as living")
    return scenario.simple_cash_tree(rows)


# The gap is linear in salary on these profiles, so its zero is one division.
_SALARY = f"""
select pair_id, lo <= 0 and hi > 0 as bracketed, case when lo <= 0 and hi > 0 then s end::decimal(18,2) as equivalent_salary
from (select *, case when lo = 0 then {BOUNDS[0]} else {BOUNDS[0]} + (-lo + slope - 1) // slope end as s from (
  select pair_id, g0 + slope * {BOUNDS[0]} as lo, g0 + slope * {BOUNDS[1]} as hi, slope from (
   select pair_id, ((achieved12 - target12) * 1000000::decimal(7,0))::hugeint - ((base_salary * 1000000::decimal(7,0))::hugeint // 1000000) * slope as g0, slope
   from (select *, ({MONTHS} * (1 - marginal_rate) * (1 + bonus_rate * bonus_probability) * 1000000)::hugeint as slope from final))))"""


@query("k11_equivalent_salary", _d("profiles cost_items", "select * from sal", dict(_SOLVE, sal=_SALARY)))
def k11(spark, sf):
    return scenario.equivalent_salary(_pairs(spark, sf), *BOUNDS, MONTHS).select(
        "pair_id", "bracketed", "equivalent_salary")


_DAYS = f"""
select pair_id, required_days, required_days is not null as feasible,
  case when required_days is null then {_twelfth("target12 - (achieved12 - commute12)")} end as shortfall
from (select pair_id, target12, achieved12, commute12, case when achieved12 >= target12 then onsite_days
   else (select max(h) from (select (unnest(range(0, 12)) * 0.5)::decimal(4,1) as h) where h <= onsite_days
      and case when onsite_days = 0 then achieved12 - commute12 >= target12
          else (achieved12 - commute12) * onsite_days + commute12 * h >= target12 * onsite_days end) end::decimal(4,1) as required_days from final)"""


@query("k13_remote_days", _d("profiles cost_items", "select * from days", dict(_SOLVE, days=_DAYS)))
def k13(spark, sf):
    return scenario.remote_days(_pairs(spark, sf))


@query("k12_negotiation_levers", _d("profiles cost_items", f"""
select pair_id, {_twelfth("g")} as gap, lever, feasible, required_amount, required_days from (
  select pair_id, g, 'BASE_SALARY' as lever, g = 0 or coalesce(equivalent_salary > base_salary, false) as feasible,
    case when g = 0 then 0 else equivalent_salary - base_salary end::decimal(28,2) as required_amount, null::decimal(4,1) as required_days from w
  union all select pair_id, g, 'SIGNING_BONUS', true, case when g = 0 then 0 else
     ((((g * 1000000::decimal(7,0))::hugeint * 2 + 1200 * ((1 - marginal_rate) * 100)::hugeint) // (2400 * ((1 - marginal_rate) * 100)::hugeint))::decimal(28,0) * 0.01::decimal(3,2)) end::decimal(28,2), null from w
  union all select pair_id, g, 'RELOCATION_REIMBURSEMENT', true, {_twelfth("g")}, null from w
  union all select pair_id, g, 'REMOTE_DAYS', dfeasible, null, required_days from w)""",
    dict(_SOLVE, sal=_SALARY, days=_DAYS, w="""
select f.*, greatest(target12 - achieved12, 0) as g, s.equivalent_salary, d.required_days, d.feasible as dfeasible
from final f join sal s using (pair_id) join days d using (pair_id)""")))
def k12(spark, sf):
    pairs = written(_pairs(spark, sf), "pairs")  # all three below start from it
    return scenario.negotiation_levers(
        pairs, scenario.equivalent_salary(pairs, *BOUNDS, MONTHS), scenario.remote_days(pairs))


@query("k14_stale_inputs", duck("profiles", """
select pair_id, side, concat_ws(',', case when pair_id % 4 = 1 then 'base_salary' end, case when pair_id % 3 = 1 then 'home' end,
    case when pair_id % 5 = 2 then 'premium_monthly' end) as changed,
  pair_id % 4 = 1 or pair_id % 3 = 1 or pair_id % 5 = 2 as stale,
  (case when pair_id % 3 = 1 then 'CT' else home end) <> work_place as multi_jurisdiction from profiles"""))
def k14(spark, sf):
    observed = _profiles(spark, sf).withColumn("pay_frequency", F.lit("BIWEEKLY"))
    now = observed.withColumn(
        "base_salary", F.when(F.expr("pair_id % 4 = 1"), F.col("base_salary") + 1).otherwise(F.col("base_salary"))
    ).withColumn("home", F.when(F.expr("pair_id % 3 = 1"), "CT").otherwise(F.col("home"))).withColumn(
        "premium_monthly", F.when(F.expr("pair_id % 5 = 2"), F.col("premium_monthly") + 5).otherwise(F.col("premium_monthly")))
    return scenario.stale_inputs(observed, now)


@query("c18_period_conversion", duck("cost_items", f"""
select pair_id, side, seq, case when period = 'MONTHLY' then amount * 12 else amount end::decimal(28,2) as annual,
  case when period = 'MONTHLY' then amount::decimal(28,2) else {_twelfth("amount::decimal(28,6)")} end as monthly,
  (amount * 26)::decimal(28,2) as from_biweekly from cost_items where period <> 'ONE_TIME'"""))
def c18(spark, sf):
    amount, period = F.col("amount"), F.col("period")
    return view(spark, sf, "cost_items").filter("period <> 'ONE_TIME'").select(
        *scenario.SIDE, "seq", scenario.cents(scenario.to_annual(amount, period)).alias("annual"),
        scenario.cents(scenario.to_monthly(amount, period)).alias("monthly"),
        scenario.cents(scenario.paycheck_to_annual(amount, F.lit("BIWEEKLY"))).alias("from_biweekly"))


@query("c19_month_steps", duck("", """
select o_orderkey, i::int as step, (o_orderdate::date + to_months(i::int))::date as anchor,
  datediff('month', o_orderdate::date, e) - case when datediff('month', o_orderdate::date, e) > 0
     and (o_orderdate::date + to_months(datediff('month', o_orderdate::date, e)::int))::date > e then 1 else 0 end as whole_months
from (select *, o_orderdate::date + (o_orderkey % 400)::int as e from orders), (select unnest([0, 1, 2, 3]) as i)"""))
def c19(spark, sf):
    start = F.col("start")
    rows = view(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("start"),
        F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 400 as int))").alias("end"))
    return rows.select(
        "o_orderkey", dates.whole_months(start, F.col("end")).cast("bigint").alias("whole_months"),
        F.posexplode(dates.month_series(start, F.lit(4))).alias("step", "anchor"))


@query("c21_allocation", duck("", """
select o_orderkey, pos, (sg * (u + case when r <= left_over then 1 else 0 end))::bigint as units from (
  select *, row_number() over (partition by o_orderkey order by rest desc, pos) as r,
    mag - sum(u) over (partition by o_orderkey) as left_over
  from (select o_orderkey, pos, sg, mag, (mag * w) // tot as u, (mag * w) % tot as rest from (
    select o_orderkey, sign(t) as sg, abs(t) as mag, unnest([0, 1, 2, 3]) as pos,
      unnest([1 + o_custkey % 5, o_custkey % 3, 2, 1 + o_orderkey % 4]) as w, 1 + o_custkey % 5 + o_custkey % 3 + 2 + 1 + o_orderkey % 4 as tot
    from (select *, case when o_orderkey % 2 = 0 then -1 else 1 end * (o_totalprice * 100)::bigint as t from orders))))"""))
def c21(spark, sf):
    rows = view(spark, sf, "orders").select(
        "o_orderkey", F.expr("case when o_orderkey % 2 = 0 then -1 else 1 end * cast(round(o_totalprice * 100) as bigint)").alias("t"),
        F.expr("array(1 + o_custkey % 5, o_custkey % 3, 2L, 1 + o_orderkey % 4)").alias("w"))
    return rows.select("o_orderkey", F.posexplode(scenario.allocate(F.col("t"), F.col("w"))).alias("pos", "units"))
