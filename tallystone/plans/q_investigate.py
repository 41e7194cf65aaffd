"""Charge investigation and recurring series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.ledger import money_sum
from tallystone.operators import investigate, recurrence
from tallystone.plans.derived import duck, ratio4, view
from tallystone.plans.registry import query
from tallystone.vocab import POLICY_TERMS

_PAIRS = """
select l.id as a, r.id as b, l.seq as sa, r.seq as sb, l.period as pa, r.period as pb,
       abs(l.minute_of_day - r.minute_of_day) as apart, l.minute_of_day <= r.minute_of_day as ahead
from charges l join charges r on l.merchant = r.merchant and l.amount = r.amount
 and l.posted_on = r.posted_on and abs(l.minute_of_day - r.minute_of_day) between 1 and 5"""


def _charges(spark, sf):
    return view(spark, sf, "charges")


@query("e5_possible_duplicates", duck("charges", """
select a as id, apart::int as minutes_apart, count(*) as partners, arg_min(b, sb) as first_partner
from pairs where ahead group by a, apart""", pairs=_PAIRS))
def e5(spark, sf):
    return investigate.duplicate_pairs(_charges(spark, sf)).select(
        "id", "minutes_apart", "partners", "first_partner"
    )


@query("e5_duplicate_members", duck("charges", """
select a as id, count(*) as partners, arg_min(b, sb) as partner_id from pairs group by a""", pairs=_PAIRS))
def e5_members(spark, sf):
    return investigate.duplicate_members(_charges(spark, sf)).select(
        "id", F.col("partners").cast("bigint").alias("partners"), "partner_id"
    )


_SUMMARY = """
select account_id, period, total::decimal(28,2) as total, lag(period) over w as prior_period,
  lag(total) over w::decimal(28,2) as prior, (total - lag(total) over w)::decimal(28,2) as change
from (select account_id, period, sum(amount) as total from charges group by all)
window w as (partition by account_id order by period)"""
_DRIVERS = """
select s.account_id, s.period, m.merchant, (sum(case when m.period = s.period then m.amount else -m.amount end))::decimal(28,2) as delta
from summary s join charges m on m.account_id = s.account_id and m.period in (s.period, s.prior_period)
where s.prior_period is not null group by all having delta <> 0"""


@query("f31_period_summary", duck("charges", _SUMMARY))
def f31(spark, sf):
    return investigate.period_summary(_charges(spark, sf), ["account_id"])


@query("g10_prior_period", duck("charges", "select account_id, period, prior_period from s", s=_SUMMARY))
def g10(spark, sf):
    return investigate.period_summary(_charges(spark, sf), ["account_id"]).select(
        "account_id", "period", "prior_period"
    )


@query("f32_signed_drivers", duck("charges", """
select account_id, period, merchant, delta,
  row_number() over (partition by account_id, period order by abs(delta) desc, merchant) as position
from drivers""", summary=_SUMMARY, drivers=_DRIVERS))
def f32_drivers(spark, sf):
    from pyspark.sql import Window as W

    charges = _charges(spark, sf)
    drivers = investigate.signed_drivers(
        charges, investigate.period_summary(charges, ["account_id"]), ["account_id"]
    )
    order = W.partitionBy("account_id", "period").orderBy(F.abs("delta").desc(), "merchant")
    return drivers.withColumn("position", F.row_number().over(order))


@query("n6_drivers_sum_to_change", duck("charges", """
select account_id, period, change, change as driver_sum from summary where prior_period is not null""",
    summary=_SUMMARY))
def n6(spark, sf):
    charges = _charges(spark, sf)
    summary = investigate.period_summary(charges, ["account_id"])
    sums = investigate.signed_drivers(charges, summary, ["account_id"]).groupBy(
        "account_id", "period"
    ).agg(F.sum("delta").alias("driver_sum"))
    return summary.filter("prior_period is not null").join(sums, ["account_id", "period"], "left").select(
        "account_id", "period", "change",
        F.coalesce("driver_sum", F.lit(0)).cast("decimal(28,2)").alias("driver_sum"),
    )


# Whole-ledger investigation per period; pairs stay within a day and so within a period.
@query("f32_investigation", duck("charges", """
select t.period, t.total::decimal(28,2) as total, lag(t.total) over w::decimal(28,2) as prior,
  (t.total - lag(t.total) over w)::decimal(28,2) as change, p.left_id, p.right_id,
  coalesce(p.members, 0) as members, c.amount > 3000.00 and not c.receipt as over_policy
from (select period, sum(amount) as total from charges group by all) t
left join (select pa as period, arg_min(a, sa * 1000000000 + sb) as left_id,
                  arg_min(b, sa * 1000000000 + sb) as right_id, count(distinct a) as members
           from pairs group by all) p using (period)
left join charges c on c.id = p.right_id window w as (order by t.period)""", pairs=_PAIRS))
def f32(spark, sf):
    charges = _charges(spark, sf).withColumn("ledger", F.lit("all"))
    summary = investigate.period_summary(charges, ["ledger"]).drop("ledger", "prior_period")
    pair = investigate.first_pair(investigate.duplicate_members(charges), ["period"])
    second = charges.select(
        F.col("id").alias("right_id"),
        ((F.col("amount") > 3000) & ~F.col("receipt")).alias("over_policy"),
    )
    return summary.join(pair.join(second, "right_id"), "period", "left").withColumn(
        "members", F.coalesce("members", F.lit(0))
    )


@query("f33_review_proposals", duck("charges", """
select distinct 'REVIEW-' || a as proposal_id, a as charge_id, 'possible_duplicate' as reason,
  'proposal_only' as status from pairs where pa = (select max(period) from charges)""", pairs=_PAIRS))
def f33(spark, sf):
    charges = _charges(spark, sf)
    return investigate.review_proposals(investigate.duplicate_members(charges), charges)


@query("d9_period_search", duck("charges", """
select id, merchant, amount, receipt from charges where period = '2024-W02'"""))
def d9(spark, sf):
    return _charges(spark, sf).filter("period = '2024-W02'").select("id", "merchant", "amount", "receipt")


@query("d10_policy_breaks", duck("charges", """
select id, amount, 'POL-PROC-04' as policy_id from charges where amount > 3000.00 and not receipt"""))
def d10(spark, sf):
    return investigate.policy_breaks(_charges(spark, sf)).select("id", "amount", "policy_id")


@query("d10_charge_context", duck("charges", """
select id, merchant, 'POL-PROC-04' as policy_id, amount > 3000.00 as over_threshold from charges"""))
def d10_context(spark, sf):
    return investigate.charge_context(_charges(spark, sf)).select(
        "id", "merchant", "policy_id", "over_threshold"
    )


@query("d11_policy_citations", duck("documents", f"""
select doc_id, 'POL-PROC-04' as policy_id from documents where
{" or ".join(f"contains(lower(text), '{t}')" for t in POLICY_TERMS)}
or doc_id % 10 = 0"""))
def d11(spark, sf):
    # some of the given texts mention no policy term, so a tenth asks about one
    asked = view(spark, sf, "documents").select("doc_id", F.when(
        F.expr("doc_id % 10 = 0"), F.concat("text", F.lit(" Is a RECEIPT needed?"))
    ).otherwise(F.col("text")).alias("text"))
    return investigate.policy_citations(asked, "text").select("doc_id", "policy_id")


# ---- recurring series --------------------------------------------------------------


@query("g2_day_gaps", duck("series", """
select merchant, posted_on, n as charges,
  (posted_on - lag(posted_on) over (partition by merchant order by posted_on))::int as gap_days
from (select merchant, posted_on, count(*) as n from series where kind <> 'TRANSFER' group by all)"""))
def g2(spark, sf):
    return recurrence.day_gaps(view(spark, sf, "series"), ["merchant"])


_RECUR = f"""
select merchant, cadence, n as occurrences, (a2 / 2)::decimal(20,3) as typical_amount, latest as latest_amount,
  (latest * per_year)::decimal(28,2) as annual_cost,
  least({ratio4("49 * least(n, 12) * g2 + 252 * g2 - 720 * drift2", "840 * g2")}, 0.99)::decimal(18,4) as confidence,
  latest * 2 <> a2 as price_changed
from (select *, case when abs(g2 - 14) * 100 <= 350 then 'WEEKLY' when abs(g2 - 28) * 100 <= 700 then 'FORTNIGHTLY'
       when abs(g2 - 60) * 100 <= 1500 then 'MONTHLY' when abs(g2 - 182) * 100 <= 4550 then 'QUARTERLY'
       when abs(g2 - 730) * 100 <= 18250 then 'ANNUAL' end as cadence,
     case cadence when 'WEEKLY' then 52 when 'FORTNIGHTLY' then 26 when 'MONTHLY' then 12
       when 'QUARTERLY' then 4 else 1 end as per_year,
     list_max(list_transform(gaps, lambda g: abs(2 * g - g2))) as drift2
  from (select *, gaps[(len(gaps) - 1) // 2 + 1] + gaps[len(gaps) // 2 + 1] as g2,
          amounts[(n - 1) // 2 + 1] + amounts[n // 2 + 1] as a2
    from (select merchant, count(*) as n, list_sort(list(gap) filter (where gap is not null)) as gaps,
            list_sort(list(amount)) as amounts, arg_max(amount, posted_on) as latest
      from (select *, (posted_on - lag(posted_on) over (partition by merchant order by posted_on))::bigint as gap
            from series where kind <> 'TRANSFER') group by merchant)
    where n >= 3 and list_min(gaps) > 0))
where drift2 * 100 <= 35 * g2 and cadence is not null
  and list_max(list_transform(amounts, lambda a: abs(2 * a - a2))) * 100 <= 25 * abs(a2)"""


@query("f9_recurring_charges", duck("series", _RECUR))
def f9(spark, sf):
    return recurrence.recurring_charges(view(spark, sf, "series"))


@query("h4_most_expensive", duck("series", """
select merchant, annual_cost from r order by abs(annual_cost) desc, merchant limit 25""", r=_RECUR))
def h4(spark, sf):
    found = recurrence.recurring_charges(view(spark, sf, "series"))
    return recurrence.most_expensive(found, 25).select("merchant", "annual_cost")
