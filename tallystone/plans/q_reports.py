"""Reports, spend change and review queue over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.ledger import MONEY, month_key, queue_state
from tallystone.operators import reports, review, spend
from tallystone.plans.derived import duck, view
from tallystone.plans.registry import query
from tallystone.vocab import BRANCHES, LABEL_SPACE, SPENDING_LABELS

_SPENDING = ", ".join(f"'{n}'" for n in SPENDING_LABELS)
_LABELS = ", ".join(f"'{n}'" for n in LABEL_SPACE)
_REVIEW = """(confirmed_label is null and (suggested_label is null or suggested_label = 'UNKNOWN'
 or suggested_confidence < 0.600))"""
_MONTH = "strftime(posted_on, '%Y-%m')"

# What several oracles below share.
_CLASSED = f"""
select tenant_id, currency, merchant, id, posted_on, amount, confirmed_label,
       effective_label as label, {_MONTH} as month, date_trunc('month', posted_on)::date as m,
       case when effective_label is null or effective_label = 'UNKNOWN' then 'unclassified'
            when effective_label = 'TRANSFER' then 'transfer'
            when effective_label in ({_SPENDING}) and amount < 0 then 'spending'
            when effective_label = 'REFUND' and amount > 0 then 'refund'
            when effective_label = 'INCOME' and amount >= 0 then 'income'
            else 'inconsistent' end as kind
from ledger"""
_TREE_ROWS = f"""
select tenant_id, currency, {_MONTH} as month, id, amount,
       case when effective_label is null or effective_label = 'UNKNOWN' then 'unclassified'
            when effective_label = 'INCOME' then 'income'
            when effective_label = 'TRANSFER' then 'transfers'
            when effective_label = 'REFUND' then 'refunds' else 'spending' end as branch,
       case when effective_label is null then 'never_examined'
            when effective_label = 'UNKNOWN' then 'examined_no_answer'
            when effective_label in ('INCOME', 'TRANSFER', 'REFUND') then null
            else effective_label end as sub,
       case when effective_label is not null and effective_label <> 'UNKNOWN'
                 and confirmed_label is not null then 2 else 0 end as rnk
from ledger"""
_TREE = f"""
select tenant_id, currency, month, 'root' as path, 0 as level, sum(amount) as amount,
       count(*) as rows, min(rnk) as rnk from rows_ group by all
union all
select g.tenant_id, g.currency, g.month, 'root/' || b.branch, 1, coalesce(sum(r.amount), 0),
       count(r.id), min(r.rnk)
from (select distinct tenant_id, currency, month from rows_) g
cross join (select unnest({BRANCHES}) as branch) b
left join rows_ r on r.tenant_id = g.tenant_id and r.currency = g.currency
     and r.month = g.month and r.branch = b.branch
group by all
union all
select tenant_id, currency, month, 'root/' || branch || '/' || sub, 2, sum(amount), count(*),
       min(rnk) from rows_ where sub is not null group by all"""
_EVIDENCE = "(case coalesce(rnk, 0) when 2 then 'USER_CONFIRMED' else 'ASSUMED' end)"


def _ledger(spark, sf):
    return view(spark, sf, "ledger")


def _snapshots(spark, sf):
    batches = view(spark, sf, "batches").filter("mode = 'snapshot'")
    return batches.join(view(spark, sf, "accounts"), "account_id")


@query("f2_monthly_tree", duck("ledger", f"""
select tenant_id, currency, month, path, level, amount::decimal(28,2) as amount, rows,
       {_EVIDENCE} as evidence from tree""", rows_=_TREE_ROWS, tree=_TREE))
def f2(spark, sf):
    return reports.monthly_tree(_ledger(spark, sf))


@query("f2_tree_leaves", duck("ledger", f"""
select tenant_id, currency, month, concat_ws('/', 'root', branch, sub, id) as path,
       amount::decimal(28,2) as amount, {_EVIDENCE} as evidence from rows_""", rows_=_TREE_ROWS))
def f2_leaves(spark, sf):
    return reports.tree_leaves(_ledger(spark, sf))


@query("f3_branch_evidence", duck("ledger", f"""
select {_EVIDENCE} as evidence, level, count(*) as nodes from tree group by all""",
    rows_=_TREE_ROWS, tree=_TREE))
def f3(spark, sf):
    return reports.monthly_tree(_ledger(spark, sf)).groupBy("evidence", "level").agg(
        F.count("*").alias("nodes")
    )


@query("d15_subtree", duck("ledger", """
select tenant_id, currency, month, path, amount::decimal(28,2) as amount from tree
where path = 'root/spending' or path like 'root/spending/%'""", rows_=_TREE_ROWS, tree=_TREE))
def d15(spark, sf):
    return reports.subtree(reports.monthly_tree(_ledger(spark, sf)), "root/spending").select(
        "tenant_id", "currency", "month", "path", "amount"
    )


@query("f1_totals", duck("ledger", f"""
select tenant_id, currency, {_MONTH} as month,
  (coalesce(sum(abs(amount)) filter (where effective_label in ({_SPENDING})), 0)
   - coalesce(sum(abs(amount)) filter (where effective_label = 'REFUND'), 0))::decimal(28,2) as spending,
  coalesce(sum(amount) filter (where effective_label = 'INCOME'), 0)::decimal(28,2) as income,
  (income - spending)::decimal(28,2) as net
from ledger group by tenant_id, currency, {_MONTH}"""))
def f1(spark, sf):
    return reports.totals(_ledger(spark, sf))


_SPANS = """
select tenant_id, min(window_start) as span_start, max(window_end) as span_end from (
  select *, sum(opens) over (partition by tenant_id order by window_start, window_end, batch_id) as island
  from (select *, case when window_start <= max(window_end) over (
            partition by tenant_id order by window_start, window_end, batch_id
            rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as opens
        from batches join accounts using (account_id) where mode = 'snapshot'))
group by tenant_id, island"""


@query("g3_merged_windows", duck("batches accounts", "select * from spans", spans=_SPANS))
def g3(spark, sf):
    return reports.merged_windows(_snapshots(spark, sf), ["tenant_id"])


_MONTHS = f"select distinct tenant_id, {_MONTH} as month, date_trunc('month', posted_on)::date as m from ledger"


@query("e10_month_containment", duck("ledger batches", """
select tenant_id, month from months
where exists (select 1 from spans s where s.tenant_id = months.tenant_id and s.span_start <= m
              and s.span_end >= (m + interval 1 month - interval 1 day)::date)""",
    spans=_SPANS, months=_MONTHS))
def e10(spark, sf):
    months = _ledger(spark, sf).select("tenant_id", month_key("posted_on").alias("month")).distinct()
    spans = reports.merged_windows(_snapshots(spark, sf), ["tenant_id"])
    return months.join(reports.covered_months(spans, ["tenant_id"]), ["tenant_id", "month"], "left_semi")


@query("f4_month_coverage", duck("ledger batches", f"""
select tenant_id, {_MONTH} as month, count(*) as rows,
  count(*) filter (where effective_label is not null and effective_label <> 'UNKNOWN') as classified,
  count(*) filter (where {_REVIEW}) as awaiting_review,
  bool_or(exists (select 1 from spans s where s.tenant_id = ledger.tenant_id
     and s.span_start <= date_trunc('month', posted_on)
     and s.span_end >= last_day(posted_on))) as complete
from ledger group by tenant_id, {_MONTH}""", spans=_SPANS))
def f4(spark, sf):
    return reports.month_coverage(_ledger(spark, sf), _snapshots(spark, sf), "0.600")


def _moves(rows: str, keys: str) -> str:
    on = " and ".join(f"c.{k} = p.{k}" for k in keys.split(", "))
    pick = ", ".join(f"coalesce(c.{k}, p.{k}) as {k}" for k in keys.split(", "))
    return f"""
select {pick}, strftime(coalesce(c.m, (p.m + interval 1 month)::date), '%Y-%m') as month,
       coalesce(p.v, 0)::decimal(28,2) as previous, coalesce(c.v, 0)::decimal(28,2) as current,
       (coalesce(c.v, 0) - coalesce(p.v, 0))::decimal(28,2) as delta
from {rows} c full join {rows} p on {on} and c.m = (p.m + interval 1 month)::date
where coalesce(c.m, (p.m + interval 1 month)::date) in (select m from {rows})"""


_DEBITS = """select tenant_id, currency, merchant, date_trunc('month', posted_on)::date as m,
 sum(-amount) as v from ledger where amount < 0 group by all"""


@query("e4_month_over_month", duck("ledger", _moves("debits", "tenant_id, currency, merchant"),
                                   debits=_DEBITS))
def e4(spark, sf):
    return reports.observed_debits(_ledger(spark, sf))


@query("f5_observed_debits", duck("ledger", """
select tenant_id, currency, month, sum(previous)::decimal(28,2) as previous,
       sum(current)::decimal(28,2) as current, sum(delta)::decimal(28,2) as delta,
       count(*) as merchants from moves group by all""",
    debits=_DEBITS, moves=_moves("debits", "tenant_id, currency, merchant")))
def f5(spark, sf):
    return reports.debit_totals(reports.observed_debits(_ledger(spark, sf)))


def _kind_sum(kind: str, sign: str = "-", more: str = "") -> str:
    return f"coalesce(sum({sign}amount) filter (where kind = '{kind}'{more}), 0)::decimal(28,2)"


_PERIODS = f"""
select tenant_id, currency, m as month_start,
  {_kind_sum('spending')} as gross_spending, {_kind_sum('refund', '')} as refunds,
  (gross_spending - refunds)::decimal(28,2) as net_spending,
  {_kind_sum('unclassified', '-', ' and amount < 0')} as unclassified_debits,
  {_kind_sum('transfer', '-', ' and amount < 0')} as transfer_debits,
  {_kind_sum('inconsistent', '-', ' and amount < 0')} as inconsistent_debits,
  count(*) filter (where kind = 'unclassified') as unclassified_rows,
  count(*) filter (where label is not null and label <> 'UNKNOWN' and confirmed_label is null) as suggested_rows,
  count(*) filter (where kind = 'inconsistent') as inconsistent_rows
from classed group by tenant_id, currency, m"""
_DRIVERS = """select tenant_id, currency, merchant, m, sum(-amount) as v from classed
 where kind in ('spending', 'refund') group by all"""


@query("f6_spend_periods", duck("ledger", _PERIODS, classed=_CLASSED))
def f6(spark, sf):
    return spend.spend_periods(_ledger(spark, sf))


@query("f6_period_change", duck("ledger", _moves("nets", "tenant_id, currency"), classed=_CLASSED,
    periods=_PERIODS,
    nets="select tenant_id, currency, month_start as m, net_spending as v from periods"))
def f6_change(spark, sf):
    return spend.period_change(spend.spend_periods(_ledger(spark, sf)))


@query("f7_merchant_drivers", duck("ledger", _moves("drv", "tenant_id, currency, merchant"),
                                   classed=_CLASSED, drv=_DRIVERS))
def f7(spark, sf):
    return spend.merchant_drivers(_ledger(spark, sf))


@query("f7_driver_evidence", duck("ledger", """
select tenant_id, currency, merchant, id, posted_on, (-amount)::decimal(18,2) as contribution,
       label, confirmed_label is not null as confirmed
from classed where kind in ('spending', 'refund')""", classed=_CLASSED))
def f7_evidence(spark, sf):
    return spend.spend_evidence(_ledger(spark, sf))


@query("h1_top_drivers", duck("ledger", """
select tenant_id, currency, month, merchant, delta, position from (
  select *, row_number() over (partition by tenant_id, currency, month
                               order by abs(delta) desc, merchant) as position from moves)
where position <= 5""", classed=_CLASSED, drv=_DRIVERS,
    moves=_moves("drv", "tenant_id, currency, merchant")))
def h1(spark, sf):
    return spend.top_drivers(spend.merchant_drivers(_ledger(spark, sf)), 5)


@query("n2_tree_reconciles", duck("ledger", """
select count(*) as nodes, sum(rows) as rows, 0::bigint as breaks from tree where level = 0""",
    rows_=_TREE_ROWS, tree=_TREE))
def n2(spark, sf):
    ledger = _ledger(spark, sf)
    tree = reports.monthly_tree(ledger)
    broken = reports.tree_breaks(ledger, tree).agg(F.count("*").alias("breaks"))
    whole = tree.filter("level = 0").agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows"))
    return whole.withColumn("k", F.lit(1)).join(broken.withColumn("k", F.lit(1)), "k").drop("k")


@query("n3_drivers_reconcile", duck("ledger", """
select count(*) as changes, 0::bigint as breaks from moves""", classed=_CLASSED, periods=_PERIODS,
    nets="select tenant_id, currency, month_start as m, net_spending as v from periods",
    moves=_moves("nets", "tenant_id, currency")))
def n3(spark, sf):
    ledger = _ledger(spark, sf)
    change = spend.period_change(spend.spend_periods(ledger))
    broken = spend.driver_breaks(change, spend.merchant_drivers(ledger))
    broken = broken.agg(F.count("*").alias("breaks")).withColumn("k", F.lit(1))
    total = change.agg(F.count("*").alias("changes")).withColumn("k", F.lit(1))
    return total.join(broken, "k").drop("k")


@query("n8_sign_consistency", duck("ledger", """
select effective_label as label, count(*) as rows, sum(amount)::decimal(28,2) as amount from ledger
where (effective_label not in ('INCOME','TRANSFER','REFUND','UNKNOWN') and amount > 0)
   or (effective_label = 'INCOME' and amount < 0) group by all"""))
def n8(spark, sf):
    label = F.col("effective_label")
    wrong = (label.isin(SPENDING_LABELS) & (F.col("amount") > 0)) | (
        (label == "INCOME") & (F.col("amount") < 0)
    )
    return _ledger(spark, sf).filter(wrong).groupBy(label.alias("label")).agg(
        F.count("*").alias("rows"), F.sum("amount").cast(MONEY).alias("amount")
    )


@query("n10_mixed_currency", duck("ledger", f"""
select tenant_id, {_MONTH} as month, count(distinct currency) as currencies,
       count(distinct currency) > 1 as mixed from ledger group by tenant_id, {_MONTH}"""))
def n10(spark, sf):
    return _ledger(spark, sf).groupBy("tenant_id", month_key("posted_on").alias("month")).agg(
        F.count_distinct("currency").alias("currencies"),
        (F.min("currency") != F.max("currency")).alias("mixed"),
    )


@query("d2_for_month", duck("ledger", """
select tenant_id, id, posted_on, amount from ledger
where posted_on >= date '1998-03-01' and posted_on < date '1998-04-01'"""))
def d2(spark, sf):
    return reports.for_month(_ledger(spark, sf), 1998, 3).select("tenant_id", "id", "posted_on", "amount")


@query("d12_month_guard", duck("ledger", f"""
select {_MONTH} as month, count(*) as rows,
  count(*) filter (where posted_on < date_trunc('month', posted_on)
     or posted_on >= date_trunc('month', posted_on) + interval 1 month) as outside
from ledger group by {_MONTH}"""))
def d12(spark, sf):
    start = F.trunc("posted_on", "MM")
    outside = (F.col("posted_on") < start) | (F.col("posted_on") >= F.add_months(start, 1))
    return _ledger(spark, sf).groupBy(month_key("posted_on").alias("month")).agg(
        F.count("*").alias("rows"), F.count_if(outside).alias("outside")
    )


@query("d1_tenant_scope", duck("txn accounts", """
select id, account_id, amount from txn
where account_id in (select account_id from accounts where tenant_id = 7)"""))
def d1(spark, sf):
    scoped = review.tenant_scope(view(spark, sf, "txn"), view(spark, sf, "accounts"), 7)
    return scoped.select("id", "account_id", "amount")


@query("e1_ledger_accounts", duck("txn accounts", """
select a.tenant_id, a.account_name, count(*) as rows, sum(t.amount)::decimal(28,2) as amount
from txn t join accounts a using (account_id) group by all"""))
def e1(spark, sf):
    # summed per account before the join, so no account's rows travel with its name
    per_account = view(spark, sf, "txn").groupBy("account_id").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount")
    )
    return (
        per_account.join(view(spark, sf, "accounts"), "account_id")
        .groupBy("tenant_id", "account_name")
        .agg(F.sum("rows").alias("rows"), F.sum("amount").cast(MONEY).alias("amount"))
    )


@query("e13_ownership", duck("accounts", """
select c.o_custkey % 25 as tenant_id,
  count(*) filter (where a.tenant_id = c.o_custkey % 25) as own,
  count(*) filter (where a.tenant_id is distinct from c.o_custkey % 25) as refused
from orders c left join accounts a on a.account_id = c.o_orderkey % 150 group by all"""))
def e13(spark, sf):
    claims = view(spark, sf, "orders").select(
        F.expr("o_custkey % 25").alias("tenant_id"), F.expr("o_orderkey % 150").alias("account_id")
    )
    return review.ownership(claims, view(spark, sf, "accounts"))


@query("c14_effective_label", duck("txn", """
select coalesce(confirmed_label, suggested_label) as label, confirmed_label is not null as confirmed,
       count(*) as rows from txn group by all"""))
def c14(spark, sf):
    from tallystone.functions.ledger import effective_label

    return view(spark, sf, "txn").groupBy(
        effective_label().alias("label"), F.col("confirmed_label").isNotNull().alias("confirmed")
    ).agg(F.count("*").alias("rows"))


@query("c20_month_bounds", duck("txn", """
select distinct posted_on, strftime(posted_on, '%Y-%m') as month,
  make_date(year(posted_on), month(posted_on), 1) as month_start,
  (last_day(posted_on) + 1)::date as month_end from txn"""))
def c20(spark, sf):
    days = view(spark, sf, "txn").select("posted_on").distinct()
    return days.select(
        "posted_on", month_key("posted_on").alias("month"),
        F.trunc("posted_on", "MM").alias("month_start"),
        F.add_months(F.trunc("posted_on", "MM"), 1).alias("month_end"),
    )


@query("d3_awaiting_review", duck("ledger", f"""
select id, posted_on, suggested_label, suggested_confidence from ledger where {_REVIEW}"""))
def d3(spark, sf):
    return review.awaiting_review(_ledger(spark, sf), "0.600").select(
        "id", "posted_on", "suggested_label", "suggested_confidence"
    )


@query("d4_unclassified", duck("txn", """
select id, posted_on from txn where suggested_label is null order by posted_on, id limit 200"""))
def d4(spark, sf):
    return review.unclassified_rows(view(spark, sf, "txn"), 200).select("id", "posted_on")


@query("d5_to_classify", duck("txn", """
select 'default' as run, count(*) as rows from txn where suggested_label is null
union all select 'reclassify', count(*) from txn where confirmed_label is null and
 (suggested_label is null or suggested_label = 'UNKNOWN' or suggested_confidence < 1.001)"""))
def d5(spark, sf):
    txn = view(spark, sf, "txn")
    runs = [
        review.to_classify(txn, again).agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("run"), "rows"
        )
        for name, again in (("default", False), ("reclassify", True))
    ]
    return runs[0].unionByName(runs[1])


@query("d6_label_space", duck("txn", f"""
select lbl as label, count(*) as rows from
 (select case when part_id % 23 = 0 then 'MISC_' || label else label end as lbl from
   (select part_id, coalesce(confirmed_label, suggested_label) as label from txn))
where lbl not in ({_LABELS}) group by all"""))
def d6(spark, sf):
    label = F.coalesce("confirmed_label", "suggested_label")
    offered = view(spark, sf, "txn").select(
        F.when(F.expr("part_id % 23 = 0"), F.concat(F.lit("MISC_"), label)).otherwise(label).alias("offered")
    )
    return review.unknown_labels(offered, "offered")


@query("f30_review_groups", duck("ledger", f"""
select tenant_id, merchant, max(posted_on) as latest, count(*) as rows,
  sum(amount)::decimal(28,2) as total,
  case when count(distinct suggested_label) filter (where suggested_label <> 'UNKNOWN') = 1
       then any_value(suggested_label) filter (where suggested_label <> 'UNKNOWN') end as suggested_default
from ledger where {_REVIEW} group by tenant_id, merchant"""))
def f30(spark, sf):
    return review.review_groups(review.awaiting_review(_ledger(spark, sf), "0.600"))


@query("c15_queue_state", duck("txn", f"""
select case when suggested_label is null then 'never examined'
            when suggested_label = 'UNKNOWN' then 'examined, no answer'
            else 'rules ' || suggested_label || ' ' || suggested_confidence::string end as state,
       count(*) as rows from txn where {_REVIEW} group by all"""))
def c15(spark, sf):
    queue = review.awaiting_review(view(spark, sf, "txn"), "0.600")
    return queue.withColumn("suggested_source", F.lit("rules")).groupBy(
        queue_state().alias("state")
    ).agg(F.count("*").alias("rows"))


# Label events: one to three per transaction, in an order that puts some suggestions last.
_EVENTS = """
select concat(id, '/', cast(n as string)) as event_id, id, n * 10 + part_id % 7 as happened_at,
       case when (part_id + n) % 3 = 0 then 'confirm' else 'suggest' end as kind,
       case n when 0 then 'LIVING_GROCERY' when 1 then 'LIVING_DINING' else 'LIVING_OTHER' end as label,
       case when part_id % 2 = 0 then 'rules' else 'model' end as source,
       cast(quantity * 0.01 as decimal(4,3)) as confidence
from {src}"""


@query("e14_latest_labels", duck("txn", """
select t.id, s.label as suggested_label, s.source as suggested_source, s.confidence as suggested_confidence, c.label as confirmed_label
from txn t
left join (select *, row_number() over (partition by id order by happened_at desc, event_id desc) r
           from ev where kind = 'suggest') s on s.id = t.id and s.r = 1
left join (select *, row_number() over (partition by id order by happened_at desc, event_id desc) r
           from ev where kind = 'confirm') c on c.id = t.id and c.r = 1""",
    ev=_EVENTS.format(src="(select *, unnest([0, 1, 2]) as n from txn) where n <= part_id % 3")))
def e14(spark, sf):
    txn = view(spark, sf, "txn")
    events = spark.sql(
        _EVENTS.format(src="(select *, explode(array(0, 1, 2)) as n from {txn}) where n <= part_id % 3"),
        txn=txn,
    )
    base = txn.select("id", "suggested_label", "suggested_confidence", "confirmed_label")
    return review.apply_label_events(base, events)
