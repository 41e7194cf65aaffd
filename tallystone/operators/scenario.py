"""Scenario impacts, monthly projection and comparison, many scenario pairs at once.

Money runs as exact decimals. A month's share of an annual amount does not terminate, so
cash is carried as twelve times its monthly figure and divided once, at output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.operators.ranking import row_numbers
from tallystone.vocab import EVIDENCE

SIDE = ["pair_id", "side"]
EXACT = "decimal(28,6)"
TRUST_RADIUS = "0.20"  # fixed value: how far a one-point tax model is believed


def exact(value: Column) -> Column:
    return value.cast(EXACT)


def twelfth(value: Column) -> Column:
    """A twelvefold figure brought back to cents, halves up."""
    return F.round(value / F.lit(12), 2).cast("decimal(28,2)")


def cents(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(28,2)")


# ---- periods and shares --------------------------------------------------------------


def to_annual(amount: Column, period: Column) -> Column:
    return F.when(period == "MONTHLY", amount * 12).when(period == "ANNUAL", amount).otherwise(
        F.raise_error(F.concat(period, F.lit(" is not a rate and cannot be annualised")))
    )


def to_monthly(amount: Column, period: Column) -> Column:
    return F.when(period == "MONTHLY", amount).when(period == "ANNUAL", amount / 12).otherwise(
        F.raise_error(F.concat(period, F.lit(" is not a rate and has no monthly figure")))
    )


def paycheck_to_annual(amount: Column, frequency: Column) -> Column:
    """Paychecks per year."""
    per_year = F.when(frequency == "WEEKLY", 52).when(frequency == "BIWEEKLY", 26).when(
        frequency == "SEMIMONTHLY", 24).when(frequency == "MONTHLY", 12)
    return amount * per_year


def allocate(units: Column, weights: Column) -> Column:
    """Whole units over integer weights: floors, then one more to the largest remainders.

    Ties go to the earlier share, and the shares always sum to ``units``.
    """
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, w: a + w)
    scaled = F.transform(weights, lambda w: F.abs(units) * w)
    floors = F.transform(scaled, lambda x: F.floor((x - x % total) / total).cast("bigint"))
    rests = F.array_sort(F.transform(scaled, lambda x, i: F.struct((-(x % total)).alias("r"), i.alias("i"))))
    left = F.abs(units) - F.aggregate(floors, F.lit(0).cast("bigint"), lambda a, w: a + w)
    lucky = F.transform(F.slice(rests, F.lit(1), left.cast("int")), lambda x: x["i"])
    return F.transform(
        floors, lambda u, i: F.signum(units).cast("bigint") * (u + F.array_contains(lucky, i).cast("bigint"))
    )


def household_share(cost: Column) -> Column:
    """What the user bears of a shared cost: the first share of the household's split.

    With two weights the larger remainder wins and a tie goes to the user, which is
    rounding half up; with even weights the user takes the first spare cent.
    """
    size, method = F.col("household_size"), F.col("split_method")
    whole = (cost * 100).cast("bigint")
    even = (F.floor((whole + size - 1 - (whole + size - 1) % size) / size)).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")
    return (
        F.when(size == 1, cost)
        .when(method == "FIXED", F.least(F.col("user_fixed"), cost))
        .when(method == "PERCENTAGE", F.round(cost * F.col("user_weight") / 100, 2))
        .otherwise(even)
        .cast("decimal(18,2)")
    )


# ---- impacts -------------------------------------------------------------------------


def inherit_until_move(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidate items plus the current side's recurring costs up to the move.

    A current cost is left out where the candidate already runs one of its category
    before the move.
    """
    moves = profiles.filter("side = 'candidate'").select("pair_id", "move_date")
    dated = items.join(moves, "pair_id")
    early = dated.filter("flow = 'RECURRING_CASH' and effective_date < move_date")
    covered = early.filter("side = 'candidate'").select("pair_id", "category").distinct()
    inherited = (
        early.filter("side = 'current'").join(covered, ["pair_id", "category"], "left_anti")
        .withColumn("side", F.lit("candidate")).withColumn("ends_before", F.col("move_date"))
        .withColumn("is_inherited", F.lit(True)).drop("move_date")
    )
    own = items.withColumn("ends_before", F.lit(None).cast("date")).withColumn("is_inherited", F.lit(False))
    return own.unionByName(inherited.select(own.columns))


def cost_impacts(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """One negative impact per item, owned by the calculator its category belongs to."""
    shares = profiles.select(*SIDE, "household_size", "split_method", "user_weight", "user_fixed")
    owned = items.withColumn("produced_by", F.substring_index("category", "_", 1))
    place = F.struct("is_inherited", F.floor(F.col("seq") / 65536))
    numbered = row_numbers(owned, [*SIDE, "produced_by"], place, ["is_inherited", "seq"], "place")
    borne = F.when(F.col("is_shared"), household_share(F.col("amount"))).otherwise(F.col("amount"))
    index = (F.col("place") - 1).cast("string")
    return numbered.join(shares, SIDE).select(
        *SIDE,
        F.concat(F.lower("category"), F.when(F.col("is_inherited"), "_inherited_").otherwise("_"), index).alias("code"),
        "produced_by", "period", "effective_date", "ends_before", exact(-borne).alias("cash"),
        exact(F.lit(0)).alias("wealth"), exact(F.lit(0)).alias("hours"), "evidence",
    )


def net_pay(gross: Column) -> Column:
    """Annual take-home on the line through the observed paystub, within 0 and gross."""
    line = F.col("observed_net") + (gross - F.col("observed_gross")) * (1 - F.col("marginal_rate"))
    return exact(F.greatest(F.least(line, gross), F.lit(0)))


def tax_view(profiles: DataFrame) -> DataFrame:
    """Take-home, implied rate and how far each salary lies from its observation."""
    gross = F.col("observed_gross")
    distance = (F.abs(F.col("base_salary") - gross) / gross).cast("decimal(18,6)")
    return profiles.select(
        *SIDE, cents(net_pay(F.col("base_salary"))).alias("annual_net"),
        F.round(1 - F.col("observed_net") / gross, 6).cast("decimal(18,6)").alias("effective_rate"),
        distance.alias("distance"),
        (F.abs(F.col("base_salary") - gross) * 5 > gross).alias("far"),
        (F.col("base_salary") != gross).alias("extrapolated"),
    )


def expected_bonus(salary: Column) -> Column:
    return exact(salary * F.col("bonus_rate") * F.col("bonus_probability") * (1 - F.col("marginal_rate")))


def equity_vested(months: Column) -> Column:
    """Vested value before tax, zero until the cliff; multiplied before dividing."""
    elapsed = F.least(months, F.col("equity_months"))
    return F.when(months < F.col("equity_cliff"), F.lit(0)).otherwise(
        F.col("equity_total") * elapsed / F.col("equity_months")
    ).cast(EXACT)


def employer_match() -> Column:
    rate = F.least("employee_rate", "match_limit")
    return exact(F.col("base_salary") * rate * F.col("match_rate"))


def vested_fraction(month: Column) -> Column:
    months = F.col("match_vesting_months")
    return F.when(months == 0, F.lit(1)).otherwise(
        F.least(month / F.nullif(months, F.lit(0)).cast("decimal(9,0)"), F.lit(1))
    ).cast("decimal(18,6)")


def commute_hours() -> Column:
    return exact(
        F.col("onsite_days") * F.col("working_weeks") * F.col("commute_minutes") * 2 / F.lit(60)
    )


def profile_impacts(profiles: DataFrame, months: int) -> DataFrame:
    """Pay, bonuses, benefits, equity and commute of each profile as impacts."""
    zero = F.lit(0)
    kept = 1 - F.col("marginal_rate")

    def impact(code, by, period, cash=zero, wealth=zero, hours=zero, evidence="DERIVED", when=None):
        value = F.struct(
            F.lit(code).alias("code"), F.lit(by).alias("produced_by"), F.lit(period).alias("period"),
            exact(cash).alias("cash"), exact(wealth).alias("wealth"), exact(hours).alias("hours"),
            F.lit(evidence).alias("evidence"),
        )
        return value if when is None else F.when(when, value)

    horizon = F.lit(months)
    gross = equity_vested(horizon)
    has_equity = F.col("equity_total") > 0
    impacts = F.array_compact(F.array(
        # the yearly figure; a month's share is taken where months are summed
        impact("take_home_pay", "LIVING", "ANNUAL", net_pay(F.col("base_salary"))),
        impact("signing_bonus", "LIVING", "ONE_TIME", F.col("signing_bonus") * kept,
               when=F.col("signing_bonus") > 0),
        impact("target_bonus", "LIVING", "ANNUAL", expected_bonus(F.col("base_salary")),
               when=F.col("bonus_rate") > 0),
        impact("relocation_reimbursement", "LIVING", "ONE_TIME", F.col("relocation"), evidence="ASSUMED",
               when=F.col("relocation") > 0),
        impact("employer_retirement_match", "HEALTH", "ANNUAL", wealth=employer_match()),
        impact("employer_hsa_contribution", "HEALTH", "ANNUAL", wealth=F.col("hsa_annual"), evidence="ASSUMED"),
        impact("employee_health_premium", "HEALTH", "MONTHLY", -F.col("premium_monthly"), evidence="ASSUMED"),
        impact("vested_equity", "LIVING", "HORIZON_CUMULATIVE",
               wealth=exact(gross * (1 - F.col("withholding_rate"))), when=has_equity),
        impact("unvested_equity", "LIVING", "HORIZON_CUMULATIVE", when=has_equity),
        impact("commute_time", "COMMUTE", "ANNUAL", hours=commute_hours(), when=F.col("onsite_days") > 0),
    ))
    return profiles.select(*SIDE, F.col("horizon_start").alias("effective_date"), F.explode(impacts).alias("i")).select(
        *SIDE, "i.code", "i.produced_by", "i.period", "effective_date",
        F.lit(None).cast("date").alias("ends_before"), "i.cash", "i.wealth", "i.hours", "i.evidence",
    )


def all_impacts(profiles: DataFrame, items: DataFrame, months: int) -> DataFrame:
    costs = cost_impacts(inherit_until_move(items, profiles), profiles)
    return profile_impacts(profiles, months).unionByName(costs)


# ---- projection ----------------------------------------------------------------------


def active_impacts(impacts: DataFrame, profiles: DataFrame, months: int) -> DataFrame:
    """Each impact once per month in which it moves cash, with twelve times its amount."""
    starts = profiles.select(*SIDE, "horizon_start")
    spread = impacts.filter("period <> 'HORIZON_CUMULATIVE'").join(starts, SIDE).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("month_index")
    ).withColumn("month_start", F.add_months("horizon_start", F.col("month_index")))
    first = F.col("month_index") == 0
    same_month = F.trunc("effective_date", "MM") == F.trunc("month_start", "MM")
    lands = F.when(
        F.col("period") == "ONE_TIME", same_month | (first & (F.col("effective_date") < F.col("month_start")))
    ).otherwise((F.col("effective_date") <= F.col("month_start")) | first)
    running = F.col("ends_before").isNull() | (F.col("month_start") < F.col("ends_before"))
    cash = F.col("cash")
    bucket = (
        F.when(cash == 0, "NOT_CASH").when(F.col("period") == "ONE_TIME", "ONE_TIME")
        .when(cash > 0, "INCOME").otherwise("SPENDING")
    )
    return spread.filter(lands & running).select(
        *SIDE, "month_index", "month_start", "code", "period", bucket.alias("bucket"),
        F.when(F.col("period") == "ANNUAL", cash).otherwise(cash * 12).cast(EXACT).alias("cash12"),
    )


def cash_spans(impacts: DataFrame, profiles: DataFrame, months: int) -> DataFrame:
    """Each impact as the month ranges [first, stop) in which it moves cash.

    A recurring impact that starts later also counts in month 0, a range of its own.
    """
    starts = profiles.select(*SIDE, "horizon_start")
    rows = impacts.filter("period <> 'HORIZON_CUMULATIVE' and cash <> 0").join(starts, SIDE)
    start, once = F.col("horizon_start"), F.col("period") == "ONE_TIME"

    def calendar_months(day):
        return (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)

    def first_at_or_after(day):
        index = calendar_months(day)
        return F.greatest(F.when(F.add_months(start, index) >= day, index).otherwise(index + 1), F.lit(0))

    end = F.when(F.col("ends_before").isNull(), F.lit(months)).otherwise(
        F.least(first_at_or_after(F.col("ends_before")), F.lit(months)))
    begin = F.when(
        once, F.when(F.col("effective_date") < start, 0).otherwise(calendar_months(F.col("effective_date")))
    ).otherwise(first_at_or_after(F.col("effective_date")))
    placed = rows.select(
        *SIDE, "code", once.alias("once"), (F.col("cash") > 0).alias("positive"),
        F.when(F.col("period") == "ANNUAL", F.col("cash")).otherwise(F.col("cash") * 12).cast(EXACT).alias("cash12"),
        begin.alias("begin"), F.when(once, F.least(begin + 1, end)).otherwise(end).alias("stop"),
    ).withColumn("end", F.when(F.col("once"), F.lit(0)).otherwise(F.col("stop")))

    def span(first, stop):
        return F.when(first < stop, F.struct(first.cast("int").alias("first"), stop.cast("int").alias("stop")))

    spans = F.array_compact(F.array(
        span(F.col("begin"), F.col("stop")),
        F.when((F.col("begin") > 0) & (F.col("end") > 0), span(F.lit(0), F.lit(1))),
    ))
    bucket = F.when(F.col("once"), "ONE_TIME").when(F.col("positive"), "INCOME").otherwise("SPENDING")
    return placed.select(*SIDE, "code", bucket.alias("bucket"), "cash12", F.explode(spans).alias("s")).select(
        *SIDE, "code", "bucket", "cash12", "s.first", "s.stop")


def project_months(impacts: DataFrame, profiles: DataFrame, months: int) -> DataFrame:
    """Monthly cash with the residual between bucketed and plain sums, and running cash.

    A range of months is two rows, its amount where it begins and minus that where it
    stops; running sums turn them into months. An impact is not repeated per month, and
    a scenario's window holds one row per horizon month.
    """
    spans = cash_spans(impacts, profiles, months)
    # whole millionths: sums and windows over long integers are exact and far cheaper
    units = (F.col("cash12") * 1000000).cast("bigint")
    edges = F.array(
        F.struct(F.col("first").alias("month_index"), F.col("u").alias("c")),
        F.struct(F.col("stop").alias("month_index"), (-F.col("u")).alias("c")),
    )
    changes = spans.withColumn("u", units).select(*SIDE, "bucket", F.explode(edges).alias("e")).select(
        *SIDE, "e.month_index", "bucket", F.col("e.c").alias("c")).filter(F.col("month_index") < months)
    calendar = profiles.select(
        *SIDE, F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("month_index"),
        F.lit("NONE").alias("bucket"), F.lit(0).cast("bigint").alias("c"))

    def part(name):
        return F.sum(F.when(F.col("bucket") == name, F.col("c")).otherwise(0))

    steps = changes.unionByName(calendar).groupBy(*SIDE, "month_index").agg(
        part("INCOME").alias("income"), part("SPENDING").alias("spending"),
        part("ONE_TIME").alias("one_time"), F.sum("c").alias("stated"),
    )
    upto = W.partitionBy(*SIDE).orderBy("month_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    flows = ["income", "spending", "one_time", "stated"]
    monthly = steps.select(*SIDE, "month_index", *[F.sum(c).over(upto).alias(c) for c in flows])
    net = F.col("income") + F.col("spending") + F.col("one_time")
    closed = monthly.withColumn("net", net).select(
        "*", F.sum("net").over(upto).alias("closing"), (F.col("net") - F.col("stated")).alias("residual"))

    def money(name):
        return (F.col(name).cast("decimal(19,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast(EXACT).alias(f"{name}12")

    return closed.join(profiles.select(*SIDE, "horizon_start"), SIDE).select(
        *SIDE, "month_index", F.add_months("horizon_start", F.col("month_index")).alias("month_start"),
        *[money(n) for n in (*flows, "net", "closing", "residual")])


def monthly_report(projected: DataFrame) -> DataFrame:
    return projected.select(
        *SIDE, "month_index", "month_start",
        twelfth(F.col("closing12") - F.col("net12")).alias("opening_cash"),
        twelfth(F.col("income12")).alias("income"), twelfth(F.col("spending12")).alias("spending"),
        twelfth(F.col("one_time12")).alias("one_time"), twelfth(F.col("closing12")).alias("closing_cash"),
        twelfth(F.col("residual12")).alias("residual"),
    )


def cumulative_delta(projected: DataFrame) -> DataFrame:
    """Candidate minus current closing cash per pair and month, in one aggregation."""
    signed = F.when(F.col("side") == "candidate", F.col("closing12")).otherwise(-F.col("closing12"))
    return projected.groupBy("pair_id", "month_index").agg(F.sum(signed).cast(EXACT).alias("delta12"))


def break_even(delta: DataFrame) -> DataFrame:
    """First month at or above zero, and the month after the last one below."""
    below = F.max(F.when(F.col("delta12") < 0, F.col("month_index")))
    last = F.max("month_index")
    return delta.groupBy("pair_id").agg(
        (last + 1).alias("horizon_months"),
        (F.min(F.when(F.col("delta12") >= 0, F.col("month_index"))) + 1).alias("first_crossing_month"),
        F.when(below.isNull(), 1).when(below < last, below + 2).alias("stable_break_even_month"),
    )


def annual_contribution() -> Column:
    return F.when(F.col("period") == "MONTHLY", F.col("cash") * 12).when(
        F.col("period") == "HORIZON_CUMULATIVE", F.lit(0)).otherwise(F.col("cash")).cast(EXACT)


def component_deltas(impacts: DataFrame) -> DataFrame:
    """A year of cash per component on both sides; a side without it counts zero."""
    yearly = annual_contribution()
    current = F.sum(F.when(F.col("side") == "current", yearly).otherwise(0)).cast(EXACT)
    candidate = F.sum(F.when(F.col("side") == "candidate", yearly).otherwise(0)).cast(EXACT)
    return impacts.groupBy("pair_id", "code").agg(
        current.alias("current_cash"), candidate.alias("candidate_cash")
    ).withColumn("delta", (F.col("candidate_cash") - F.col("current_cash")).cast(EXACT))


def top_movers(deltas: DataFrame, k: int) -> DataFrame:
    """Largest improvements and regressions per pair."""
    sign = F.when(F.col("delta") > 0, "improvement").when(F.col("delta") < 0, "regression")
    order = W.partitionBy("pair_id", "direction").orderBy(F.abs("delta").desc(), "code")
    return (
        deltas.withColumn("direction", sign).filter("direction is not null")
        .withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    )


def comparison(impacts: DataFrame, projected: DataFrame) -> DataFrame:
    """Cash, annualised, wealth and hours deltas per pair; the tracks stay apart."""
    way = F.when(F.col("side") == "candidate", 1).otherwise(-1)
    tracks = impacts.groupBy("pair_id").agg(
        cents(F.sum(annual_contribution() * way)).alias("annualised_cash_delta"),
        cents(F.sum(F.col("wealth") * way)).alias("wealth_delta"),
        cents(F.sum(F.col("hours") * way)).alias("hours_delta"),
    )
    final = projected.groupBy(*SIDE).agg(F.max_by("closing12", "month_index").alias("closing12"))
    cash = final.groupBy("pair_id").agg(twelfth(F.sum(F.col("closing12") * way)).alias("cash_delta"))
    return cash.join(tracks, "pair_id")


def derivation(impacts: DataFrame) -> DataFrame:
    """First-year cash tree per scenario: root, calculators, components."""
    rank = F.create_map(*[x for n, r in EVIDENCE.items() for x in (F.lit(n), F.lit(r))])
    live = impacts.filter("cash <> 0 and period <> 'HORIZON_CUMULATIVE'").select(
        *SIDE, F.lower("produced_by").alias("branch"), "code", annual_contribution().alias("amount"),
        F.element_at(rank, F.col("evidence")).alias("rank"),
    )
    nodes = F.array(
        F.struct(F.lit("first_year_disposable_cash").alias("path"), F.lit(0).alias("level")),
        F.struct(F.concat_ws("/", F.lit("first_year_disposable_cash"), "branch").alias("path"), F.lit(1).alias("level")),
        F.struct(F.concat_ws("/", F.lit("first_year_disposable_cash"), "branch", "code").alias("path"), F.lit(2).alias("level")),
    )
    named = F.array(*[F.lit(n) for n in EVIDENCE])
    return live.select("*", F.explode(nodes).alias("n")).groupBy(*SIDE, "n.path", "n.level").agg(
        cents(F.sum("amount")).alias("amount"),
        F.when(F.col("level") == 0, "DERIVED").otherwise(F.element_at(named, F.min("rank") + 1)).alias("evidence"),
    )


def simple_cash_tree(rows: DataFrame) -> DataFrame:
    """Net pay less housing, commute and living as flat nodes per row."""
    def node(path, value):
        return F.struct(F.lit(path).alias("path"), value.cast("decimal(18,2)").alias("amount"))

    rent, utilities, commute, living = (F.col(c) for c in ("rent", "utilities", "commute", "living"))
    total = F.col("net_pay") - rent - utilities - commute - living
    return rows.select("pair_id", F.inline(F.array(
        node("cash", total), node("cash/net_pay", F.col("net_pay")),
        node("cash/housing", -(rent + utilities)), node("cash/housing/rent", -rent),
        node("cash/housing/utilities", -utilities), node("cash/commute", -commute),
        node("cash/living", -living),
    )))


# ---- solvers -------------------------------------------------------------------------


def side_totals(projected: DataFrame) -> DataFrame:
    """Horizon cash of each side, as rows per pair."""
    final = projected.groupBy(*SIDE).agg(F.max_by("closing12", "month_index").alias("closing12"))
    return final.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == "current", F.col("closing12"))).alias("target12"),
        F.max(F.when(F.col("side") == "candidate", F.col("closing12"))).alias("achieved12"),
    )


def commute_totals(spans: DataFrame) -> DataFrame:
    """The part of the candidate's horizon cash that scales with onsite days."""
    cash = F.col("cash12") * (F.col("stop") - F.col("first"))
    return spans.filter("side = 'candidate' and code like 'commute%'").groupBy("pair_id").agg(
        F.sum(cash).cast(EXACT).alias("commute12"))


def _salary_cash12(salary: Column, months: int) -> Column:
    """Twelve times the horizon cash that depends on base salary."""
    return (net_pay(salary) + expected_bonus(salary)) * months


def equivalent_salary(pairs: DataFrame, lower: int, upper: int, months: int) -> DataFrame:
    """Smallest whole salary in [lower, upper] at which the candidate matches the target.

    A grid search inside each row: nine samples confirm that cash only rises, then each
    pass splits the bracket 64 ways until it is one unit wide. ``pairs`` carries the
    candidate profile with target12 and achieved12; no shuffle is involved.
    """
    fixed = F.col("achieved12") - _salary_cash12(F.col("base_salary"), months) - F.col("target12")
    rows = pairs.withColumn("fixed12", fixed.cast(EXACT))

    def gap(salary):
        return F.col("fixed12") + _salary_cash12(salary, months)

    span = upper - lower
    samples = F.array(*[gap(F.lit(lower + span * step // 8).cast("decimal(18,2)")) for step in range(9)])
    rows = rows.withColumn("samples", samples).withColumn(
        "monotone", F.forall(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("samples", i) <= F.get("samples", i + 1))
    ).withColumn("bracketed", (F.get("samples", F.lit(0)) <= 0) & (F.get("samples", F.lit(8)) > 0))
    rows = rows.withColumn("low", F.lit(lower).cast("bigint")).withColumn("high", F.lit(upper).cast("bigint"))
    width = span
    while width > 1:
        step = -(-width // 64)
        closed = F.filter(
            F.sequence(F.col("low"), F.col("high"), F.lit(step).cast("bigint")),
            lambda s: gap(s.cast("decimal(18,2)")) < 0,
        )
        best = F.coalesce(F.array_max(closed), F.col("low"))
        rows = rows.withColumn("_low", best).withColumn(
            "high", F.least(F.col("high"), F.col("_low") + F.lit(step))
        ).withColumn("low", F.col("_low")).drop("_low")
        width = step
    answer = F.when(gap(F.col("low").cast("decimal(18,2)")) >= 0, F.col("low")).otherwise(F.col("high"))
    usable = F.col("monotone") & F.col("bracketed")
    found = rows.withColumn("equivalent_salary", F.when(usable, answer.cast("decimal(18,2)")))
    return found.select(
        "pair_id", "monotone", "bracketed", "equivalent_salary",
        F.when(F.col("equivalent_salary").isNotNull(), twelfth(gap(F.col("equivalent_salary")))).alias("residual"),
        F.when(F.col("equivalent_salary").isNotNull(),
               F.abs(F.col("equivalent_salary") - F.col("observed_gross")) * 5 > F.col("observed_gross")).alias("far"),
    )


def remote_days(pairs: DataFrame) -> DataFrame:
    """First half-day step down from the onsite days at which the gap closes.

    ``commute12`` is the candidate's commute cash, which scales with the days; what is
    left open when fully remote is the shortfall.
    """
    onsite = F.col("onsite_days")
    steps = F.sequence(F.lit(0), (onsite * 2).cast("int"))

    # twelvefold cash times the onsite days, so that the ratio never divides
    def reaches(halves):
        kept = F.col("commute12") * halves.cast("decimal(9,1)") / 2
        whole = (F.col("achieved12") - F.col("commute12")) * onsite
        return whole + kept >= F.col("target12") * onsite

    # with no onsite days there is nothing to scale: the ratio is zero
    closes = F.filter(steps, lambda h: F.when(
        onsite == 0, F.col("achieved12") - F.col("commute12") >= F.col("target12")).otherwise(reaches(h)))
    gap = F.greatest(F.col("target12") - F.col("achieved12"), F.lit(0))
    days = F.when(gap == 0, onsite).otherwise((F.array_max(closes) / 2).cast("decimal(4,1)"))
    return pairs.withColumn("days", days.cast("decimal(4,1)")).select(
        "pair_id", F.col("days").alias("required_days"), F.col("days").isNotNull().alias("feasible"),
        F.when(F.col("days").isNull(),
               twelfth(F.col("target12") - (F.col("achieved12") - F.col("commute12")))).alias("shortfall"),
    )


def negotiation_levers(pairs: DataFrame, salaries: DataFrame, days: DataFrame) -> DataFrame:
    """Four ways to close the gap, each alone, as rows; feasible ones sort first."""
    wide = pairs.join(
        salaries.select("pair_id", "equivalent_salary"), "pair_id").join(
        days.select("pair_id", "required_days", F.col("feasible").alias("days_feasible")), "pair_id")
    gap12 = F.greatest(F.col("target12") - F.col("achieved12"), F.lit(0))
    none = gap12 == 0
    kept = 1 - F.col("marginal_rate")
    raised = (F.col("equivalent_salary") - F.col("base_salary")).cast("decimal(28,2)")
    money, day = F.lit(None).cast("decimal(28,2)"), F.lit(None).cast("decimal(4,1)")

    def lever(name, feasible, amount=money, days_needed=day):
        return F.struct(F.lit(name).alias("lever"), feasible.alias("feasible"),
                        amount.cast("decimal(28,2)").alias("required_amount"), days_needed.alias("required_days"))

    zero = F.lit(0).cast("decimal(28,2)")
    return wide.select("pair_id", twelfth(gap12).alias("gap"), F.inline(F.array(
        lever("BASE_SALARY", none | F.coalesce(raised > 0, F.lit(False)), F.when(none, zero).otherwise(raised)),
        lever("SIGNING_BONUS", none | (kept > 0), F.when(none, zero).when(kept > 0, F.round(gap12 / (kept * 12), 2))),
        lever("RELOCATION_REIMBURSEMENT", F.lit(True), twelfth(gap12)),
        lever("REMOTE_DAYS", F.col("days_feasible"), money, F.col("required_days")),
    )))


LOCKED = ["base_salary", "pay_frequency", "home", "work_place", "employee_rate", "hsa_annual", "premium_monthly"]


def stale_inputs(observed: DataFrame, current: DataFrame) -> DataFrame:
    """Which inputs changed since a net-pay figure was observed; two places are flagged."""
    o, c = observed.alias("o"), current.alias("c")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"o.{n}").eqNullSafe(F.col(f"c.{n}")), n) for n in LOCKED
    ]))
    return o.join(c, SIDE).select(
        *SIDE, F.array_join(changed, ",").alias("changed"), (F.size(changed) > 0).alias("stale"),
        (F.col("c.home") != F.col("c.work_place")).alias("multi_jurisdiction"),
    )
