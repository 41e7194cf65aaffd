"""Monthly reports: the reconciling tree, coverage, totals, observed debits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.ledger import (
    MONEY, branch, evidence_name, evidence_rank, in_month, money_sum, month_key,
    month_start, needs_review, sub_branch, sum_when, unclassified,
)
from tallystone.vocab import BRANCHES

SCOPE = ["tenant_id", "currency", "month"]


def for_month(ledger: DataFrame, year: int, month: int) -> DataFrame:
    return ledger.filter(in_month(F.col("posted_on"), year, month))


def totals(ledger: DataFrame) -> DataFrame:
    """Spending net of refunds, income, and what is left; transfers count nowhere."""
    label, amount = F.col("effective_label"), F.col("amount")
    kind = F.when(~unclassified(label), branch(label))
    spending = sum_when(kind == "spending", F.abs(amount)) - sum_when(
        kind == "refunds", F.abs(amount)
    )
    income = sum_when(kind == "income", amount)
    return ledger.groupBy("tenant_id", "currency", month_key("posted_on").alias("month")).agg(
        spending.cast(MONEY).alias("spending"),
        income.alias("income"),
        (income - spending).cast(MONEY).alias("net"),
    )


def _classified(ledger: DataFrame) -> DataFrame:
    label = F.col("effective_label")
    return ledger.select(
        "tenant_id", "currency", month_key("posted_on").alias("month"), "id", "amount",
        branch(label).alias("branch"), sub_branch(label).alias("sub"),
        evidence_rank(label, F.col("confirmed_label").isNotNull()).alias("rank"),
    )


def monthly_tree(ledger: DataFrame) -> DataFrame:
    """Root, five branches (zero when empty) and used sub-branches per month.

    Rows are summed once to (month, branch, sub); everything above works on those few
    rows, so a tenant holding a third of the ledger costs one partial aggregation.
    """
    base = (
        _classified(ledger)
        .groupBy(*SCOPE, "branch", "sub")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("rows"),
             F.min("rank").alias("rank"))
    )

    def node(path, level, live=True):
        return F.struct(
            path.alias("path"), F.lit(level).alias("level"),
            (F.col("amount") if live else F.lit(0).cast("decimal(28,2)")).alias("amount"),
            (F.col("rows") if live else F.lit(0).cast("bigint")).alias("rows"),
            (F.col("rank") if live else F.lit(None).cast("int")).alias("rank"),
        )

    under = F.concat(F.lit("root/"), F.col("branch"))
    nodes = F.array(
        node(F.lit("root"), 0),
        node(under, 1),
        node(F.when(F.col("sub").isNotNull(), F.concat(under, F.lit("/"), F.col("sub"))), 2),
        *[node(F.lit(f"root/{name}"), 1, live=False) for name in BRANCHES],
    )
    return (
        base.select(*SCOPE, F.explode(nodes).alias("n"))
        .select(*SCOPE, "n.*")
        .filter("path is not null")
        .groupBy(*SCOPE, "path", "level")
        .agg(money_sum(F.col("amount")).alias("amount"), F.sum("rows").alias("rows"),
             F.min("rank").alias("rank"))
        .select(*SCOPE, "path", "level", "amount", "rows",
                evidence_name(F.col("rank")).alias("evidence"))
    )


def tree_leaves(ledger: DataFrame) -> DataFrame:
    """One leaf per transaction, addressed by its path."""
    return _classified(ledger).select(
        *SCOPE,
        F.concat_ws("/", F.lit("root"), "branch", "sub", "id").alias("path"),
        F.col("amount").cast(MONEY).alias("amount"),
        evidence_name(F.col("rank")).alias("evidence"),
    )


def subtree(tree: DataFrame, path: str) -> DataFrame:
    """One component of a tree with everything under it."""
    return tree.filter((F.col("path") == path) | F.col("path").startswith(path + "/"))


def tree_breaks(ledger: DataFrame, tree: DataFrame) -> DataFrame:
    """Nodes that differ from the sum of their children, the root from its raw rows.

    The root's second figure never passes through the branch mapping, so a row the
    mapping lost or doubled shows up here.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    children = (
        tree.filter("level > 0")
        .groupBy(*SCOPE, parent.alias("path"))
        .agg(F.sum("amount").alias("expected"), F.sum("rows").alias("expected_rows"))
    )
    raw = ledger.groupBy(
        "tenant_id", "currency", month_key("posted_on").alias("month")
    ).agg(F.sum("amount").alias("expected"), F.count("*").alias("expected_rows"))
    raw = raw.select(*SCOPE, F.lit("root").alias("path"), "expected", "expected_rows")
    return (
        children.unionByName(raw)
        .join(tree, [*SCOPE, "path"], "left")
        .filter(
            ~F.col("amount").eqNullSafe(F.col("expected").cast(MONEY))
            | ~F.col("rows").eqNullSafe(F.col("expected_rows"))
        )
        .select(*SCOPE, "path", "amount", F.col("expected").cast(MONEY).alias("expected"))
    )


def merged_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Closed windows merged where they overlap or adjoin by at most one day.

    Deliveries first collapse to one row per start day, so a key's window is bounded
    by the calendar however many deliveries it has.
    """
    starts = windows.groupBy(*keys, "window_start").agg(F.max("window_end").alias("window_end"))
    order = W.partitionBy(*keys).orderBy("window_start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return (
        starts.withColumn("reach", F.max("window_end").over(before))
        .withColumn(
            "opens",
            F.when(F.col("window_start") <= F.date_add("reach", 1), 0).otherwise(1),
        )
        .withColumn("island", F.sum("opens").over(order))
        .groupBy(*keys, "island")
        .agg(F.min("window_start").alias("span_start"), F.max("window_end").alias("span_end"))
        .drop("island")
    )


def covered_months(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Whole months inside a merged span, as rows, so the containment join is an equi-join."""
    first = F.when(F.trunc("span_start", "MM") == F.col("span_start"), F.col("span_start")).otherwise(
        F.add_months(F.trunc("span_start", "MM"), 1)
    )
    last = F.add_months(F.trunc(F.date_add("span_end", 1), "MM"), -1)
    return (
        spans.select(*keys, first.alias("first"), last.alias("last"))
        .filter("first <= last")
        .select(
            *keys,
            F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month_start"),
        )
        .select(*keys, month_key("month_start").alias("month"))
        .distinct()
    )


def month_coverage(ledger: DataFrame, snapshots: DataFrame, threshold: str) -> DataFrame:
    """Rows, classified, awaiting review and completeness per tenant and month."""
    counts = ledger.groupBy("tenant_id", month_key("posted_on").alias("month")).agg(
        F.count("*").alias("rows"),
        F.count_if(~unclassified(F.col("effective_label"))).alias("classified"),
        F.count_if(needs_review(threshold)).alias("awaiting_review"),
    )
    complete = covered_months(merged_windows(snapshots, ["tenant_id"]), ["tenant_id"])
    return counts.join(
        complete.withColumn("hit", F.lit(True)), ["tenant_id", "month"], "left"
    ).select(
        "tenant_id", "month", "rows", "classified", "awaiting_review",
        F.coalesce("hit", F.lit(False)).alias("complete"),
    )


def with_previous_month(monthly: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each month beside the calendar month before it, missing side zero.

    Every row is emitted once as this month and once as next month's past, then summed:
    a full outer month-over-month join in one aggregation, with no self-join. Only
    months the ledger holds appear.
    """
    both = F.array(
        F.struct(F.col("month_start").alias("m"), F.lit(True).alias("now")),
        F.struct(F.add_months("month_start", 1).alias("m"), F.lit(False).alias("now")),
    )
    aggregates = []
    for name in values:
        aggregates.append(sum_when(~F.col("s.now"), F.col(name)).alias(f"previous_{name}"))
        aggregates.append(sum_when(F.col("s.now"), F.col(name)).alias(f"current_{name}"))
    return (
        monthly.select(*keys, *values, F.explode(both).alias("s"))
        .groupBy(*keys, F.col("s.m").alias("month_start"))
        .agg(*aggregates)
        .join(monthly.select("month_start").distinct(), "month_start", "left_semi")
    )


def observed_debits(ledger: DataFrame) -> DataFrame:
    """Money out by merchant and month beside the month before, whatever the label."""
    monthly = (
        ledger.filter("amount < 0")
        .groupBy("tenant_id", "currency", "merchant", month_start("posted_on").alias("month_start"))
        .agg(F.sum(-F.col("amount")).alias("debits"))
    )
    return with_previous_month(monthly, ["tenant_id", "currency", "merchant"], ["debits"]).select(
        "tenant_id", "currency", "merchant", month_key("month_start").alias("month"),
        F.col("previous_debits").alias("previous"), F.col("current_debits").alias("current"),
        (F.col("current_debits") - F.col("previous_debits")).cast(MONEY).alias("delta"),
    )


def debit_totals(debits: DataFrame) -> DataFrame:
    return debits.groupBy("tenant_id", "currency", "month").agg(
        money_sum(F.col("previous")).alias("previous"),
        money_sum(F.col("current")).alias("current"),
        money_sum(F.col("delta")).alias("delta"),
        F.count("*").alias("merchants"),
    )
