"""Trees, spend change, duplicates and recurrence on worked examples."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallystone.operators import investigate, recurrence, reports, review, spend

ROW = ("tenant_id int, id string, posted_on string, merchant string, amount string, currency string,"
       " suggested_label string, confirmed_label string")


def ledger(spark, rows):
    frame = spark.createDataFrame([(1, f"t{i}", *r) for i, r in enumerate(rows)], ROW)
    return frame.withColumn("posted_on", F.to_date("posted_on")).withColumn(
        "amount", F.col("amount").cast("decimal(18,2)")).withColumn(
        "effective_label", F.coalesce("confirmed_label", "suggested_label"))


def august(amount, label, confirmed=True):
    return ("2026-08-10", "M", amount, "USD", label, label if confirmed else None)


MONTH = [august("5000.00", "INCOME"), august("-12.34", "LIVING_DINING"), august("-500.00", "TRANSFER"),
         august("-9.99", None), ]


def nodes(tree):
    return {r["path"]: (str(r["amount"]), r["rows"], r["evidence"]) for r in tree.collect()}


def test_tree_reconciles_and_fills_branches(spark):
    rows = ledger(spark, [*MONTH, august("-1.00", "UNKNOWN")])
    tree = reports.monthly_tree(rows)
    got = nodes(tree)
    assert got["root"] == ("4476.67", 5, "ASSUMED") and got["root/refunds"] == ("0.00", 0, "ASSUMED")
    assert got["root/income"][2] == "USER_CONFIRMED" and got["root/unclassified/never_examined"][0] == "-9.99"
    assert got["root/unclassified/examined_no_answer"][0] == "-1.00" and got["root/spending/LIVING_DINING"][1] == 1
    assert reports.tree_breaks(rows, tree).count() == 0


def test_one_guess_makes_the_root_a_guess(spark):
    sure = nodes(reports.monthly_tree(ledger(spark, MONTH[:3])))
    guess = nodes(reports.monthly_tree(ledger(spark, [*MONTH[:3], august("-1", "LIVING_GYM", False)])))
    assert sure["root"][2] == "USER_CONFIRMED" and guess["root"][2] == "ASSUMED"


def test_a_lost_or_doubled_row_breaks_the_tree(spark):
    rows = ledger(spark, MONTH)
    for changed in (rows.filter("id <> 't1'"), rows.unionByName(rows.filter("id = 't1'"))):
        broken = reports.tree_breaks(rows, reports.monthly_tree(changed)).collect()
        assert "root" in {r["path"] for r in broken}
    tree = reports.monthly_tree(rows).withColumn(
        "amount", F.when(F.col("path") == "root/spending", F.col("amount") + 1).otherwise(F.col("amount")))
    assert {r["path"] for r in reports.tree_breaks(rows, tree).collect()} == {"root", "root/spending"} - {"root"} | {"root"}


def test_windows_merge_and_cover(spark):
    windows = spark.createDataFrame(
        [("2026-01-01", "2026-01-15"), ("2026-01-16", "2026-02-10"), ("2026-02-12", "2026-03-31"), ("2026-03-01", "2026-03-02")],
        "s string, e string").select(F.lit(1).alias("tenant_id"), F.to_date("s").alias("window_start"), F.to_date("e").alias("window_end"))
    spans = reports.merged_windows(windows, ["tenant_id"])
    assert sorted((str(r[1]), str(r[2])) for r in spans.collect()) == [("2026-01-01", "2026-02-10"), ("2026-02-12", "2026-03-31")]
    assert sorted(r["month"] for r in reports.covered_months(spans, ["tenant_id"]).collect()) == ["2026-01", "2026-03"]


def test_spend_change_example(spark):
    july = [("2026-07-05", "STORE", "-10.00", "USD", "LIVING_OTHER", "LIVING_OTHER"),
            ("2026-07-06", "OTHER", "2.00", "USD", "REFUND", None)]
    aug = [("2026-08-05", "STORE", "-17.00", "USD", "LIVING_OTHER", "LIVING_OTHER"),
           ("2026-08-05", "OTHER", "-6.00", "USD", "LIVING_OTHER", None),
           ("2026-08-06", "OTHER", "5.00", "USD", "REFUND", "REFUND"),
           ("2026-08-07", "X", "-100.00", "USD", "TRANSFER", None), ("2026-08-08", "X", "-7.00", "USD", None, None),
           ("2026-08-09", "X", "-4.00", "USD", "INCOME", "INCOME"), ("2026-08-09", "X", "0.00", "USD", "LIVING_GYM", "LIVING_GYM"),
           ("2026-08-09", "STORE", "-50.00", "EUR", "LIVING_OTHER", "LIVING_OTHER")]
    rows = ledger(spark, july + aug)
    period = spend.spend_periods(rows).filter("currency = 'USD' and month_start = '2026-08-01'").first()
    assert [str(period[c]) for c in ("gross_spending", "refunds", "net_spending", "unclassified_debits",
            "transfer_debits", "inconsistent_debits")] == ["23.00", "5.00", "18.00", "7.00", "100.00", "4.00"]
    assert (period["suggested_rows"], period["inconsistent_rows"], period["unclassified_rows"]) == (2, 2, 1)
    drivers = spend.merchant_drivers(rows)
    got = {(r["currency"], r["merchant"]): str(r["delta"]) for r in drivers.filter("month = '2026-08'").collect()}
    assert got == {("USD", "STORE"): "7.00", ("USD", "OTHER"): "3.00", ("EUR", "STORE"): "50.00"}
    change = spend.period_change(spend.spend_periods(rows))
    assert spend.driver_breaks(change, drivers).count() == 0
    assert spend.driver_breaks(change, drivers.filter("merchant <> 'OTHER'")).count() > 0


def test_review_queue(spark):
    rows = [("2026-08-01", "M", "-1", "USD", "LIVING_GYM", None, "0.950"), ("2026-08-02", "M", "-1", "USD", "LIVING_GYM", None, "0.400"),
            ("2026-08-03", "M", "-1", "USD", "UNKNOWN", None, "0.000"), ("2026-08-04", "M", "-1", "USD", None, None, None),
            ("2026-08-04", "M", "-1", "USD", None, None, None), ("2026-08-05", "M", "-1", "USD", "LIVING_GYM", None, None)]
    frame = spark.createDataFrame([(1, f"t{i}", *r) for i, r in enumerate(rows)], ROW + ", suggested_confidence string").withColumn(
        "suggested_confidence", F.col("suggested_confidence").cast("decimal(4,3)")).withColumn("posted_on", F.to_date("posted_on")).withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))
    queue = review.awaiting_review(frame, "0.600").orderBy(F.desc("posted_on"), "id").collect()
    assert [r["posted_on"].day for r in queue] == [4, 4, 3, 2]
    group = review.review_groups(review.awaiting_review(frame, "0.600")).first()
    assert (group["rows"], group["suggested_default"]) == (4, "LIVING_GYM")


def charges(spark, rows):
    return spark.createDataFrame(
        [(i, n, dt.date(2026, 8, 14), m, "2026-08", who, Decimal(a), False) for i, (n, m, who, a) in enumerate(rows)],
        "seq bigint, id string, posted_on date, minute_of_day int, period string, merchant string, amount decimal(18,2), receipt boolean")


def test_duplicate_window(spark):
    rows = charges(spark, [("A1", 10, "AWS", "4850"), ("B2", 14, "AWS", "4850"), ("C", 10, "AWS", "4850"), ("D", 16, "AWS", "4850"),
                           ("E", 11, "AWS", "4851"), ("F", 12, "GCP", "4850")])
    pairs = {(r["id"], r["minutes_apart"], r["partners"], r["first_partner"]) for r in investigate.duplicate_pairs(rows).collect()}
    assert pairs == {("A1", 4, 1, "B2"), ("C", 4, 1, "B2"), ("B2", 2, 1, "D")}
    members = investigate.duplicate_members(rows)
    first = investigate.first_pair(members, ["period"]).first()
    assert (first["left_id"], first["right_id"], first["members"]) == ("A1", "B2", 4)


def test_hot_duplicates_stay_linear(spark):
    """A third of a million charges that all look alike: rows out grow with rows in."""
    n = 20000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.lit(dt.date(2026, 8, 14)).alias("posted_on"),
        (F.col("id") % 1440).cast("int").alias("minute_of_day"), F.lit("2026-08").alias("period"), F.lit("HOT").alias("merchant"),
        F.lit(Decimal("1.00")).cast("decimal(18,2)").alias("amount"), F.lit(True).alias("receipt"))
    pairs = investigate.duplicate_pairs(rows)
    counts = rows.groupBy("minute_of_day").count().collect()
    per = {r["minute_of_day"]: r["count"] for r in counts}
    exact = sum(per[m] * per.get(m + d, 0) for m in per for d in range(1, 6))
    assert pairs.agg(F.sum("partners")).first()[0] == exact and pairs.count() <= 5 * n


def series(spark, days, amounts, kind="SPENDING"):
    rows = [("M", kind, dt.date(2026, 1, 1) + dt.timedelta(days=d), Decimal(str(a))) for d, a in zip(days, amounts)]
    return spark.createDataFrame(rows, "merchant string, kind string, posted_on date, amount decimal(18,2)")


def found(spark, days, amounts, kind="SPENDING"):
    return recurrence.recurring_charges(series(spark, days, amounts, kind)).collect()


def test_monthly_series(spark):
    row = found(spark, range(0, 180, 30), ["-15.99"] * 6)[0]
    assert (row["cadence"], str(row["annual_cost"]), row["price_changed"]) == ("MONTHLY", "-191.88", False)
    assert str(row["confidence"]) == "0.6500" and row["typical_amount"] == Decimal("-15.99")
    jitter = [i * 30 + j for i, j in enumerate((0, 2, -1, 3, -2, 1))]
    assert found(spark, jitter, ["-15.99"] * 6)[0]["cadence"] == "MONTHLY"
    rise = found(spark, range(0, 180, 30), ["-15.99"] * 4 + ["-17.99"] * 2)[0]
    assert rise["price_changed"] and rise["latest_amount"] == Decimal("-17.99")
    odd = found(spark, range(0, 120, 30), ["-1.10", "-1.15", "-1.10", "-1.15"])[0]
    assert odd["typical_amount"] == Decimal("-1.125")


def test_what_is_not_recurring(spark):
    assert found(spark, [0, 30], ["-5", "-5"]) == []
    assert found(spark, [0, 5, 60, 64], ["-5"] * 4) == []
    assert found(spark, [0, 30, 60, 90], ["-5", "-50", "-9", "-80"]) == []
    assert found(spark, [0, 30, 60], ["-5"] * 3, "TRANSFER") == []
    assert found(spark, [0, 30, 30, 60], ["-5"] * 4) == []
    assert found(spark, [0, 30, 60], ["0", "0", "0"])[0]["annual_cost"] == 0
