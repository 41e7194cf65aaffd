"""What is wrong with an annotation file, and how wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.text import blank, parse_amount, strip
from tallystone.operators.evaluate import label_set
from tallystone.vocab import LABEL_SPACE

# When a warning is due, and how many lines a finding names.
MIN_DOUBLE = 50
MIN_CLASS = 5
MIN_MERCHANTS = 10
LINES_NAMED = 10


def row_errors(rows: DataFrame) -> DataFrame:
    """(line, code) for every fault of every row, so one fault does not hide another."""
    text = {c: F.coalesce(strip(F.col(c)), F.lit("")) for c in (
        "transaction_id", "description", "amount", "annotator_a_label", "annotator_b_label",
        "final_label", "acceptable_labels", "ambiguity_note")}
    repeated = (
        rows.select(text["transaction_id"].alias("id_key"), "line").filter("id_key <> ''")
        .groupBy("id_key").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
        .filter("n > 1").drop("n")
    )
    wide = rows.select("line", *[c.alias(n) for n, c in text.items()]).withColumn(
        "accepted", label_set(F.col("acceptable_labels"))
    ).withColumn("money", parse_amount(F.col("amount"))).join(
        repeated, F.col("transaction_id") == F.col("id_key"), "left"
    )
    some = F.size("accepted") > 0
    gold = F.when(F.col("final_label") != "", F.col("final_label")).otherwise(F.col("annotator_a_label"))

    def invalid(column):
        return (F.col(column) != "") & ~F.col(column).isin(LABEL_SPACE)

    faults = {
        "id_blank": F.col("transaction_id") == "",
        "id_duplicate": F.col("line") > F.col("first_line"),
        "description_blank": blank(F.col("description")),
        "amount_unreadable": F.col("money").isNull(),
        "first_label_blank": F.col("annotator_a_label") == "",
        "first_label_invalid": invalid("annotator_a_label"),
        "second_label_invalid": invalid("annotator_b_label"),
        "final_label_invalid": invalid("final_label"),
        "accepted_label_invalid": F.exists("accepted", lambda x: ~x.isin(LABEL_SPACE)),
        "ambiguity_unexplained": some & (F.col("ambiguity_note") == ""),
        "one_accepted_label": F.size("accepted") == 1,
        "gold_not_accepted": some & (gold != "") & ~F.array_contains("accepted", gold),
    }
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in faults.items()]))
    return wide.select("line", F.explode(codes).alias("code"))


def error_findings(errors: DataFrame) -> DataFrame:
    """Per fault: how many rows, and the first lines."""
    order = W.partitionBy("code").orderBy("line")
    first = errors.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= LINES_NAMED)
    named = first.groupBy("code").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda n: n.cast("string")), ",")
        .alias("lines")
    )
    counts = errors.groupBy("code").agg(F.count("*").alias("n"))
    return counts.join(named, "code").select(F.lit("error").alias("severity"), "code", "n", "lines")


def dataset_findings(labelled: DataFrame) -> DataFrame:
    """Whole-dataset findings over well-formed rows; each check is one small aggregate."""
    agreed = F.col("agreed")
    facts = labelled.agg(
        F.count("*").alias("rows"),
        F.count_if(~agreed & F.col("adjudicated_label").isNull()).alias("unresolved"),
        F.count_if(agreed & F.col("adjudicated_label").isNotNull()
                   & (F.col("adjudicated_label") != F.col("primary_label"))).alias("overruled"),
        F.count_if(F.col("ambiguous")).alias("ambiguous"),
        F.count_if(F.col("secondary_label").isNotNull()).alias("double"),
    )
    labels = labelled.groupBy("gold").agg(
        F.count("*").alias("n"), F.count_if(F.col("secondary_label").isNotNull()).alias("doubled")
    ).agg(
        F.count("*").alias("labels"), F.count_if(F.col("doubled") > 0).alias("covered"),
        F.count_if(F.col("n") < MIN_CLASS).alias("thin"),
    )
    merchants = labelled.groupBy("merchant").agg(F.count("*").alias("n"))
    known = merchants.agg(F.count("*").alias("merchants"))
    wide = facts.withColumn("k", F.lit(1)).join(labels.withColumn("k", F.lit(1)), "k").join(
        known.withColumn("k", F.lit(1)), "k")

    def finding(when, severity, code, n):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                                     n.cast("bigint").alias("n")))

    double = F.col("double")
    checks = F.array_compact(F.array(
        finding(F.col("unresolved") > 0, "error", "unresolved_disagreement", F.col("unresolved")),
        finding(F.col("overruled") > 0, "warning", "overruled_agreement", F.col("overruled")),
        finding(F.col("ambiguous") * 5 > F.col("rows"), "warning", "ambiguous_share", F.col("ambiguous")),
        finding(double == 0, "error", "no_second_annotator", double),
        finding((double > 0) & (double < MIN_DOUBLE), "warning", "few_double_annotated", double),
        finding((double > 0) & (F.col("covered") * 2 < F.col("labels")), "warning", "label_coverage", F.col("covered")),
        finding(F.col("thin") > 0, "warning", "thin_classes", F.col("thin")),
        finding(F.col("merchants") < MIN_MERCHANTS, "warning", "few_merchants", F.col("merchants")),
    ))
    listed = wide.select(F.explode(checks).alias("f")).select("f.severity", "f.code", "f.n")
    # the three largest merchants, each only when above 15 percent
    top = merchants.orderBy(F.col("n").desc(), "merchant").limit(3).withColumn("k", F.lit(1)).join(
        facts.select("rows").withColumn("k", F.lit(1)), "k"
    ).filter(F.col("n") * 100 > F.col("rows") * 15)
    return listed.unionByName(top.select(
        F.lit("warning").alias("severity"), F.concat(F.lit("heavy_merchant "), F.col("merchant")).alias("code"), "n"
    ))


def top_merchants(labelled: DataFrame, k: int = 3) -> DataFrame:
    """Largest merchants with their share of rows, in ten-thousandths."""
    from tallystone.functions.ledger import half_even_ratio

    counts = labelled.groupBy("merchant").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows")).withColumn("k", F.lit(1))
    return counts.orderBy(F.col("n").desc(), "merchant").limit(k).withColumn("k", F.lit(1)).join(
        total, "k"
    ).select("merchant", "n", half_even_ratio(F.col("n"), F.col("rows")).alias("share"))
