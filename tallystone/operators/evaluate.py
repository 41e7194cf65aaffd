"""Scoring categorisers: per-label metrics, strata, agreement, thresholds, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.ledger import half_even_ratio
from tallystone.functions.text import strip
from tallystone.vocab import UNKNOWN

THRESHOLDS = [f"{step * 5 / 100:.2f}" for step in range(21)]


def label_set(text: Column) -> Column:
    """Labels separated by a vertical bar as a sorted array; empty when none is given."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: strip(p))
    return F.sort_array(F.array_distinct(F.filter(parts, lambda p: p != "")))


def gold_label() -> Column:
    return F.coalesce("adjudicated_label", "primary_label")


def annotators_agree() -> Column:
    """Null when only one annotator saw the row."""
    return F.when(F.col("secondary_label").isNotNull(), F.col("primary_label") == F.col("secondary_label"))


def is_correct(predicted: Column, gold: Column, acceptable: Column) -> Column:
    """Abstaining is wrong; an accepted set decides where one was authored."""
    return F.when(predicted == UNKNOWN, False).when(
        F.size(acceptable) > 0, F.array_contains(acceptable, predicted)
    ).otherwise(predicted == gold)


def label_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Labels, each once per key, that ``left`` has and ``right`` lacks."""
    return left.select(*keys, "label").distinct().join(right.select(*keys, "label"), [*keys, "label"], "left_anti")


def strata(row: DataFrame) -> DataFrame:
    """Each row once per stratum it belongs to; strata without rows stay absent."""
    names = F.array_compact(F.array(
        F.lit("overall"),
        F.when(F.size("acceptable") > 0, "ambiguous").otherwise("unambiguous"),
        F.when(F.col("agreed"), "annotators agreed"),
        F.when(~F.col("agreed"), "annotators disagreed"),
    ))
    return row.withColumn("stratum", F.explode(names))


def answer_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per (gold, predicted, hit): all that any score needs, from one pass."""
    hit = is_correct(F.col("predicted"), F.col("gold"), F.col("acceptable"))
    return rows.groupBy(*keys, "gold", "predicted", hit.alias("hit")).agg(F.count("*").alias("n"))


def label_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 per label; hits are credited to the gold label."""
    zero = F.lit(0).cast("bigint")
    answered = F.col("predicted") != UNKNOWN
    sides = F.array_compact(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("hit"), F.col("n")).otherwise(zero).alias("tp")),
        F.when(answered, F.struct(F.col("predicted").alias("label"), zero.alias("support"),
                                  F.col("n").alias("predicted"), zero.alias("tp"))),
    ))
    per = cells.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*").groupBy(
        *keys, "label"
    ).agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    scored = per.withColumn("precision", half_even_ratio(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", half_even_ratio(F.col("tp"), F.col("support"))
    )
    p, r = (F.col("precision") * 10000).cast("bigint"), (F.col("recall") * 10000).cast("bigint")
    return scored.select(
        *keys, "label", "support", "predicted", "precision", "recall",
        half_even_ratio(2 * p * r, (p + r) * 10000).alias("f1"),
    )


def system_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Headline figures from the same cells; averages use the rounded per-label F1."""
    answered = F.col("predicted") != UNKNOWN
    head = cells.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(~answered, F.col("n"))), F.lit(0)).alias("abstentions"),
    )
    f = (F.col("f1") * 10000).cast("bigint")
    averages = label_scores(cells, keys).groupBy(*keys).agg(
        half_even_ratio(F.sum(f), F.count("*") * 10000).alias("macro_f1"),
        half_even_ratio(F.sum(f * F.col("support")), F.sum("support") * 10000).alias("weighted_f1"),
    )
    given = F.col("total") - F.col("abstentions")
    return head.join(averages, keys).select(
        *keys, "total", "correct", "abstentions", "macro_f1", "weighted_f1",
        half_even_ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        half_even_ratio(given, F.col("total")).alias("coverage"),
        F.when(given > 0, half_even_ratio(F.col("correct"), given)).alias("accuracy_when_answered"),
    )


def top_confusions(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Most frequent mistakes, ties by label pair."""
    wrong = cells.filter("gold <> predicted").groupBy(*keys, "gold", "predicted").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.col("n").desc(), "gold", "predicted")
    return wrong.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def best_system(scores: DataFrame, order: list[str]) -> DataFrame:
    """Highest macro F1; the system listed first wins a tie."""
    listed = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("system"))
    return scores.withColumn("_at", listed).orderBy(F.col("macro_f1").desc(), "_at").limit(1).drop("_at")


def kappa(pairs: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """Agreement beyond chance as (n*agree - E) / (n*n - E); null when E equals n*n."""
    if not keys:
        return kappa(pairs.withColumn("_all", F.lit(0)), first, second, ["_all"]).drop("_all")
    cells = pairs.groupBy(*keys, first, second).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col(first).alias("label"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")),
        F.struct(F.col(second).alias("label"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")),
    )
    chance = (
        cells.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.label")
        .agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b")).groupBy(*keys)
        .agg(F.sum(F.col("a").cast("decimal(19,0)") * F.col("b").cast("decimal(18,0)")).cast("decimal(38,0)").alias("e"))
    )
    seen = cells.groupBy(*keys).agg(
        F.sum("n").alias("double_annotated"),
        F.coalesce(F.sum(F.when(F.col(first) == F.col(second), F.col("n"))), F.lit(0)).alias("agreed"),
    )
    n = F.col("double_annotated").cast("decimal(18,0)")
    above = (n * F.col("agreed").cast("decimal(18,0)")).cast("decimal(38,0)") - F.col("e")
    most = (n * n).cast("decimal(38,0)") - F.col("e")
    return seen.join(chance, keys).select(
        *keys, "double_annotated", "agreed",
        half_even_ratio(F.col("agreed"), F.col("double_annotated")).alias("raw_agreement"),
        F.when(most != 0, half_even_ratio(above, most)).alias("kappa"),
    )


def threshold_sweep(predictions: DataFrame, thresholds: list[str], keys: list[str]) -> DataFrame:
    """Coverage, accuracy and queue per threshold.

    Each row counts once, under the number of thresholds its confidence reaches; the
    few buckets then spread over the thresholds below them. No row meets 21 thresholds.
    """
    grid = sorted(thresholds)
    marks = F.array(*[F.lit(t).cast("decimal(4,3)") for t in grid])
    reached = sum(((F.col("confidence") >= F.lit(t).cast("decimal(4,3)")).cast("int") for t in grid), F.lit(0))
    buckets = predictions.groupBy(*keys, reached.alias("reached")).agg(
        F.count("*").alias("n"), F.count_if(F.col("correct")).alias("right")
    )
    whole = buckets.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("right").alias("all_right"))
    points = buckets.select(
        *keys, "n", "right", "reached", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("at")
    ).groupBy(*keys, "at").agg(
        F.sum(F.when(F.col("reached") >= F.col("at"), F.col("n")).otherwise(0)).alias("answered"),
        F.sum(F.when(F.col("reached") >= F.col("at"), F.col("right")).otherwise(0)).alias("right"),
    )
    return points.join(whole, keys).select(
        *keys, F.element_at(marks, F.col("at")).alias("threshold"),
        half_even_ratio(F.col("answered"), F.col("total")).alias("coverage"),
        half_even_ratio(F.col("right"), F.col("answered")).alias("accuracy_when_answered"),
        (F.col("total") - F.col("answered")).alias("queued"), "answered", "right", "total", "all_right",
    )


def choose_threshold(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Best separation of right from wrong; the lowest threshold wins a tie.

    P(queued | wrong) + P(trusted | right) over the common denominator, as integers.
    """
    wrong = F.col("total") - F.col("all_right")
    wrong_queued = wrong - (F.col("answered") - F.col("right"))
    wide = "decimal(18,0)"
    j = wrong_queued.cast(wide) * F.col("all_right").cast(wide) + F.col("right").cast(wide) * wrong.cast(wide)
    usable = sweep.filter((wrong > 0) & (F.col("all_right") > 0)).withColumn("_j", j)
    order = W.partitionBy(*keys).orderBy(F.col("_j").desc(), "threshold")
    return usable.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*keys, "threshold")


def nearest_rank(values: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles from counts per distinct value, one row per key."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(whole))
    picks = []
    for p in percents:
        rank = F.greatest(F.lit(1), F.floor((F.col("_all") * p + 99) / 100))
        picks.append(F.min(F.when(F.col("_upto") >= rank, F.col(value))).alias(f"p{p}_{value}"))
    return ranked.groupBy(*keys).agg(*picks)


def usage(calls: DataFrame, input_price: str | None, output_price: str | None) -> DataFrame:
    """Calls, tokens, latency and cost per system; unpriced is null, not zero."""
    done = calls.filter(~F.col("failed"))
    sums = calls.groupBy("system").agg(
        F.count_if(~F.col("failed")).alias("calls"),
        F.sum(F.when(~F.col("failed"), F.col("input_tokens")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(~F.col("failed"), F.col("output_tokens")).otherwise(0)).alias("output_tokens"),
        half_even_ratio(
            F.sum(F.when(~F.col("failed"), F.col("latency_ms")).otherwise(0)),
            F.count_if(~F.col("failed")), 0,
        ).cast("bigint").alias("mean_latency_ms"),
        F.count_if(F.col("failed")).alias("failures"),
        F.count_if(F.col("rejected") & ~F.col("failed")).alias("rejected"),
        F.count("*").alias("rows"),
    )
    if input_price is None or output_price is None:
        cost = F.lit(None).cast("decimal(28,10)")
    else:
        price = [F.lit(p).cast("decimal(9,4)") for p in (input_price, output_price)]
        cost = (
            (F.col("input_tokens").cast("decimal(18,0)") * price[0]
             + F.col("output_tokens").cast("decimal(18,0)") * price[1])
            * F.lit("0.000001").cast("decimal(6,6)")
        ).cast("decimal(28,10)")
    return sums.join(nearest_rank(done, ["system"], "latency_ms", [50, 95]), "system").withColumn(
        "cost", cost
    ).withColumn(
        "cost_per_row", F.round(F.col("cost") / F.col("rows"), 8).cast("decimal(18,8)")
    )


def dataset_digest(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Content digest that ignores row order: count and sums of per-row SHA-256 parts.

    A sorted hash of all lines would pass every line through one task; the sum of the
    rows' own digests changes with any row and combines map-side.
    """
    line = F.concat_ws(chr(31), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    digest = F.sha2(line, 256)

    def part(start):
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")

    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.sum(part(1)).cast("decimal(38,0)").alias("digest_a"),
        F.sum(part(16)).cast("decimal(38,0)").alias("digest_b"),
    )
