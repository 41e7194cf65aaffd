"""Rule, model and hybrid labelling, the split they are fitted on, label accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions.ledger import half_even_ratio
from tallystone.vocab import LABEL_SPACE, TRANSFER_WORDS, UNKNOWN

# Split buckets and salt, routing threshold, rule confidences.
BUCKETS = 10000
SPLIT_SALT = "merchant-split-v1"
ROUTING_THRESHOLD = "0.75"
KEYWORD_CONFIDENCE = "0.7"
SIGN_CONFIDENCE = "0.5"
VIEW = ["merchant", "description", "amount", "account_type"]
CONFIDENCE = "decimal(9,6)"


def split_bucket(merchant: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt + chr(31)), merchant), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % BUCKETS


def merchant_split(rows: DataFrame, holdout_percent: int = 30, salt: str = SPLIT_SALT) -> DataFrame:
    """All rows of a merchant on one side; another salt gives another split."""
    bucket = split_bucket(F.col("merchant"), salt)
    return rows.withColumn(
        "side", F.when(bucket < holdout_percent * BUCKETS // 100, "holdout").otherwise("development")
    )


def split_refusals(rows: DataFrame, keys: list[str], holdout_percent: int = 30, salt: str = SPLIT_SALT) -> DataFrame:
    """Datasets whose split leaves a side empty, with the side: a score on it would say nothing.

    ``keys`` name the datasets within ``rows``. A percentage outside 1 to 99 is an error.
    """
    if not 0 < holdout_percent < 100:
        raise ValueError(f"holdout_percent must be between 0 and 100 exclusive, got {holdout_percent}")
    sides = merchant_split(rows, holdout_percent, salt).groupBy(*keys, "merchant", "side").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count("*").alias("merchants"),
        F.count_if(F.col("side") == "development").alias("development"), F.count_if(F.col("side") == "holdout").alias("holdout"))
    empty = F.when(F.col("development") == 0, "development").when(F.col("holdout") == 0, "holdout")
    return sides.select(*keys, "rows", "merchants", empty.alias("empty_side")).filter("empty_side is not null")


def fit_rules(labelled: DataFrame) -> DataFrame:
    """Majority gold label per merchant; an exact tie goes to the first alphabetically."""
    counts = labelled.groupBy("merchant", "gold").agg(F.count("*").alias("n"))
    return counts.groupBy("merchant").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("gold").alias("label"))).alias("top"),
        F.sum("n").alias("total"),
    ).select(
        "merchant", F.col("top.label").alias("rule_label"), (-F.col("top.rank")).alias("hits"), "total",
        (F.col("top.rank").cast("decimal(18,0)") / -F.col("total").cast("decimal(18,0)")).cast(CONFIDENCE)
        .alias("consistency"),
    )


def predict_rules(views: DataFrame, rules: DataFrame) -> DataFrame:
    """Merchant knowledge, then transfer words, then the sign, else abstain."""
    said = F.upper(F.concat_ws(" ", "description", "merchant"))
    keyword = F.lit(False)
    for word in TRANSFER_WORDS:
        keyword = keyword | F.contains(said, F.lit(word))
    known = F.col("rule_label").isNotNull()
    joined = views.join(rules.select("merchant", "rule_label", "consistency"), "merchant", "left")
    step = F.when(known, "merchant").when(keyword, "keyword").when(F.col("amount") > 0, "sign").otherwise("abstain")
    return (
        joined.withColumn("reason", step)
        .withColumn(
            "predicted",
            F.when(F.col("reason") == "merchant", F.col("rule_label"))
            .when(F.col("reason") == "keyword", "TRANSFER")
            .when(F.col("reason") == "sign", "INCOME").otherwise(UNKNOWN),
        )
        .withColumn(
            "confidence",
            F.when(F.col("reason") == "merchant", F.col("consistency"))
            .when(F.col("reason") == "keyword", F.lit(KEYWORD_CONFIDENCE).cast(CONFIDENCE))
            .when(F.col("reason") == "sign", F.lit(SIGN_CONFIDENCE).cast(CONFIDENCE))
            .otherwise(F.lit(0)).cast(CONFIDENCE),
        )
        .drop("rule_label", "consistency")
    )


def call_model(views: DataFrame, model: Callable, tasks: int) -> DataFrame:
    """Answers of a user function over the four view columns, in Arrow batches.

    ``model`` maps a pandas frame of views to one with raw_label, raw_confidence and
    failed. Calls are spread over ``tasks`` tasks, the parallelism a provider allows.
    """
    schema = T.StructType([
        *views.schema.fields,
        T.StructField("raw_label", T.StringType()),
        T.StructField("raw_confidence", T.DecimalType(9, 6)),
        T.StructField("failed", T.BooleanType()),
    ])
    names = [f.name for f in schema.fields]

    def batches(frames):
        for frame in frames:
            answers = model(frame[VIEW])
            for column in ("raw_label", "raw_confidence", "failed"):
                frame[column] = answers[column].to_numpy()
            yield frame[names]

    return views.repartition(tasks).mapInPandas(batches, schema)


def check_answers(answers: DataFrame) -> DataFrame:
    """Labels outside the taxonomy and failures become abstentions; confidence in 0..1."""
    rejected = ~F.col("failed") & ~F.coalesce(F.col("raw_label").isin(LABEL_SPACE), F.lit(False))
    clamped = F.greatest(F.lit(0), F.least(F.lit(1), F.col("raw_confidence"))).cast(CONFIDENCE)
    usable = ~F.col("failed") & ~rejected
    return answers.withColumn("rejected", rejected).withColumn(
        "predicted", F.when(usable, F.col("raw_label")).otherwise(UNKNOWN)
    ).withColumn(
        "confidence", F.when(usable, clamped).otherwise(F.lit(0).cast(CONFIDENCE))
    ).drop("raw_label", "raw_confidence")


def route(rule_answers: DataFrame, threshold: str = ROUTING_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(answered by rules, escalated): only the second part ever meets the model."""
    sure = (F.col("predicted") != UNKNOWN) & (
        F.col("confidence") >= F.lit(threshold).cast(CONFIDENCE)
    )
    return rule_answers.filter(sure), rule_answers.filter(~sure)


def hybrid(rule_answers: DataFrame, model: Callable[[DataFrame], DataFrame], key: str,
           threshold: str = ROUTING_THRESHOLD) -> DataFrame:
    """Rules where they are sure, else the model, else a weak rule.

    ``model`` maps the escalated rows to (key, predicted, confidence).
    """
    kept, escalated = route(rule_answers, threshold)
    answers = model(escalated.drop("predicted", "confidence", "reason")).select(
        key, F.col("predicted").alias("m_label"), F.col("confidence").alias("m_confidence")
    )
    joined = escalated.join(answers, key, "left")
    model_answers = F.coalesce(F.col("m_label") != UNKNOWN, F.lit(False))
    weak = F.col("predicted") != UNKNOWN
    routed = joined.select(
        *[c for c in escalated.columns if c not in ("predicted", "confidence", "reason")],
        F.when(model_answers, F.col("m_label")).otherwise(F.col("predicted")).alias("predicted"),
        F.when(model_answers, F.col("m_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(model_answers, "model").when(weak, "weak rule").otherwise("abstain").alias("reason"),
    )
    return kept.withColumn("reason", F.lit("rules")).select(routed.columns).unionByName(routed)


def cascade(rows: DataFrame, rules: DataFrame, model: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Rules first, the model on what they abstain on; each answer with its source."""
    judged = predict_rules(rows, rules)
    answered = judged.filter(F.col("predicted") != UNKNOWN).select(
        key, "predicted", "confidence", F.lit("rules").alias("source")
    )
    open_rows = judged.filter(F.col("predicted") == UNKNOWN).drop("predicted", "confidence", "reason")
    modelled = model(open_rows).select(key, "predicted", "confidence", F.lit("model").alias("source"))
    return answered.unionByName(modelled)


def run_accounting(labelled: DataFrame, price_per_row: str) -> DataFrame:
    """Rows and abstentions per source, and what the model's rows cost at most."""
    price = F.lit(price_per_row).cast("decimal(9,6)")
    return labelled.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if(F.col("predicted") == UNKNOWN).alias("abstained")
    ).withColumn(
        "estimated_cost",
        F.when(F.col("source") == "model", F.col("rows").cast("decimal(18,0)") * price)
        .otherwise(F.lit(0)).cast("decimal(28,6)"),
    )


def escalation_rate(hybrid_rows: DataFrame) -> DataFrame:
    escalated = F.count_if(F.col("reason") != "rules")
    return hybrid_rows.agg(
        F.count("*").alias("rows"), escalated.alias("escalated"),
        half_even_ratio(escalated, F.count("*")).alias("escalation_rate"),
    )


def remembered_labels(annotated: DataFrame) -> DataFrame:
    """Last label an annotator gave each merchant, in row order."""
    given = annotated.filter("label is not null and label <> ''")
    return given.groupBy("merchant").agg(F.max_by("label", "row_no").alias("label"))


def annotation_worklist(rows: DataFrame, which: str) -> DataFrame:
    """Rows an annotation pass still has to look at: pass a, pass b, or the final one."""
    empty = {c: F.coalesce(F.col(c), F.lit("")) == "" for c in
             ("primary_label", "secondary_label", "adjudicated_label")}
    if which == "a":
        return rows.filter(empty["primary_label"])
    if which == "b":
        return rows.filter(empty["secondary_label"])
    return rows.filter(
        ~empty["primary_label"] & ~empty["secondary_label"] & empty["adjudicated_label"]
        & (F.col("primary_label") != F.col("secondary_label"))
    )
