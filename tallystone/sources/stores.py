"""Tables written and grown: ledger, accounts, datasets, comparison runs, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.identity import FINGERPRINT_VERSION, with_account_key


def merge_unseen(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows as they are, plus incoming rows whose key is new."""
    return existing.unionByName(incoming.join(existing.select(*key), key, "left_anti"))


def append_ledger(rows: DataFrame, path: str) -> None:
    """New charges with their provenance, one folder per posting month.

    Rows are written by the tasks that hold them, so a hot month is not one task; rows that
    come numbered lie by account or by parts of one.
    """
    month = F.date_format("posted_on", "yyyy-MM")
    rows.withColumn("posted_month", month).withColumn(
        "fingerprint_version", F.lit(FINGERPRINT_VERSION)
    ).write.mode("append").option("compression", "zstd").partitionBy("posted_month").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register_accounts(names: DataFrame, existing: DataFrame) -> DataFrame:
    """One new account per (tenant, canonical key); the first name in order is shown.

    ``names`` has tenant_id, display_name and position; names without a letter or digit
    give no key and are left for ``unnamed_accounts``.
    """
    keyed = with_account_key(names, "display_name").filter("account_key is not null")
    order = W.partitionBy("tenant_id", "account_key").orderBy("position")
    first = keyed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return first.join(existing.select("tenant_id", "account_key"), ["tenant_id", "account_key"], "left_anti").select(
        "tenant_id", "account_key", F.trim("display_name").alias("display_name"))


def unnamed_accounts(names: DataFrame) -> DataFrame:
    return with_account_key(names, "display_name").filter("account_key is null")


def accepted_runs(runs: DataFrame, months: DataFrame, existing: DataFrame) -> DataFrame:
    """Runs that may be stored: every month reconciles and the run id is new."""
    broken = months.filter("residual <> 0").select("run_id").distinct()
    return runs.join(broken, "run_id", "left_anti").join(existing.select("run_id"), "run_id", "left_anti")


def run_components(deltas: DataFrame) -> DataFrame:
    """Component lines of a run in display order, money at two places."""
    order = W.partitionBy("run_id").orderBy(F.abs("delta").desc(), "code")
    money = [F.round(c, 2).cast("decimal(18,2)").alias(c) for c in ("current_cash", "candidate_cash", "delta")]
    return deltas.withColumn("position", F.row_number().over(order) - 1).select("run_id", "position", "code", *money)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), "run_id").limit(limit)


def append_runs(runs: DataFrame, components: DataFrame, folder: str) -> None:
    """Two append-only tables; a run is visible once its header row is."""
    kept = components.join(runs.select("run_id"), "run_id", "left_semi")
    kept.write.mode("append").parquet(f"{folder}/components")
    runs.write.mode("append").parquet(f"{folder}/runs")


def write_annotation_file(rows: DataFrame, folder: str) -> None:
    """Subset rows for annotators, masked, range-sorted by (posted_on, id), empty labels."""
    empty = [F.lit("").alias(c) for c in (
        "annotator_a_label", "annotator_b_label", "final_label", "acceptable_labels", "ambiguity_note")]
    rows.select(
        "transaction_id", F.col("masked").alias("description"),
        F.col("amount").cast("decimal(18,2)").alias("amount"), *empty, "posted_on",
    ).orderBy("posted_on", "transaction_id").write.mode("errorifexists").option("header", True).option(
        "quoteAll", True).option("escape", '"').csv(folder)
