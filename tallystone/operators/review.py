"""The review queue, tenant scope, and label events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions.ledger import MONEY, needs_review
from tallystone.vocab import LABEL_SPACE, UNKNOWN


def awaiting_review(ledger: DataFrame, threshold: str) -> DataFrame:
    """Newest first when written out; ids break ties."""
    return ledger.filter(needs_review(threshold))


def unclassified_rows(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows no categoriser has looked at; one that abstained has looked."""
    rows = ledger.filter(F.col("suggested_label").isNull())
    return rows if limit is None else rows.orderBy("posted_on", "id").limit(limit)


def to_classify(ledger: DataFrame, reclassify: bool) -> DataFrame:
    """Untouched rows, or on request every unconfirmed one with any confidence."""
    return awaiting_review(ledger, "1.001") if reclassify else unclassified_rows(ledger)


def review_groups(queue: DataFrame) -> DataFrame:
    """The queue by merchant, with a default only where all suggestions agree."""
    real = F.when(F.col("suggested_label") != UNKNOWN, F.col("suggested_label"))
    return queue.groupBy("tenant_id", "merchant").agg(
        F.max("posted_on").alias("latest"),
        F.count("*").alias("rows"),
        F.sum("amount").cast(MONEY).alias("total"),
        # min equals max exactly when one distinct suggestion exists; no set is built
        F.when(F.min(real) == F.max(real), F.min(real)).alias("suggested_default"),
    )


def tenant_scope(rows: DataFrame, accounts: DataFrame, tenant_id) -> DataFrame:
    """Rows of the tenant's own accounts; anyone else's behave as absent."""
    own = accounts.filter(F.col("tenant_id") == tenant_id).select("account_id")
    return rows.join(own, "account_id", "left_semi")


def ownership(claims: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per tenant, how many claimed accounts are its own and how many are not."""
    owned = accounts.select("account_id", F.col("tenant_id").alias("owner"))
    return (
        claims.join(owned, "account_id", "left")
        .groupBy("tenant_id")
        .agg(
            F.count_if(F.col("owner") == F.col("tenant_id")).alias("own"),
            F.count_if(F.coalesce(F.col("owner") != F.col("tenant_id"), F.lit(True))).alias("refused"),
        )
    )


def unknown_labels(ledger: DataFrame, column: str = "effective_label") -> DataFrame:
    """Labels outside the taxonomy, with how many rows carry each."""
    label = F.col(column)
    return (
        ledger.filter(label.isNotNull() & ~label.isin(LABEL_SPACE))
        .groupBy(label.alias("label"))
        .agg(F.count("*").alias("rows"))
    )


def apply_label_events(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Latest suggestion and latest confirmation per row, kept in separate columns.

    A later suggestion therefore cannot change a confirmation. Events collapse to one
    row per transaction before they meet the ledger.
    """
    stamp = F.struct("happened_at", "event_id")
    said = F.struct("label", "source", "confidence")
    suggestion = F.col("kind") == "suggest"
    latest = events.groupBy("id").agg(
        F.max_by(F.when(suggestion, said), F.when(suggestion, stamp)).alias("s"),
        F.max_by(F.when(~suggestion, F.col("label")), F.when(~suggestion, stamp)).alias("c"),
    )
    kept = ledger.drop(
        "suggested_label", "suggested_source", "suggested_confidence", "confirmed_label"
    )
    return kept.join(latest, "id", "left").select(
        *kept.columns,
        F.col("s.label").alias("suggested_label"),
        F.col("s.source").alias("suggested_source"),
        F.col("s.confidence").alias("suggested_confidence"),
        F.col("c").alias("confirmed_label"),
    )
