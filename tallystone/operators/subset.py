"""Choosing and masking the rows of an evaluation subset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions.text import counterparty, masked
from tallystone.operators.ranking import row_numbers, running_total

BANDS = 4  # fixed value


def numbered_aliases(lines: DataFrame) -> DataFrame:
    """PERSON_001.. per distinct counterparty, in the order of the name's SHA-256.

    Names are spread by the first digits of the hash, which are even by nature.
    """
    names = (
        lines.select(counterparty(F.col("description")).alias("person")).filter("person is not null")
        .distinct().withColumn("digest", F.sha2("person", 256)).withColumn("everyone", F.lit(0))
    )
    ranked = row_numbers(names, ["everyone"], F.substring("digest", 1, 3), ["digest"], "number")
    digits = F.col("number").cast("string")
    padded = F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0"))
    return ranked.select("person", F.concat(F.lit("PERSON_"), padded).alias("alias"))


def mask_counterparties(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Descriptions with the other person's name replaced by the alias."""
    named = lines.withColumn("person", counterparty(F.col("description")))
    return named.join(aliases, "person", "left").withColumn(
        "masked", masked(F.col("description"), F.col("alias"))
    ).drop("person", "alias")


def cap_merchants(rows: DataFrame, cap: int) -> DataFrame:
    """First rows of every repeated merchant; the limit runs before the shuffle."""
    order = W.partitionBy("merchant").orderBy("account_id", "fingerprint", "occurrence")
    repeated = rows.groupBy("merchant").agg(F.count("*").alias("n")).filter("n > 1").select("merchant")
    kept = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= cap)
    return kept.join(repeated, "merchant", "left_semi")


def singletons(rows: DataFrame) -> DataFrame:
    """Rows of merchants that appear once; a hot merchant collapses before the shuffle."""
    fields = [c for c in rows.columns if c != "merchant"]
    once = rows.groupBy("merchant").agg(
        F.count("*").alias("n"), F.min(F.struct(*fields)).alias("only")
    ).filter("n = 1")
    return once.select("merchant", "only.*")


def amount_bands(pool: DataFrame) -> DataFrame:
    """Band floor(position * 4 / n) over the order of absolute amount, then merchant.

    Positions come in two steps, rows below each amount and rank within it, so neither
    many amounts nor one popular amount ends up in a single task.
    """
    rows = pool.withColumn("size", F.abs("amount")).withColumn("everyone", F.lit(0))
    sizes = rows.groupBy("everyone", "size").agg(F.count("*").alias("n"))
    below = running_total(
        sizes, ["everyone"], F.floor(F.col("size") / 100), ["size"], F.col("n"), "upto"
    ).select("size", (F.col("upto") - F.col("n")).alias("below"))
    ranked = row_numbers(rows, ["size"], F.substring("merchant", 1, 4), ["merchant"], "within")
    total = pool.agg(F.count("*").alias("pool")).withColumn("everyone", F.lit(0))
    position = F.col("below") + F.col("within") - 1
    return ranked.join(below, "size").join(total, "everyone").withColumn(
        "band", F.least(F.floor(position * BANDS / F.col("pool")), F.lit(BANDS - 1)).cast("int")
    ).drop("size", "everyone", "below", "within", "pool")


def draw_singletons(pool: DataFrame, repeated: DataFrame, target: int, seed: str) -> DataFrame:
    """Fill up to ``target`` evenly over the bands; the last band takes the remainder.

    The draw orders each band by a seeded hash of the id, so it is the same on any
    cluster.
    """
    banded = amount_bands(pool).withColumn("draw", F.sha2(F.concat(F.lit(seed), "evaluation_id"), 256))
    sizes = banded.groupBy("band").agg(F.count("*").alias("pool"))
    taken = repeated.agg(F.count("*").alias("taken")).withColumn("everyone", F.lit(0))
    wanted = F.greatest(F.lit(target) - F.col("taken"), F.lit(0))
    share = F.floor(wanted / BANDS)
    quotas = sizes.withColumn("everyone", F.lit(0)).join(taken, "everyone").withColumn(
        "early", F.sum(F.when(F.col("band") < BANDS - 1, F.least("pool", share)).otherwise(0)).over(
            W.partitionBy("everyone"))
    ).select("band", F.when(F.col("band") < BANDS - 1, share).otherwise(wanted - F.col("early")).alias("quota"))
    numbered = row_numbers(
        banded, ["band"], F.substring("draw", 1, 3), ["draw", "evaluation_id"], "drawn"
    )
    return numbered.join(quotas, "band").filter(F.col("drawn") <= F.col("quota")).drop("draw", "drawn", "quota")


def choose_subset(rows: DataFrame, cap: int, target: int, seed: str) -> DataFrame:
    repeated = cap_merchants(rows, cap).drop("position")
    picked = draw_singletons(singletons(rows), repeated, target, seed)
    kind = [repeated.withColumn("kind", F.lit("repeated")).withColumn("band", F.lit(None).cast("int")),
            picked.withColumn("kind", F.lit("singleton"))]
    return kind[0].unionByName(kind[1])
