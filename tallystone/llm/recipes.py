"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: behind the first sentence or line end at least
256 characters on, and after 4,096 at the latest. A chunk is known by a 64-bit identifier,
verified by SHA-256: where two different chunks share an identifier, their digests take
its place. Texts are equal when their ordered identifier lists are equal. To find them only
identifiers and digests are moved between tasks, never texts; rows that stay are moved once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.store import own_columns, unused, written

BOUNDARY = r"(?s).{256,4096}?(?:[.!?]\s|\n)|.{1,4096}"
SALTS = 16


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0))


def recipes(docs: DataFrame, bits: int = 64, row_no: str | None = None) -> DataFrame:
    """row_no, doc_id, text_sha256, and the identifiers and digests of the chunks of each text."""
    number = F.monotonically_increasing_id() if row_no is None else F.col(row_no)
    cut = docs.select("doc_id", normalised(F.col("text")).alias("text"), number.alias("row_no")).withColumn("chunks", chunks(F.col("text")))
    unused = 64 - bits  # fewer bits make identifiers clash, for tests
    return cut.select(
        "row_no", "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: F.shiftrightunsigned(F.xxhash64(c), unused)).alias("fps"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """Recipes with ``clashes``: place and digest of chunks whose identifier others share."""
    placed = rows.select("row_no", F.posexplode(F.arrays_zip("fps", "digests")).alias("place", "c"))
    known = placed.select("row_no", "place", F.col("c.fps").alias("fp"), F.col("c.digests").alias("digest"))
    shared = written(known.groupBy("fp").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter(
        "least <> most").select("fp"), "clashes")
    none = F.array().cast("array<struct<place:int,digest:binary>>")
    if shared.isEmpty():  # as good as always: no chunk needs to be moved again
        return rows.select("row_no", "doc_id", "text_sha256", "fps", none.alias("clashes"))
    told_apart = known.join(shared, "fp", "left_semi").groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("clashes"))
    return rows.join(told_apart, "row_no", "left").select(
        "row_no", "doc_id", "text_sha256", "fps", F.coalesce("clashes", none).alias("clashes"))


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Texts are equal when identical after lowering A to Z; null counts as empty. The row
    with the largest doc_id stays; of repeated rows with that doc_id one stays, and a row
    without doc_id stays only where no row of the group has one. Other columns are ignored.
    No rows give no rows.

    A group of copies is summed before it is moved, and its result is dealt back over
    ``SALTS`` parts, so that a group with a third of all rows takes no task of its own.
    """
    return _grouped(written(recipes(docs, bits), "recipes")).drop("row_no")


def _grouped(rows: DataFrame) -> DataFrame:
    """``exact_groups`` of written recipes, with row_no."""
    lists = verified(rows)
    groups = lists.groupBy("fps", "clashes").agg(
        F.max(F.struct("doc_id", "row_no")).alias("stays"), F.count("*").alias("group_size")).filter("group_size > 1")
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int"))
    found = salted.join(dealt, ["fps", "clashes", "salt"], "left")
    return found.select(
        "row_no", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("stays").isNull() | (F.col("stays.row_no") == F.col("row_no"))).alias("kept"), "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Defined as ``exact_groups``: a null text counts as empty, of repeated rows one stays, no
    rows give no rows. Rows are numbered as they are written to the shared folder; those
    that stay are found again by that number, which no two rows share.
    """
    row_no = unused(docs, "row_no")
    numbered = written(docs.withColumn(row_no, F.monotonically_increasing_id()), "numbered")
    stay = _grouped(written(recipes(numbered, row_no=row_no), "recipes")).filter("kept").select(F.col("row_no").alias(row_no))
    return numbered.join(stay, row_no, "left_semi").select(*own_columns(docs))
