"""Bank export files as records with the physical line each starts on.

Files are read by blocks, never whole: lines are numbered from per-block counts, and
whether a line starts inside a quoted field follows from the lines above it, which
combine like any running total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.operators.ranking import row_numbers

CHUNK_LINES = 1 << 16
# A whole line that ends outside quotes, begun outside or inside them.
_QUOTED_REST = r'[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
_FIELD = rf'(?:"{_QUOTED_REST}|[^",][^,]*+|)'
# A cell with the comma before it, and a quoted cell in its two parts.
_CELL = rf'(?s),({_FIELD[:-2]}|"[^"]*+(?:""[^"]*+)*+\z|))'
_QUOTED_CELL = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'
ENDS_OUTSIDE = rf"(?s)^{_FIELD}(?:,{_FIELD})*+$"
CLOSES_AND_ENDS_OUTSIDE = rf"(?s)^{_QUOTED_REST}(?:,{_FIELD})*+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_no, text) of all files under a path, large files in parallel.

    The running id only orders lines within one block, where it follows the file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "^﻿", "").alias("text"),
    )
    numbered = row_numbers(raw, ["file_id"], F.col("block"), ["at"], "line_no")
    return numbered.select("file_id", "line_no", "text")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes: the identity of a delivery."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("file_id"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("source_sha256"),
    )


def number_records(lines: DataFrame, whole: bool = False) -> DataFrame:
    """Adds ``starts``, false where a quoted field from above is still open, and ``record_no``.

    A line either leaves the quoting as it found it, turns it over, or settles it. The
    state above a line is what the last settling line left, turned over once for every
    turning line since. A chunk of lines is read for both states it may begin in; which
    one holds, and how many records begin before it, comes from one row per chunk. Where no
    file is too large for a task, files are ``whole`` and never cut: see ``ranking.apart``.
    """
    from_outside = ~F.col("text").rlike(ENDS_OUTSIDE)
    from_inside = ~F.col("text").rlike(CLOSES_AND_ENDS_OUTSIDE)
    chunk = F.floor(F.col("line_no") / CHUNK_LINES).alias("chunk")
    part = F.col("file_id") if whole else F.struct("file_id", chunk)
    judged = lines.select(
        part.alias("_part"), "line_no", "text", from_outside.alias("_o"), from_inside.alias("_i"))
    upto = W.partitionBy("_part").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    above = W.partitionBy("_part").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    turn = (F.col("_o") & ~F.col("_i")).cast("bigint")
    turned = judged.withColumn("_turn", turn).withColumn("_turns", F.sum("_turn").over(upto))
    settled = F.when(F.col("_o") == F.col("_i"), F.struct("line_no", F.col("_o").alias("open"), F.col("_turns").alias("turns")))
    placed = turned.withColumn("_settled", settled).withColumn("_last", F.max("_settled").over(above))
    odd = (F.col("_turns") - F.col("_turn") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2 == 1
    from_out = F.coalesce(F.col("_last.open"), F.lit(False)) == odd
    if whole:
        return placed.withColumn("starts", from_out).select(
            F.col("_part").alias("file_id"), "line_no", "text", "starts",
            F.sum(F.col("starts").cast("bigint")).over(upto).alias("record_no"))
    both = placed.withColumn("_from_out", from_out).withColumn(
        "_from_in", F.when(F.col("_last").isNull(), ~F.col("_from_out")).otherwise(F.col("_from_out")))
    both = both.select(
        "_part", "line_no", "text", "_turn", "_settled", "_from_out", "_from_in",
        *[F.sum(F.col(s).cast("bigint")).over(upto).alias(f"{s}_no") for s in ("_from_out", "_from_in")])

    chunks = both.groupBy("_part").agg(
        F.sum("_turn").alias("turns"), F.max("_settled").alias("s"),
        F.max("_from_out_no").alias("from_out"), F.max("_from_in_no").alias("from_in"))
    order = W.partitionBy("_part.file_id").orderBy("_part.chunk")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("upto", F.sum("turns").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    leaves = F.when(F.col("s").isNotNull(), F.struct(
        F.col("_part.chunk").alias("chunk"),
        (F.col("s.open") != ((F.col("turns") - F.col("s.turns")) % 2 == 1)).alias("open"), F.col("upto").alias("turns")))
    chunks = chunks.withColumn("left", F.max(leaves).over(earlier))
    inside = F.coalesce(F.col("left.open"), F.lit(False)) != (
        (F.col("upto") - F.col("turns") - F.coalesce(F.col("left.turns"), F.lit(0))) % 2 == 1)
    chunks = chunks.withColumn("inside", inside)
    begun = F.sum(F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out"))).over(earlier)
    chunks = chunks.select("_part", "inside", F.coalesce(begun, F.lit(0)).alias("begun")).filter("inside or begun <> 0")

    l, r = both.alias("l"), chunks.alias("r")
    known = l.join(r, F.col("l._part") == F.col("r._part"), "left").select("l.*", "r.inside", "r.begun")
    held = F.coalesce("inside", F.lit(False))
    return known.select(
        F.col("_part.file_id").alias("file_id"), "line_no", "text",
        F.when(held, F.col("_from_in")).otherwise(F.col("_from_out")).alias("starts"),
        (F.coalesce("begun", F.lit(0)) + F.when(held, F.col("_from_in_no")).otherwise(F.col("_from_out_no")))
        .cast("bigint").alias("record_no"),
    )


def mark_record_starts(lines: DataFrame) -> DataFrame:
    """Adds ``starts``: false where a quoted field from above is still open."""
    return number_records(lines).drop("record_no")


def split_cells(record: Column) -> Column:
    """The cells of one record, of any length.

    A cell that begins with a quote runs to the quote that closes it, doubled ones being
    quotes, and on to the next comma; a quote elsewhere is a character; a quote never
    closed takes the rest of the record.
    """
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))

    def plain(cell: Column) -> Column:
        inside = F.replace(F.regexp_extract(cell, _QUOTED_CELL, 1), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), F.concat(inside, F.regexp_extract(cell, _QUOTED_CELL, 2))).otherwise(cell)

    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(raw, plain))


def records_from_lines(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(file_id, record_no, line, cells); blank lines count as lines and yield nothing."""
    numbered = number_records(lines, whole)
    # a group is one record: the lines its quoted fields span
    records = numbered.groupBy("file_id", "record_no").agg(
        F.min("line_no").alias("line"),
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("parts"),
    ).select(
        "file_id", "record_no", "line",
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
    )
    return records.filter("text <> '' or record_no = 1").select(
        "file_id", "record_no", "line", split_cells(F.col("text")).alias("cells")
    )


def split_header(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, rows): the first record of a file names its columns."""
    headers = records.filter("record_no = 1").select("file_id", F.col("cells").alias("header"))
    return headers, records.filter("record_no > 1").select("file_id", "line", "cells")


def files_without_header(headers: DataFrame) -> DataFrame:
    return headers.filter(F.size("header") == 0).select("file_id")


def named_columns(headers: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns by header name; a file without one of them gives null."""
    joined = rows.join(headers, "file_id")

    def cell(name):
        at = F.array_position("header", name).cast("int")
        return F.when(at > 0, F.get("cells", at - 1)).alias(name)

    return joined.select("file_id", "line", F.size("cells").alias("cells"), F.size("header").alias("columns"),
                         *[cell(c) for c in columns])
