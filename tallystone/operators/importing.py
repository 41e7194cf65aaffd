"""From records to new and already stored charges, file by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallystone.functions import dates
from tallystone.functions.identity import cents, fingerprint
from tallystone.functions.text import blank, normalise_description, strip_cell, stripped_amount
from tallystone.operators.ranking import row_numbers, running_total

LINES_NAMED = 10  # fixed value: offending lines a refusal names
CHUNK_LINES = 1 << 16


def with_signed_amount(rows: DataFrame) -> DataFrame:
    """Either shape as one signed ``value``, money out negative, or why there is none.

    Reads t_amount, t_debit, t_credit and the flags uses_amount and outflow_positive.
    """
    stripped = rows.withColumns({f"t_{f}": strip_cell(F.col(f"t_{f}")) for f in ("amount", "debit", "credit")})
    return _signed_amount(stripped)


def _signed_amount(rows: DataFrame) -> DataFrame:
    """The same for cells already stripped."""
    def filled(name):
        return F.coalesce(F.col(name), F.lit("")) != ""

    parsed = rows.withColumns({
        "_signed": stripped_amount(F.col("t_amount")), "_out": stripped_amount(F.col("t_debit")),
        "_in": stripped_amount(F.col("t_credit")), "_has_amount": filled("t_amount"),
        "_has_out": filled("t_debit"), "_has_in": filled("t_credit"),
    })
    out, one = F.col("_out"), F.col("uses_amount")
    split = F.when(F.col("_has_out") & F.col("_has_in"), F.lit(None)).when(
        F.col("_has_out"), F.when(out < 0, out).otherwise(-out)
    ).when(F.col("_has_in"), F.col("_in"))
    signed = F.when(F.col("outflow_positive"), -F.col("_signed")).otherwise(F.col("_signed"))
    why = (
        F.when(one & ~F.col("_has_amount"), "cannot parse an empty amount")
        .when(~one & F.col("_has_out") & F.col("_has_in"), "both debit and credit are filled in")
        .when(~one & ~F.col("_has_out") & ~F.col("_has_in"), "neither debit nor credit is filled in")
        .when(F.col("value").isNull(), "not a valid amount")
    )
    return (
        parsed.withColumn("value", F.when(one, signed).otherwise(split))
        .withColumn("amount_error", why)
        .drop("_signed", "_out", "_in", "_has_amount", "_has_out", "_has_in")
    )


def ragged_error(cells: Column, header: Column) -> Column:
    have, want = F.size(cells), F.size(header)
    gone = F.array_join(F.sort_array(F.slice(header, have + 1, F.greatest(want - have, F.lit(0)))), ", ")
    return F.when(
        have > want, F.concat((have - want).cast("string"), F.lit(" extra cell(s) beyond the header"))
    ).when(have < want, F.concat(F.lit("missing cell(s) for: "), gone))


def examine(records: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every record of a mapped file as blank, failed with its first reason, or parsed."""
    fields = ["date", "description", "merchant", "external_id", "amount", "debit", "credit"]
    # where each field stands is found once a file
    plan = mapping.filter("mapped").join(headers, "file_id").select(
        "file_id", "header", "date_order", "amount_sign", F.col("amount").isNotNull().alias("uses_amount"),
        *[F.nullif(F.array_position("header", F.col(f)), F.lit(0)).cast("int").alias(f"at_{f}") for f in fields])
    joined = records.join(plan, "file_id")

    raw = joined.select(
        "file_id", "line", "cells", "date_order", "uses_amount",
        (F.col("uses_amount") & (F.col("amount_sign") == "outflow-negative")).alias("face_value"),
        (F.col("amount_sign") == "outflow-positive").alias("outflow_positive"),
        ragged_error(F.col("cells"), F.col("header")).alias("ragged"),
        F.transform(F.array(*[F.get("cells", F.col(f"at_{f}") - 1) for f in fields]), strip_cell).alias("stripped"),
    )
    raw = raw.select("*", *[F.get("stripped", F.lit(i)).alias(f"t_{f}") for i, f in enumerate(fields)]).drop("stripped")
    raw = raw.withColumn("day", dates.without_time(F.col("t_date")))
    filled = F.coalesce(*[F.nullif(F.col(f"t_{f}"), F.lit("")) for f in fields])
    text = F.coalesce(F.nullif(F.col("t_description"), F.lit("")), F.nullif(F.col("t_merchant"), F.lit("")))
    staged = _signed_amount(raw.select(
        "*", filled.isNull().alias("blank"), text.alias("said"),
        dates.parse_date(F.col("day"), F.col("date_order")).alias("posted_on"),
    ))
    why = F.coalesce(
        "ragged",
        dates.date_error(F.col("day"), F.col("date_order"), F.col("posted_on")),
        F.when(F.col("said").isNull(), "description is blank"),
        "amount_error",
    )
    state = F.when(F.col("blank"), "blank").when(F.col("why").isNotNull(), "error").otherwise("parsed")
    # The generator keeps a later filter on the state from being pushed down, which would
    # repeat all the parsing above inside the filter.
    judged = staged.withColumn("why", why).select(
        "file_id", "line", "cells", "face_value",
        F.inline(F.array(F.struct(
            state.alias("state"), F.when(~F.col("blank"), F.col("why")).alias("why"),
            F.col("posted_on"), F.col("said"), F.col("value"), F.col("t_external_id").alias("given_id"),
        ))),
    )
    good = F.col("state") == "parsed"
    return judged.select(
        "file_id", "line", "cells", "state", F.col("why").alias("error"), "face_value",
        F.when(good, F.col("posted_on")).alias("posted_on"),
        F.when(good, F.col("said")).alias("description"),
        F.when(good, normalise_description(F.col("said"))).alias("merchant"),
        F.when(good, F.col("value")).alias("amount"),
        F.when(good, F.nullif(F.col("given_id"), F.lit(""))).alias("external_id"),
    )


def preview_summary(examined: DataFrame) -> DataFrame:
    """Per file: rows, parsed, failed, blank, positives, and whether the sign looks wrong."""
    positive = F.count_if((F.col("state") == "parsed") & (F.col("amount") > 0))
    parsed = F.count_if(F.col("state") == "parsed")
    return examined.groupBy("file_id").agg(
        F.count("*").alias("source_rows"),
        F.count_if(F.col("state") == "blank").alias("blank_rows"),
        parsed.alias("parsed"),
        F.count_if(F.col("state") == "error").alias("errors"),
        positive.alias("positives"),
        (F.bool_or("face_value") & (positive * 2 > parsed)).alias("sign_warning"),
    )


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Charges that look identical within a file: how many and where the first stands."""
    return (
        rows.groupBy("file_id", "posted_on", "merchant", cents(F.col("amount")).alias("amount"))
        .agg(F.count("*").alias("rows"), F.min("line").alias("first_line"))
        .filter("rows > 1")
    )


def duplicate_lines(rows: DataFrame) -> DataFrame:
    """The rows of those groups, one per line, nothing collected."""
    groups = duplicate_groups(rows)
    return rows.withColumn("amount", cents(F.col("amount"))).join(
        groups.drop("rows"), ["file_id", "posted_on", "merchant", "amount"]
    ).select("file_id", "first_line", "line", "posted_on", "merchant", "amount")


def number_occurrences(rows: DataFrame, tie: str = "line", whole: bool = False) -> DataFrame:
    """Occurrence number of each charge among identical ones of its file, in source order.

    Here and below, ``whole`` says that no account is too large for a task: see ``apart``.
    """
    keyed = rows.withColumn("amount", cents(F.col("amount")))
    return row_numbers(
        keyed, ["account_id", "file_id", "posted_on", "merchant", "amount"],
        F.floor(F.col("line") / CHUNK_LINES), ["line", tie], "occurrence", whole,
    )


def with_fingerprint(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "fingerprint",
        fingerprint(F.col("account_id"), F.col("posted_on"), F.col("merchant"), F.col("amount"),
                    F.col("currency")),
    )


def lines_outside(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Every row outside the closed window that its file declares, with the window."""
    return rows.join(windows, "file_id").filter(
        ~F.col("posted_on").between(F.col("window_start"), F.col("window_end"))
    )


def outside_window(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Files with rows outside their declared closed window, how many, and the first lines named."""
    out = lines_outside(rows, windows)
    counts = out.groupBy("file_id").agg(F.count("*").alias("outside"))
    order = W.partitionBy("file_id").orderBy("line")
    named = (
        out.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= LINES_NAMED)
        .groupBy("file_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")),
                                      lambda n: n.cast("string")), ", ").alias("first_lines"))
    )
    return counts.join(named, "file_id")


def incremental_refusals(rows: DataFrame, has_id_column: Column) -> DataFrame:
    """Why an incremental file is refused: no id column, blank ids, repeated ids."""
    per_id = rows.groupBy("file_id", "external_id").agg(
        F.count("*").alias("n"), F.bool_or(has_id_column).alias("has_column")
    )
    absent = blank(F.col("external_id"))
    return per_id.groupBy("file_id").agg(
        F.bool_and("has_column").alias("has_id_column"),
        F.sum(F.when(absent, F.col("n")).otherwise(0)).alias("blank_ids"),
        F.count_if(~absent & (F.col("n") > 1)).alias("repeated_ids"),
    )


def mode_conflicts(deliveries: DataFrame, batches: DataFrame) -> DataFrame:
    """Deliveries whose account already holds imports in the other mode."""
    modes = batches.groupBy("account_id").agg(
        F.bool_or(F.col("mode") == "snapshot").alias("has_snapshot"),
        F.bool_or(F.col("mode") == "incremental").alias("has_incremental"),
    )
    clash = F.when(F.col("mode") == "snapshot", F.col("has_incremental")).otherwise(F.col("has_snapshot"))
    return deliveries.join(modes, "account_id").filter(clash).drop("has_snapshot", "has_incremental")


def new_deliveries(deliveries: DataFrame, batches: DataFrame) -> DataFrame:
    """Files whose bytes the account has not delivered before, first copy in a run only."""
    key = ["account_id", "source_sha256"]
    order = W.partitionBy(*key).orderBy("batch_id")
    first = deliveries.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return first.join(batches.select(*key).distinct(), key, "left_anti")


def _beside_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Both in one frame, where ``_stored`` tells them apart."""
    return rows.withColumn("_stored", F.lit(False)).unionByName(
        stored.withColumn("_stored", F.lit(True)), allowMissingColumns=True)


def _already_stored(both: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``already_stored``: a stored row or an earlier file has the row's key."""
    first = W.partitionBy(*key).orderBy(F.desc("_stored"), "file_order")
    return both.withColumn("already_stored", F.row_number().over(first) > 1)


def resolve_snapshot(rows: DataFrame, stored: DataFrame, whole: bool = False) -> DataFrame:
    """Each numbered charge as new or already stored, by fingerprint and occurrence.

    Files of one run are resolved in delivery order: the first file that carries an
    identity brings it, later ones find it stored.
    """
    key = ["account_id", "fingerprint", "occurrence"]
    if whole:
        both = _beside_stored(rows, stored.select(*key).dropna())
        return _already_stored(both, key).filter(~F.col("_stored")).select(*rows.columns, "already_stored")
    first = W.partitionBy(*key).orderBy("file_order")
    known = stored.select(*key).distinct().withColumn("_stored", F.lit(True))
    return rows.withColumn("_n", F.row_number().over(first)).join(known, key, "left").withColumn(
        "already_stored", F.coalesce("_stored", F.lit(False)) | (F.col("_n") > 1)
    ).drop("_n", "_stored")


def resolve_incremental(rows: DataFrame, stored: DataFrame, whole: bool = False) -> DataFrame:
    """Each charge as new or already stored by the bank's id, with its stored occurrence.

    New rows are shifted past the highest occurrence stored for their fingerprint, and
    past what earlier files of the same run add to it. Rows without an id are compared
    by fingerprint and occurrence and never shifted.
    """
    def identity(has_id):
        by_id = F.struct("external_id", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("bigint").alias("occurrence"))
        by_mark = F.struct(F.lit(None).cast("string").alias("external_id"), "fingerprint", F.col("occurrence").cast("bigint").alias("occurrence"))
        return by_id if has_id else by_mark

    # both kinds in one pass: the identity of a row without an id is its mark and number
    has_id = F.col("external_id").isNotNull()
    key = ["account_id", "_identity"]
    if whole:
        return _resolve_in_place(rows, stored, identity)
    first = W.partitionBy(*key).orderBy("file_order")
    known = stored.filter(has_id).select("account_id", identity(True).alias("_identity")).unionByName(
        stored.filter("fingerprint is not null and occurrence is not null").select(
            "account_id", identity(False).alias("_identity"))
    ).distinct().withColumn("_stored", F.lit(True))
    flagged = rows.withColumn("_identity", F.when(has_id, identity(True)).otherwise(identity(False)))
    flagged = flagged.withColumn("_n", F.row_number().over(first)).join(known, key, "left").withColumn(
        "already_stored", F.coalesce("_stored", F.lit(False)) | (F.col("_n") > 1)
    ).select(*rows.columns, "already_stored")

    mark, file = ["account_id", "fingerprint"], F.struct("file_order").alias("_file")
    highest = stored.groupBy(*mark).agg(F.max("occurrence").alias("highest"))
    # one row per fingerprint and file: what is stored and what the earlier files of this run added
    added = flagged.filter(~F.col("already_stored") & has_id).groupBy(*mark, file).agg(F.max("occurrence").alias("top"))
    before = W.partitionBy(*mark).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    shifts = added.withColumn("_run", F.coalesce(F.sum("top").over(before), F.lit(0))).join(highest, mark, "left").select(
        *mark, "_file", (F.coalesce("highest", F.lit(0)) + F.col("_run")).alias("_shift"))
    return flagged.withColumn("_file", file).join(shifts, [*mark, "_file"], "left").withColumn(
        "stored_occurrence",
        F.when(~F.col("already_stored"),
               F.col("occurrence") + F.when(has_id, F.coalesce("_shift", F.lit(0))).otherwise(F.lit(0))),
    ).select(*rows.columns, "already_stored", "stored_occurrence")


def _resolve_in_place(rows: DataFrame, stored: DataFrame, identity: Callable[[bool], Column]) -> DataFrame:
    """``resolve_incremental`` by windows alone, which leave accounts where they are."""
    mark, has_id = ["account_id", "fingerprint"], F.col("external_id").isNotNull()
    numbered = F.col("fingerprint").isNotNull() & F.col("occurrence").isNotNull()
    # a stored row stands for its id and for its mark and number
    known = stored.filter("account_id is not null").select(
        *mark, "occurrence",
        F.explode(F.array(F.when(has_id, identity(True)), F.when(numbered, identity(False)))).alias("_identity"),
    ).filter("_identity is not null")
    both = _beside_stored(rows.withColumn("_identity", F.when(has_id, identity(True)).otherwise(identity(False))), known)
    flagged = _already_stored(both, ["account_id", "_identity"])
    added = ~F.col("_stored") & ~F.col("already_stored") & has_id
    # the last row of a file that added some has the highest number it added
    order = W.partitionBy(*mark).orderBy(F.desc("_stored"), "file_order", "_added", "occurrence")
    ends = ~F.lead(F.struct("file_order")).over(order).eqNullSafe(F.struct("file_order"))
    top = F.when(F.col("_added") & ends, F.col("occurrence"))
    run = F.coalesce(F.sum("_top").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    highest = F.coalesce(F.max(F.when(F.col("_stored"), F.col("occurrence"))).over(W.partitionBy(*mark)), F.lit(0))
    shift = F.when(F.col("_added") & F.col("account_id").isNotNull() & F.col("fingerprint").isNotNull(), highest + run)
    return flagged.withColumn("_added", added).withColumn("_top", top).withColumn(
        "stored_occurrence",
        F.when(~F.col("already_stored"), F.col("occurrence") + F.coalesce(shift, F.lit(0))),
    ).filter(~F.col("_stored")).select(*rows.columns, "already_stored", "stored_occurrence")


def import_outcome(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("file_id").agg(
        F.count("*").alias("attempted"),
        F.count_if(~F.col("already_stored")).alias("imported"),
        F.count_if(F.col("already_stored")).alias("already_stored"),
    )


def enter_manually(entries: DataFrame, stored: DataFrame, whole: bool = False) -> DataFrame:
    """Hand-entered charges in order: stored when first of their kind or declared a repeat."""
    mark = ["account_id", "fingerprint"]
    if whole:
        return _enter_in_place(entries, stored)
    highest = stored.groupBy(*mark).agg(F.max("occurrence").alias("highest"))
    # all columns are asked for, so that both uses of the entries read what was moved once
    firsts = entries.groupBy(*mark).agg(F.min(F.struct("seq", "repeat"))["seq"].alias("first_seq"))
    known = entries.join(highest, mark, "left").join(firsts, mark)
    stores = F.col("repeat") | (F.col("highest").isNull() & (F.col("seq") == F.col("first_seq")))
    flagged = known.withColumn("stored", stores)
    counted = running_total(
        flagged, mark, F.floor(F.col("seq") / CHUNK_LINES), ["seq"],
        F.col("stored").cast("bigint"), "so_far",
    )
    return counted.select(
        "seq", *mark, "stored",
        (F.coalesce("highest", F.lit(0)) + F.col("so_far")).cast("bigint").alias("occurrence"),
    )


def _enter_in_place(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """``enter_manually`` by windows alone, which leave accounts where they are."""
    mark = ["account_id", "fingerprint"]
    both = _beside_stored(entries.dropna(subset=mark), stored.select(*mark, "occurrence").dropna())
    every = W.partitionBy(*mark)
    upto = every.orderBy(F.desc("_stored"), "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = both.withColumn("highest", F.max("occurrence").over(every)).withColumn("first_seq", F.min("seq").over(every))
    stores = F.col("repeat") | (F.col("highest").isNull() & (F.col("seq") == F.col("first_seq")))
    counted = known.withColumn("stored", F.when(~F.col("_stored"), stores)).withColumn(
        "so_far", F.sum(F.col("stored").cast("bigint")).over(upto))
    return counted.filter(~F.col("_stored")).select(
        "seq", *mark, "stored",
        (F.coalesce("highest", F.lit(0)) + F.col("so_far")).cast("bigint").alias("occurrence"),
    )


def fingerprint_breaks(stored: DataFrame) -> DataFrame:
    """Stored rows whose fingerprint does not recompute from their own columns."""
    again = fingerprint(F.col("account_id"), F.col("posted_on"), F.col("merchant"), F.col("amount"),
                        F.col("currency"))
    return stored.filter(F.col("fingerprint") != again)
