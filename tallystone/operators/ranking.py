"""Running totals that never put one hot key into one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


CROWDED = 1 << 16  # rows of a bucket of keys below which its keys are not cut into chunks
BUCKETS = 1 << 16


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def _crowded(keys: list[str], frames: list[DataFrame]) -> DataFrame:
    """The buckets of keys that hold many rows of all frames together."""
    every = reduce(DataFrame.unionAll, [f.select(_bucket(keys).alias("_bucket")) for f in frames])
    return every.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWDED).select("_bucket")


def apart(
    work: Callable[..., DataFrame], keys: list[str], *tables: DataFrame, counted: list[DataFrame] | None = None
) -> DataFrame:
    """``work(*tables, whole=...)``, which relates rows of equal ``keys`` only, with few moves of rows.

    Keys of buckets with few rows are dealt out by ``keys`` once; for them ``work`` is told
    that keys are ``whole``: no key is too large for a task, so that windows over ``keys``
    and more columns find their rows in place. For the keys of crowded buckets ``work`` must
    cut keys itself. ``counted`` has the same keys as ``tables``, where these are dear to read.
    """
    crowded = F.broadcast(_crowded(keys, counted or [*tables]))

    def side(how: str) -> list[DataFrame]:
        return [t.withColumn("_bucket", _bucket(keys)).join(crowded, "_bucket", how).drop("_bucket") for t in tables]

    few = work(*[t.repartition(*keys) for t in side("left_anti")], whole=True)
    return few.unionByName(work(*side("left_semi"), whole=False))


def _cut(rows: DataFrame, keys: list[str], chunk: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part``, a key's chunk or all of a key, and those rows whose key is cut.

    Keys are counted by the bucket of their hash, which moves one row per bucket and task;
    only keys of a bucket with many rows are cut into chunks. There are ``BUCKETS`` rows
    at most to broadcast.
    """
    bucket = _bucket(keys)
    crowded = _crowded(keys, [rows]).withColumn("_crowded", F.lit(True))
    cut = rows.withColumn("_bucket", bucket).join(F.broadcast(crowded), "_bucket", "left")
    part = F.struct(*keys, F.when(F.col("_crowded"), chunk).alias("_chunk"))
    marked = cut.withColumn("_part", part).drop("_bucket", "_crowded")
    inner = rows.withColumn("_bucket", bucket).join(F.broadcast(crowded), "_bucket").withColumn(
        "_part", F.struct(*keys, chunk.alias("_chunk"))).drop("_bucket", "_crowded")
    return marked, inner


def _with_offsets(rows: DataFrame, offsets: DataFrame, name: str) -> DataFrame:
    """Left join of per-part ``offsets``; null keys are one group here as in groupBy.

    A part is one column, so the rows stay where the window over their part put them, and
    is never null, whatever keys in it are.
    """
    left, right = rows.alias("l"), offsets.alias("r")
    return left.join(right, F.col("l._part") == F.col("r._part"), "left").select("l.*", f"r.{name}")


def running_total(
    rows: DataFrame, keys: list[str], chunk: Column, order: list, value: Column, name: str, whole: bool = False
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``.

    ``chunk`` must not decrease along ``order``. Each chunk of a key with many rows is
    summed on its own, and what earlier chunks hold comes from a table with one row per
    chunk, so a key with a third of all rows spreads over as many tasks as it has chunks.
    Keys that are ``whole`` are never cut.
    """
    if whole:
        plain = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumn(name, F.sum(value).over(plain).cast("bigint"))
    marked, inner = _cut(rows, keys, chunk)
    earlier = W.partitionBy(*[f"_part.{k}" for k in keys]).orderBy("_part._chunk").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = inner.withColumn("_value", value).groupBy("_part").agg(F.sum("_value").alias("_sum")).select(
        "_part", F.sum("_sum").over(earlier).alias("_before")
    ).filter("_before <> 0")
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = marked.withColumn("_within", F.sum(value).over(within))
    return _with_offsets(summed, offsets, "_before").select(
        *rows.columns,
        (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name),
    )


def row_numbers(
    rows: DataFrame, keys: list[str], chunk: Column, order: list, name: str, whole: bool = False
) -> DataFrame:
    return running_total(rows, keys, chunk, order, F.lit(1).cast("bigint"), name, whole)


def running_last(
    rows: DataFrame, keys: list[str], chunk: Column, order: str, value: Column, name: str,
    before: bool = False,
) -> DataFrame:
    """Last non-null ``value`` per key up to each row (or, with ``before``, above it).

    Same two steps as ``running_total``: within a chunk, and one row per earlier chunk.
    """
    seen = F.when(F.col("_value").isNotNull(), F.struct(order, "_value"))
    marked, inner = (
        side.withColumn("_value", value).withColumn("_seen", seen) for side in _cut(rows, keys, chunk))
    earlier = W.partitionBy(*[f"_part.{k}" for k in keys]).orderBy("_part._chunk").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = inner.groupBy("_part").agg(F.max("_seen").alias("_top")).select(
        "_part", F.max("_top").over(earlier).alias("_before")
    ).filter("_before is not null")
    end = -1 if before else W.currentRow
    within = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, end)
    told = marked.withColumn("_within", F.max("_seen").over(within))
    return _with_offsets(told, offsets, "_before").select(
        *rows.columns, F.coalesce("_within", "_before")["_value"].alias(name)
    )
