"""Mixing sources to target weights, in DataFrame functions only.

Every source is cut into blocks of documents by hash. A source's target is so many whole
rounds over its blocks and a rest of permuted blocks, the last of them taken in part. All
blocks taken are dealt to output shards by a splitting tree: a node's quotas, one number
per source, are split between two halves by a multivariate hypergeometric draw, down to
one shard. Each shard then draws disjoint runs of the permuted blocks of a source, as many
as its quota says, and shuffles its documents locally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.store import own_columns, unused, written

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
BLOCK_WORDS = 4096
MOST_BLOCKS = 1 << 16  # blocks of all sources together; beyond it blocks grow, not their number
SHARD_WORDS = 1 << 20
EDGE = -1  # the round of blocks that belong to a target's rest
EDGE_BLOCKS = 8
SEED = 20240


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _draw(*parts) -> Column:
    """A reproducible number between 0 and 1."""
    return (F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: n_docs, source_size, weight and target.

    Sources in order of code points, null last, take the weights in turn. The size of all
    sources is shared by weight; no target exceeds ``limit`` times its source's size, and
    what is above is shared again by weight among the others. That ends where target =
    min(limit * size, level * weight) with one level for all.
    """
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    shared = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(
        F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = shared.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    at = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    return levels.withColumn("at", at["level"]).select(
        "source", "n_docs", "source_size", "weight",
        F.least("cap", F.coalesce(F.col("at") * F.col("weight"), "cap")).alias("target"))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are marked, by inversion of ``u`` from the mode on.

    Values lie within 12 deviations of the mean, beyond which no double has any weight.
    """
    t, m, d = (c.cast("double") for c in (total, marked, drawn))
    mean = d * m / F.greatest(t, F.lit(1.0))
    spread = F.ceil(F.lit(12.0) * F.sqrt(F.greatest(mean * (1 - m / F.greatest(t, F.lit(1.0))), F.lit(0.0))) + 12)
    low = F.greatest(F.lit(0), marked + drawn - total).cast("bigint")
    high = F.least(marked, drawn).cast("bigint")
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (m + 1) / (t + 2)).cast("bigint")))
    up = F.least(high - mode, spread).cast("bigint")
    down = F.least(mode - low, spread).cast("bigint")
    rising = F.when(up > 0, F.sequence(F.lit(1).cast("bigint"), up)).otherwise(F.array().cast("array<bigint>"))
    falling = F.when(down > 0, F.sequence(F.lit(-1).cast("bigint"), -down)).otherwise(F.array().cast("array<bigint>"))
    steps = F.concat(rising, falling)

    def walk(state: Column, k: Column) -> Column:
        """The weight of mode + k from that of its neighbour nearer to the mode."""
        x = mode.cast("double") + k.cast("double")
        below = x - F.when(k > 0, 1.0).otherwise(0.0)
        ratio = (m - below) * (d - below) / ((below + 1) * (t - m - d + below + 1))
        near = F.when(k == -1, 1.0).otherwise(state["weight"])
        weight = F.when(k > 0, near * ratio).otherwise(near / ratio)
        through = state["sum"] + weight
        value = F.coalesce(state["value"], F.when(through >= state["wanted"], mode + k))
        return F.struct(weight.alias("weight"), through.alias("sum"), state["wanted"].alias("wanted"), value.alias("value"))

    def fold(wanted: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), wanted.alias("wanted"),
                         F.when(wanted <= 1.0, mode).cast("bigint").alias("value"))
        return F.aggregate(steps, start, walk)

    return F.coalesce(fold(u * fold(F.lit(float("inf")))["sum"])["value"], mode)


def shard_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """shard, source_no, quota and the number of the source's blocks in earlier shards.

    ``quotas`` has source_no and blocks. A node takes its sources one after the other, each
    by a hypergeometric draw from what is left of the node: together a multivariate draw.
    """
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_no", "blocks"))).alias("held")).select(
        F.lit(0).cast("bigint").alias("node"), "held").filter(F.size("held") > 0)
    for level in range(levels):
        total = F.aggregate("held", F.lit(0).cast("bigint"), lambda s, x: s + x["blocks"])
        nodes = nodes.withColumn("total", total).withColumn("half", F.floor((F.col("total") + 1) / 2).cast("bigint"))
        start = F.struct(F.col("total").alias("total"), F.col("half").alias("drawn"),
                         F.array().cast("array<struct<source_no:int,blocks:bigint>>").alias("left"))

        def split(state: Column, x: Column) -> Column:
            u = _draw(F.lit(level), F.col("node"), x["source_no"])  # noqa: B023  used within this turn
            got = _hypergeometric(state["total"], x["blocks"], state["drawn"], u)
            return F.struct(
                (state["total"] - x["blocks"]).alias("total"), (state["drawn"] - got).alias("drawn"),
                F.concat(state["left"], F.array(F.struct(x["source_no"].alias("source_no"), got.alias("blocks")))).alias("left"))

        nodes = nodes.withColumn("left", F.aggregate("held", start, split)["left"])
        right = F.zip_with("held", "left", lambda h, l: F.struct(h["source_no"].alias("source_no"), (h["blocks"] - l["blocks"]).alias("blocks")))
        nodes = written(nodes.select("node", F.posexplode(F.array("left", right)).alias("side", "held")).select(
            (F.col("node") * 2 + F.col("side")).alias("node"), "held"), "quotas")
    flat = nodes.select(F.col("node").alias("shard"), F.explode("held").alias("h")).select(
        "shard", "h.source_no", F.col("h.blocks").alias("quota"))
    earlier = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("quota").over(earlier), F.lit(0)).cast("bigint")).filter("quota > 0")


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT,
             block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, ...]:
    """Targets, documents with their block, blocks drawn with their shard, and edge documents.

    ``sized`` has doc_id, source and size. A draw has ``most`` where it takes its block
    only in part: what the source still lacks after its last whole block. The edge
    documents fill that, out of the block and those behind it in the permutation. A document
    larger than a block that no longer fits is left out, and the blocks behind it still count.
    """
    targets = written(source_targets(sized, weights, limit).withColumn(
        "source_no", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")).cast("int")), "targets")
    words, rows = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    per_block = max(block_words, math.ceil((words + rows) / MOST_BLOCKS))
    levels = max(1, min(16, math.ceil(math.log2(max(2, words / shard_words)))))
    targets = targets.withColumn("n_blocks", F.ceil((F.col("source_size") + F.col("n_docs")) / per_block))
    whole = targets.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(
        F.round(F.col("target") / F.col("source_size"), 9))).otherwise(0).cast("bigint")).withColumn(
        "rest", F.greatest(F.col("target") - F.col("rounds") * F.col("source_size"), F.lit(0.0)))
    known = whole.select("source", "source_no", "n_blocks", "rounds", "rest")
    blocked = sized.alias("d").join(known.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "d.size", "t.source_no", "t.rounds", "t.rest",
        F.pmod(F.xxhash64("d.doc_id", F.lit(SEED)), "t.n_blocks").cast("bigint").alias("block"),
        (F.col("d.size") > per_block).alias("long"))
    # words / per_block bounds the number of long documents, as it does that of blocks
    long = F.when(F.col("long"), F.struct("size", F.xxhash64("doc_id", F.lit(SEED + 3)).alias("draw"), "doc_id", "source", "block"))
    sums = blocked.groupBy("source_no", "block").agg(
        F.sum("size").alias("words"), F.first("rounds").alias("rounds"), F.first("rest").alias("rest"),
        F.sum(F.when(F.col("long"), 0).otherwise(F.col("size"))).alias("short"), F.sort_array(F.collect_list(long), asc=False).alias("held"))
    permuted = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", F.lit(SEED + 1)), "block")
    through = F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = sums.withColumn("through", through).withColumn("rank", F.row_number().over(permuted))
    crossing = F.min(F.when(F.col("through") > F.col("rest"), F.struct("rank", (F.col("rest") - F.col("through") + F.col(
        "words")).alias("room")))).over(W.partitionBy("source_no"))
    partly = written(ranked.withColumn("crossing", crossing).select(
        "source_no", "block", "rounds", "rank", "short", "held", "crossing.room", F.col("crossing.rank").alias("edge")), "blocks")
    ends = written(_walked(partly.filter("rank >= edge")), "ends")
    passed = partly.join(ends, "source_no", "left")
    last = F.col("rank") == F.col("stop")
    rest = passed.filter((F.col("rank") < F.col("edge")) | (F.col("rank") < F.coalesce("stop", F.col("rank") + 1)) & F.col("edge").isNotNull() | last & (
        (F.col("left") > 0) | F.exists("took", lambda x: x["block"] == F.col("block")))).select(
        "source_no", "block", F.lit(EDGE).cast("bigint").alias("round"), F.when(last, F.col("left")).alias("most"),
        (F.col("rank") >= F.col("edge")).alias("behind"))
    rounds = partly.filter("rounds > 0").select(
        "source_no", "block", F.explode(F.sequence(F.lit(1).cast("bigint"), "rounds")).alias("round"), F.lit(None).cast("double").alias("most"),
        F.lit(False).alias("behind"))
    draws = written(rounds.union(rest), "draws")
    quotas = shard_quotas(draws.groupBy("source_no").agg(F.count("*").alias("blocks")), levels)
    numbered = draws.withColumn("n", F.row_number().over(W.partitionBy("source_no").orderBy(
        F.xxhash64("source_no", "block", "round", F.lit(SEED + 2)), "block", "round")) - 1)
    placed = numbered.join(quotas, "source_no").filter("n >= first and n < first + quota").select(
        "source_no", "block", "round", "most", "behind", "shard")
    edge = passed.filter(F.col("rank").between(F.col("stop"), F.col("stop") + EDGE_BLOCKS - 1)).select("source_no", "block", last.alias("last"))
    near = blocked.join(edge, ["source_no", "block"]).filter("not (last and long)")
    took = ends.select("source_no", F.explode("took").alias("x")).select("source_no", "x.block", "x.doc_id", "x.source", "x.size")
    long_taken = took.join(placed.filter(F.col("round") == EDGE), ["source_no", "block"]).select("doc_id", "source", "size", "round", "shard")
    return targets, blocked, placed, _filled(near, placed.filter("most is not null")).union(long_taken)


def _walked(behind: DataFrame) -> DataFrame:
    """Of each source: the long documents taken behind its first block that does not fit whole,
    the first block whose other documents don't all fit, and what is then left to fill.

    Blocks come in the order of the permutation; a long document is taken where it fits.
    """
    ordered = behind.groupBy("source_no").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("short").cast("double").alias("short"), "held"))).alias("blocks"), F.first("room").alias("room"))

    def take(state: Column, x: Column) -> Column:
        fits = x["size"] <= state["left"]
        return F.struct((state["left"] - F.when(fits, x["size"]).otherwise(0)).alias("left"), state["stop"].alias("stop"),
                        F.when(fits, F.concat(state["took"], F.array(x))).otherwise(state["took"]).alias("took"))

    def walk(state: Column, block: Column) -> Column:
        after = F.aggregate(block["held"], state, take)
        fits = block["short"] <= after["left"]
        return F.when(state["stop"].isNotNull(), state).otherwise(F.struct(
            (after["left"] - F.when(fits, block["short"]).otherwise(0.0)).alias("left"),
            F.when(~fits, block["rank"]).alias("stop"), after["took"].alias("took")))

    none = F.filter(F.col("blocks")[0]["held"], lambda x: F.lit(False))
    start = F.struct(F.col("room").alias("left"), F.lit(None).cast("int").alias("stop"), none.alias("took"))
    return ordered.select("source_no", F.aggregate("blocks", start, walk).alias("end")).select("source_no", "end.left", "end.stop", "end.took")


def mixed(sized: DataFrame, **parameters) -> DataFrame:
    """Every copy of a document that the mix takes: doc_id, source, size, shard and place.

    ``place`` orders a shard: sorting by it is the local shuffle.
    """
    return _copies(*plan_mix(sized, **parameters)[1:])


def _filled(near: DataFrame, partial: DataFrame) -> DataFrame:
    """Documents of the edge blocks that together come closest to what a source still lacks.

    They are tried from the largest on, each taken where it still fits. Edge blocks are
    bounded in size, so a source's array is.
    """
    ordered = near.groupBy("source_no").agg(F.sort_array(F.collect_list(
        F.struct("size", F.xxhash64("doc_id", F.lit(SEED + 3)).alias("draw"), "doc_id", "source")), asc=False).alias("held"))
    lacking = ordered.join(partial.select("source_no", "round", "shard", "most"), "source_no")
    none = F.filter("held", lambda x: F.lit(False))
    start = F.struct(F.col("most").alias("room"), none.alias("took"))

    def take(state: Column, x: Column) -> Column:
        fits = x["size"] <= state["room"]
        return F.struct((state["room"] - F.when(fits, x["size"]).otherwise(0)).alias("room"),
                        F.when(fits, F.concat(state["took"], F.array(x))).otherwise(state["took"]).alias("took"))

    taken = lacking.select("round", "shard", F.explode(F.aggregate("held", start, take)["took"]).alias("x"))
    return taken.select("x.doc_id", "x.source", "x.size", "round", "shard")


def _copies(blocked: DataFrame, placed: DataFrame, edge: DataFrame) -> DataFrame:
    whole = blocked.join(placed.filter("most is null").drop("most"), ["source_no", "block"]).filter("not (behind and long)")
    return whole.select("doc_id", "source", "size", "round", "shard").union(edge).withColumn(
        "place", F.xxhash64("doc_id", "round", "shard", F.lit(SEED + 4)))


def mix_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    A null text has size 0; null is a source of its own; repeated rows count as one
    document each, and share what their doc_id takes evenly; no rows give no rows.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets, *planned = plan_mix(sized, **parameters)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    taken = _copies(*planned).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    rows = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    counted = rows.alias("r").join(taken.alias("c"), F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & same("r", "c") & (
        F.col("r.size") == F.col("c.size")), "left").select("r.*", F.coalesce("c.copies", F.lit(0)).alias("copies"))
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn(
        "own", F.floor((F.col("copies") + F.col("k")) / F.col("n")))
    return each.alias("e").join(targets.alias("t"), same("e", "t")).select(
        "e.doc_id", "e.size", "t.source_size", "t.target", (F.col("e.own") * F.col("e.size")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: all columns of ``docs``, a row as often as it is taken.

    Rows lie shard by shard, each shard in the order of its local shuffle. Rows that repeat
    a doc_id, source and size share evenly what these are taken. Defined as ``mix_report``
    for nulls, empty texts and empty tables. Rows are numbered as they are written to the
    shared folder, so a lost executor changes no choice; texts are moved twice, to the rows
    that are taken and to their shards.
    """
    row_no, shard, place = (unused(docs, name) for name in ("row_no", "shard", "place"))
    numbered = written(docs.withColumn(row_no, F.monotonically_increasing_id()), "numbered")
    sized = written(numbered.select(F.col(row_no).alias("row_no"), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    key = ["doc_id", "source", "size"]
    repeated = W.partitionBy(*key)
    rows = sized.withColumn("nth", F.row_number().over(repeated.orderBy("row_no")) - 1).withColumn("n", F.count("*").over(repeated))
    copies = mixed(sized.drop("row_no"), **parameters).withColumn("turn", F.row_number().over(repeated.orderBy("place", "round")))

    same = F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("c.source").eqNullSafe(F.col("r.source")) & (F.col("c.size") == F.col("r.size"))
    picks = copies.alias("c").join(rows.alias("r"), same & (F.pmod("c.turn", "r.n") == F.col("r.nth"))).select(
        F.col("r.row_no").alias(row_no), F.col("c.shard").alias(shard), F.col("c.place").alias(place))
    placed = numbered.join(picks, row_no)
    return placed.repartition(shard).sortWithinPartitions(shard, place).select(*own_columns(docs))
