"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label by a signature of concatenated random hashes, one
bit for the side of a random plane. The order is cut into windows of neighbours of about
256 vectors, and all pairs of a window are compared by their cosine in double precision.
Where more vectors than that share their leading bits, the window is cut into tiles and
every pair of tiles compared, so nothing is left out. A pair that shares a window in an
earlier pass is not counted again; links of all passes are joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.components import components
from tallystone.llm.store import written

COSINE = 0.98
WINDOW = 256
BITS = 32
MISS = 1e-4  # share of links at the threshold that the passes may miss
SEED = 5


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> tuple[int, int]:
    """Number of passes for ``n`` vectors of a label, and leading bits that cut their order.

    Two vectors at the threshold fall on one side of a plane with chance 1 - angle / pi,
    and share a window if they do for as many planes as it takes to cut ``n`` vectors
    into windows, and two more for window borders.
    """
    planes = max(0.0, math.log2(max(1, n) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** (planes + 2)
    return max(3, math.ceil(math.log(miss) / math.log(1 - meet))), min(BITS, math.ceil(planes) + 3)


def usable(embedding: str) -> F.Column:
    column = F.col(embedding)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def signatures(reps: DataFrame, passes: int) -> DataFrame:
    """id, label, dim and one signature per pass, as numbers in the order of the hashes."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column("embedding"), batch.column("dim").to_numpy()
            out = np.zeros((len(dims), passes), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy().reshape(len(rows), dim)
                planes = np.random.default_rng([SEED, int(dim)]).standard_normal((int(dim), passes * BITS))
                sides = (values @ planes > 0).reshape(len(rows), passes, BITS)
                out[rows] = (sides * weights).sum(2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * passes, pa.int32()), pa.array(out.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("dim"), lists], names=["id", "label", "dim", "signs"])

    kind = dict(reps.dtypes)["label"]
    return reps.select("id", "label", "dim", "embedding").mapInArrow(
        sign, f"id bigint, label {kind}, dim int, signs array<bigint>")


def windows(reps: DataFrame, passes: int, bits: int, window: int = WINDOW) -> DataFrame:
    """id and, for every pass, the window it lies in and the tiles that window is cut into.

    Vectors are counted by label, pass and leading bits. Windows follow from the running
    count along the order; leading bits that hold more than a window are one of their own.
    """
    order = ["label", "dim", "pass"]
    cells = signatures(reps, passes).select("id", "label", "dim", F.posexplode("signs").alias("pass", "sign")).withColumn(
        "cell", F.shiftright("sign", BITS - bits)).drop("sign")
    cells = written(cells, "signs")
    counts = cells.groupBy(*order, "cell").agg(F.count("*").alias("n")).withColumn(
        "stretch", F.shiftright("cell", 10))
    stretches = counts.groupBy(*order, "stretch").agg(F.sum("n").alias("n")).select(
        *order, "stretch", F.coalesce(F.sum("n").over(W.partitionBy(*order).orderBy("stretch").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n").over(W.partitionBy(*order, "stretch").orderBy("cell").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("within", within).join(stretches, [*order, "stretch"])
    before = F.col("earlier") + F.col("within")
    number = F.when(F.col("n") > window, -1 - F.col("cell")).otherwise(F.floor(before / window)).cast("bigint")
    cut = cut.select(*order, "cell", number.alias("window"), F.when(F.col("n") > window, F.ceil(
        F.col("n") / window)).otherwise(1).cast("int").alias("tiles"))
    return cells.join(cut, [*order, "cell"]).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pass", "window", "tiles"))).alias("places"))


def _compare(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of a unit: per vector their number, weighted by copies, and its least member."""
    rows = rows.sort_values("id", ignore_index=True)
    ids, tile, weight = (rows[c].to_numpy() for c in ("id", "tile", "weight"))
    vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    current = int(rows["pass"].iloc[0])
    places = np.stack(rows["windows"].to_numpy())[:, :current]
    near = vectors @ vectors.T >= cosine
    np.fill_diagonal(near, False)
    if rows["first"].iloc[0] != rows["second"].iloc[0]:
        near &= tile[:, None] != tile[None, :]
    for earlier in range(current):
        near &= places[:, earlier][:, None] != places[:, earlier][None, :]
    counted = near @ weight
    label = np.arange(len(ids))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(ids)).min(1, initial=len(ids)))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    some = counted > 0
    return pd.DataFrame({"id": ids[some], "links": counted[some], "least": ids[label[some]]})


def _units(reps: DataFrame, places: DataFrame) -> DataFrame:
    held = reps.join(places, "id").withColumn("windows", F.transform("places", lambda p: p["window"]))
    placed = held.select("id", "label", "dim", "embedding", "weight", "windows", F.explode("places").alias("p")).select(
        "id", "label", "dim", "embedding", "weight", "windows", "p.*")
    tiled = placed.withColumn("tile", F.pmod(F.xxhash64("id", "pass"), "tiles").cast("int")).withColumn(
        "partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return tiled.withColumn("first", F.least("tile", "partner")).withColumn("second", F.greatest("tile", "partner"))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings``.

    Vectors of one label and one length are linked where their cosine reaches ``cosine``.
    A null label or vector, a zero vector, and null or infinite components link with
    nothing; such a row is a component of its own. Equal vectors of a label are one node
    that counts as often as it comes, so rows that repeat a vec_id count as links of each
    other. A row without vec_id is no link of others; it has the links of equal vectors,
    and is kept where none has an id. No rows give no rows, other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    good = usable("embedding") & F.col("label").isNotNull()
    marked = rows.withColumn("node_label", F.when(good, F.col("label"))).withColumn(
        "node_vector", F.when(good, F.col("embedding")))
    reps = written(marked.filter("node_label is not null and vec_id is not null").groupBy("node_label", "node_vector").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight")).select(
        "id", F.col("node_label").alias("label"), F.size("node_vector").alias("dim"), F.col("node_vector").alias("embedding"), "weight"), "vectors")
    largest = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    passes, bits = passes_for(largest, cosine, window)
    units = _units(reps, windows(reps, passes, bits, window))
    links = written(units.groupBy("label", "dim", "pass", "window", "first", "second").applyInPandas(
        lambda unit: _compare(unit, cosine), "id bigint, links bigint, least bigint"), "cosines")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("id").alias("a"), F.col("least").alias("b")))
    nodes = reps.select("id", "label", "embedding", "weight").join(counted, "id", "left").join(
        found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("label").alias("node_label"), F.col("embedding").alias("node_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("weight")).alias("n_near"), F.coalesce("component", "id").alias("component"))
    named = marked.join(nodes, ["node_label", "node_vector"], "left")
    component = F.coalesce("component", "vec_id")
    itself = F.when(F.col("vec_id").isNotNull(), 1).otherwise(0)
    return named.select("vec_id", F.coalesce(F.col("n_near") - itself, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
