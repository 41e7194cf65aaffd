"""MinHash near-dedup with tensored banding.

Two collections of eight half keys each come from 32 minhashes; a table is formed by every
pair of a left and a right half key, 64 tables in all, where 64 tables of their own would
take 256 minhashes. Documents that meet in a table are tied to the table's hub; ties whose
signatures hardly agree go, and what stays together is a cluster. The full shingle sets of
a cluster meet in bounded units, where links are confirmed on the sets and reduced to a
spanning forest: no task emits the pairs of a group, and none holds an unbounded one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.components import components
from tallystone.llm.store import written
from tallystone.llm.words import constants, mixed, shingle_sets

SIMILARITY = 75  # per cent
HALVES, ROWS = 8, 2
HASHES = 2 * HALVES * ROWS
TIE = 12  # of HASHES that must agree; three times as unlikely as one in 10,000 to miss a link
FINE_HASHES, FINE_SHARE = 192, 0.62
UNIT_DOCS, UNIT_SHINGLES = 1024, 1_500_000
HUBS = 8


def _minima(sets: list[np.ndarray], seed: int, n: int) -> np.ndarray:
    """Row per set, column per hash function; rows of empty sets are all ones."""
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    factors, shifts = constants(seed, n) | np.uint64(1), constants(seed + 1, n)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 17):
            size += len(sets[end])
            end += 1
        rows = [k for k in range(at, end) if len(sets[k])]
        if rows:
            values = np.concatenate([sets[k] for k in rows])
            starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in rows])[:-1]])
            for h in range(n):
                hashed = ((values * factors[h] + shifts[h]) >> np.uint64(32)).astype(np.uint32)
                out[rows, h] = np.minimum.reduceat(hashed, starts)
        at = end
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null without words) and signature of every row."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            signatures = _minima(sets, 11, HASHES)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([row.tobytes() for row in signatures], pa.binary()),
            ], names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        profile, "doc_id bigint, n_shingles bigint, set_key binary, signature binary")


def tensored_keys(signatures: np.ndarray) -> np.ndarray:
    """The 64 table keys of each signature, from pairs of a left and a right half key."""
    bands = signatures.astype(np.uint64).reshape(len(signatures), 2 * HALVES, ROWS)
    halves = mixed((bands[:, :, 0] << np.uint64(32)) | bands[:, :, 1])
    for row in range(2, ROWS):
        halves = mixed(halves ^ bands[:, :, row])
    left, right = halves[:, :HALVES, None], halves[:, None, HALVES:]
    tables = constants(23, HALVES * HALVES).reshape(1, HALVES, HALVES)
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F) + tables).reshape(
        len(signatures), HALVES * HALVES)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def table_keys(reps: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = tensored_keys(_matrix(batch.column("signature"), "<u4", HASHES)).astype(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "keys"])

    return reps.select("id", "signature").mapInArrow(keys, "id bigint, keys array<bigint>").select(
        "id", F.explode("keys").alias("key"))


def ties(reps: DataFrame) -> DataFrame:
    """Links (a, b) of documents with the hub of a table in which they meet.

    A hub is the least id under one of eight orders, so a document of a large group has
    several hubs to be tied to.
    """
    keys = table_keys(reps)
    masks = F.array(*[F.lit(int(x) >> 1) for x in constants(41, HUBS)])
    mask = F.element_at(masks, (F.pmod("key", F.lit(HUBS)) + 1).cast("int"))
    hubs = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(mask)).alias("top")).filter(
        "n > 1").select("key", F.col("top").bitwiseXOR(mask).alias("hub"))
    met = keys.join(hubs, "key").filter("id <> hub").select("id", "hub").distinct()
    sketch = reps.select("id", "signature")
    both = met.join(sketch, "id").join(sketch.select(F.col("id").alias("hub"), F.col("signature").alias("other")), "hub")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = _matrix(batch.column("signature"), "<u4", HASHES) == _matrix(batch.column("other"), "<u4", HASHES)
            yield batch.select(["a", "b"]).filter(pa.array(same.sum(1) >= TIE))

    return both.select(F.col("id").alias("a"), F.col("hub").alias("b"), "signature", "other").mapInArrow(
        agree, "a bigint, b bigint")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on sorted distinct shingles."""
    if 100 * min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)


def forest(sets: list[np.ndarray], tiles: np.ndarray) -> np.ndarray:
    """Least member of each document's component; with two tiles, links across them only.

    Of two documents already connected no link is sought. In larger units documents are
    compared in order of how far 192 minhashes agree, and not at all where that makes a
    link at 0.75 less likely than one in 10,000.
    """
    n = len(sets)
    label = np.arange(n)
    crossing = len(set(tiles.tolist())) > 1
    fine = None if n <= 16 else (_minima(sets, 71, FINE_HASHES) & np.uint32(0xFF)).astype(np.uint8)
    for x in range(1, n):
        others = np.arange(x)
        if crossing:
            others = others[tiles[:x] != tiles[x]]
        if fine is not None:
            agree = (fine[others] == fine[x]).sum(1)
            order = np.argsort(-agree, kind="stable")
            others = others[order[: int((agree >= FINE_SHARE * FINE_HASHES).sum())]]
        while True:
            others = others[label[others] != label[x]]
            hit = next((k for k, y in enumerate(others) if linked(sets[x], sets[y])), None)
            if hit is None:
                break
            low, high = sorted((label[x], label[others[hit]]))
            label[label == high] = low
            others = others[hit + 1 :]
    return label


def _unit_links(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["component", "id"], ignore_index=True)
    found = []
    sets = shingle_sets(pa.array(rows["text"], pa.large_string()))
    own = np.array([set_key(s) == bytes(k) for s, k in zip(sets, rows["set_key"])]) & ~rows.duplicated(["id", "set_key"]).to_numpy()
    for _, group in rows[own].groupby("component", sort=False):
        label = forest([sets[k] for k in group.index], group["tile"].to_numpy())
        ids = group["id"].to_numpy()
        moved = label != np.arange(len(label))
        found.append(pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]}))
    return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def confirmed_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links within clusters, each confirmed on full sets.

    Small clusters share a unit. A large one is cut into tiles by hash, and every pair of
    tiles is a unit, so all its documents are compared and no unit is unbounded.
    """
    members = clusters.join(reps.select(F.col("id").alias("node"), "set_key", "n_shingles"), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    tiles = F.ceil(F.greatest(F.col("n") / UNIT_DOCS, F.col("shingles") / UNIT_SHINGLES)).cast("int")
    sizes = written(sizes.withColumn("tiles", tiles), "clusters")
    small = sizes.filter("tiles = 1").agg(F.sum("shingles"), F.sum("n")).first()
    bins = max(1, math.ceil(max((small[0] or 0) / UNIT_SHINGLES, (small[1] or 0) / UNIT_DOCS)))
    placed = members.join(sizes.select("component", "tiles"), "component").withColumn(
        "tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    bin_of = F.pmod(F.xxhash64("component", F.lit(3)), F.lit(bins)).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = placed.withColumn("partner", partner).select(
        F.col("node").alias("id"), "component", "set_key", "tile",
        F.when(F.col("tiles") > 1, F.col("component")).alias("large"),
        F.when(F.col("tiles") > 1, F.least("tile", "partner")).otherwise(bin_of).alias("first"),
        F.when(F.col("tiles") > 1, F.greatest("tile", "partner")).otherwise(F.lit(0)).alias("second"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return dealt.join(texts, "id").groupBy("large", "first", "second").applyInPandas(_unit_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    A document's set is its distinct five-word shingles; documents are linked where their
    sets agree to 75 per cent; a component is named by its least doc_id, whose row is kept.
    Equal sets are one node. A text without words has no shingles and no link. Rows that
    repeat a doc_id are judged by their own text. A row without doc_id links nothing; it
    takes the component of rows with an equal set and is kept where there is none. No rows
    give no rows, other columns are ignored.
    """
    known = written(profiles(docs), "profiles")
    reps = written(known.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "sets")
    clusters = components(ties(reps))
    links = confirmed_links(docs, reps, clusters)
    found = components(links)
    groups = reps.select("set_key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component"))
    named = known.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component.

    A doc_id stays if one of its rows does; rows without doc_id cannot be named and stay.
    """
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter(
        "doc_id is not null and not kept").alias("g")
    return docs.alias("d").join(gone, F.col("d.doc_id").cast("bigint") == F.col("g.doc_id"), "left_anti")
