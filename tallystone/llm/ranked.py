"""Ranked lexical search by pipelined term partitioning.

Documents lie in slices of bounded size with the postings of the terms that items ask for.
Terms are dealt to a few owners, rare terms first and about as many postings to each. A
bundle of items goes with each slice from owner to owner: a stage brings its sparse document
accumulators together with the owner's postings of the slice, adds whole-number
contributions, and hands on what may still rank. The last stage gives the best of each
slice, from which the best of all are chosen.

Nothing that could rank is lost: a document is handed on unless what it has, with all that
the owners behind could add, is below what as many documents as are asked for already have.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.store import unused, written

SLICE_ROWS = 4096  # documents of a slice
BUNDLE_ITEMS = 256  # items that go through the owners together
BLOCK_CHARS = 1 << 21  # characters of items that are held by the driver and every task at once
OWNERS = 4
BEST = 20

_SEPARATORS = bytes(c for c in range(0x80) if not chr(c).isalnum())
_FOLD = bytes(32 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_LENGTHS = -1  # the term under which the postings hold the lengths of a slice's documents


def terms_of(text: str | None) -> Counter[bytes]:
    """How often each term is in a whole text: runs of other than ASCII separators, A to Z in lower case."""
    return Counter((text or "").encode().translate(_FOLD).split())


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """slice, term, places and times: where the terms of ``numbers`` are in a slice's documents and how often.

    Each slice also has a row with the length of every document in ``times``, and their ids.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(numbers)  # of at most BLOCK_CHARS characters
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        held: dict[int, tuple[list[int], list[int]]] = {}
        kind = None

        def done() -> pa.RecordBatch:
            rows = [(_LENGTHS, [], lengths), *((term, *held[term]) for term in sorted(held))]
            term, places, times = zip(*rows)
            return pa.RecordBatch.from_arrays([
                pa.array([number] * len(rows), pa.int64()), pa.array(term, pa.int32()), pa.array(places, pa.list_(pa.int32())),
                pa.array(times, pa.list_(pa.int32())), pa.array([ids, *[None] * (len(rows) - 1)], pa.list_(kind)),
            ], names=["slice", "term", "places", "times", "ids"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = terms_of(text)
                place = len(ids)
                ids.append(doc_id)
                lengths.append(found.total())
                for word in known.keys() & found.keys():
                    own = held.get(known[word])
                    if own is None:
                        own = held[known[word]] = ([], [])
                    own[0].append(place)
                    own[1].append(found[word])
                if len(ids) == SLICE_ROWS:
                    yield done()
                    ids, lengths, held, number = [], [], {}, number + 1
        if ids:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"slice bigint, term int, places array<int>, times array<int>, ids array<{id_type}>")


def _bound(times: int) -> int:
    """The most that a term can give for one unit of weight where no document has it more often."""
    return 1_000_000_000 * times // (1000 * times + 12 * 75)


def _added(places: np.ndarray, gains: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse accumulators, places and scores, with the contributions of an owner's terms."""
    total = np.zeros(n, np.int64)
    touched = np.zeros(n, bool)
    touched[places] = True
    for where, gain in gains:
        total[where] += gain
        touched[where] = True
    at = np.flatnonzero(touched)
    return at, total


def _search(docs: DataFrame, items: list[tuple[int, Counter]], best: int, owners: int) -> DataFrame:
    """item, id and score of the best documents of each slice for one block of items."""
    spark = docs.sparkSession
    words = sorted({word for _, wanted in items for word in wanted})
    rows = written(postings(docs, {word: k for k, word in enumerate(words)}), "postings")
    own = rows.filter(F.col("term") == _LENGTHS).select(F.explode("times").alias("n")).agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(own[0]), int(own[1])
    held = rows.filter(F.col("term") >= 0).groupBy("term").agg(
        F.sum(F.size("places")).alias("df"), F.max(F.array_max("times")).alias("most")).collect()  # a row for each term of the block
    df, most = {r["term"]: r["df"] for r in held}, {r["term"]: r["most"] for r in held}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    # rare terms first; each owner gets about as many postings
    share, through, owner = sum(df.values()) / owners if df else 1.0, 0, {}
    for term in sorted(df, key=lambda t: (df[t], t)):
        owner[term] = min(owners - 1, int(through / share))
        through += df[term]
    numbered = {word: k for k, word in enumerate(words)}
    asked = {}  # of each item: terms, times their weight, by owner; and what the owners behind can still add
    for item, wanted in items:
        by_owner: list[list[tuple[int, int]]] = [[] for _ in range(owners)]
        ahead = [0] * (owners + 1)
        for word, times in wanted.items():
            term = numbered[word]
            if term in df:
                by_owner[owner[term]].append((term, times * weight[term]))
                ahead[owner[term]] += times * max(0, weight[term]) * _bound(most[term])
        for k in range(owners - 1, -1, -1):
            ahead[k] += ahead[k + 1]
        asked[item] = by_owner, ahead[1:]
    shared = spark.sparkContext.broadcast(asked)
    n_bundles = math.ceil(len(items) / BUNDLE_ITEMS)
    members = [[item for item, _ in items[k * BUNDLE_ITEMS : (k + 1) * BUNDLE_ITEMS]] for k in range(n_bundles)]
    of_bundle: dict[int, set[int]] = {}
    for k, group in enumerate(members):
        for item in group:
            for stage in asked[item][0]:
                for term, _ in stage:
                    of_bundle.setdefault(term, set()).add(k)
    routes = spark.createDataFrame(
        [(t, owner[t], k) for t, ks in of_bundle.items() for k in ks] + [(_LENGTHS, o, k) for o in range(owners) for k in range(n_bundles)],
        "term int, owner int, bundle int")
    routed = written(rows.join(F.broadcast(routes), "term").select("owner", "bundle", "slice", "term", "places", "times").repartition(
        "bundle", "slice"), "routed") if n_bundles > 1 else rows.join(F.broadcast(routes), "term").select(
        "owner", "bundle", "slice", "term", "places", "times")  # routes are as bounded as the block

    def stage(number: int):
        def run(key: tuple, state: pa.Table, brought: pa.Table) -> pa.Table:
            terms = brought.column("term").to_pylist()
            places, times = (brought.column(name).combine_chunks() for name in ("places", "times"))
            lengths = times[terms.index(_LENGTHS)].values.to_numpy().astype(np.int64)
            m = 75 + (25 * lengths * n_docs) // max(1, n_terms)
            gains = {}
            for row, term in enumerate(terms):
                if term != _LENGTHS:
                    where, tf = places[row].values.to_numpy(), times[row].values.to_numpy().astype(np.int64)
                    gains[term] = where, 1_000_000_000 * tf // (1000 * tf + 12 * m[where])
            before = dict(zip(state.column("item").to_pylist(), zip(state.column("places"), state.column("scores"))))
            out: list[tuple] = []
            for item in members[key[0].as_py()]:
                by_owner, ahead = shared.value[item]
                mine = [(gains[t][0], w * gains[t][1]) for t, w in by_owner[number] if t in gains]
                at, scores = (before[item][k].values.to_numpy() for k in (0, 1)) if item in before else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                if mine:
                    at, total = _added(at, mine, len(lengths))
                    if item in before:
                        old_at, old = (x.values.to_numpy() for x in before[item])
                        total[old_at] += old
                    scores = total[at]
                if len(at) > best:
                    # a lower bound of what the last of the best will have
                    least = np.partition(scores, len(scores) - best)[len(scores) - best]
                    keep = scores + ahead[number] >= least
                    at, scores = at[keep], scores[keep]
                if len(at):
                    out.append((item, at.astype(np.int32), scores))
            item, at, scores = zip(*out) if out else [[]] * 3
            return pa.Table.from_arrays([
                pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([key[1].as_py()] * len(out), pa.int64()), pa.array(item, pa.int64()),
                pa.array(at, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.int64())),
            ], names=["bundle", "slice", "item", "places", "scores"])
        return run

    schema = "bundle int, slice bigint, item bigint, places array<int>, scores array<bigint>"
    state = spark.createDataFrame([], schema)
    for number in range(owners):
        brought = routed.filter(F.col("owner") == number).drop("owner")
        state = state.groupBy("bundle", "slice").cogroup(brought.groupBy("bundle", "slice")).applyInArrow(stage(number), schema)
    ids = rows.filter(F.col("term") == _LENGTHS).select("slice", F.posexplode("ids").alias("place", "doc_id"))
    ranked = state.select("slice", "item", F.explode(F.arrays_zip("places", "scores")).alias("x")).select(
        "slice", "item", F.col("x.places").alias("place"), F.col("x.scores").alias("score")).filter("score > 0")
    return ranked.join(ids, ["slice", "place"])


def ranked_search(docs: DataFrame, items: DataFrame, best: int = BEST, owners: int = OWNERS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``best`` documents for each row of ``items``.

    Both tables have ``text``, whole texts count. Equal scores rank by doc_id, null last;
    repeated rows of ``docs`` are documents of their own and rank one behind the other;
    repeated rows of ``items`` are each ranked. Null and empty texts have no terms: such
    items give no rows, such documents never rank. Other columns are ignored; empty tables
    give no rows. Items are taken in blocks of about ``BLOCK_CHARS`` characters, each of
    which reads the documents once; a longer item is a block of its own.
    """
    spark = docs.sparkSession
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    sizes = asked.select("item", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = None
    for block in range(max(1, math.ceil(total / BLOCK_CHARS))):
        through = F.sum("n").over(W.orderBy("item").rowsBetween(W.unboundedPreceding, -1))
        own = sizes.withColumn("block", F.floor(F.coalesce(through, F.lit(0)) / BLOCK_CHARS)).filter(F.col("block") == block)
        texts = asked.join(own.select("item"), "item").select("item", "text").orderBy("item").collect()  # of one block
        wanted = [(r["item"], counted) for r in texts if (counted := terms_of(r["text"]))]
        if wanted:
            part = _search(docs, wanted, best, owners)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score bigint")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "slice", "place")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
