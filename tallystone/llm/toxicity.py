"""Toxicity by the nearest labelled examples.

Terms are words cut behind their fifth letter, so that the forms of a word are one term.
Weights are TF-IDF, one plus the logarithm of the count times the logarithm of how rare a
term is over all documents, and norms are taken over the whole text, terms that no example
holds included.

The nearest examples by cosine are found exactly with a block-max inverted index: postings
lie in the order of the examples, cut into blocks of 64, each with the greatest weight that
a term has in it. The few terms that most blocks are full of, with which no block can be
told from another, are rows of weights over all examples; what they give is known before
blocks are chosen. Blocks are visited by the bound that the terms of a text give them, until
no block left can hold an example as near as the last of the nearest so far. In the blocks
visited, terms come in the order of their own bounds; those whose bounds together could not
bring an example that far are only looked up for examples that other terms have brought
near enough.

Labels count in the vote alone: the nearest examples, and those whose part of the cosine
that rests on telling terms is greatest, weigh by the fourth power of that part, against what the
whole cosine of the nearest would weigh at one part in fifty. A
term tells if its rate among toxic examples is higher than chance explains, where those in
which it follows the same word count as one, as copies of a text do. Votes are calibrated on
the examples themselves, each left out of its own vote, in tasks that share
the index.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.store import map_rows, written

EXAMPLES = 2_400  # labelled documents the index holds, chosen by hash; the expected number
LETTERS = 5  # of a word that make its term
BLOCK = 64  # examples of a block
COMMON = 1 / 50  # share of the examples from which on a term is a row over all of them
ROUND = 8  # blocks visited first; each further round visits five times as many
SLICE = 64  # texts scored at once
NEAREST = 32
THRESHOLD = 0.7
UNTOLD = 0.02  # what similarity that tells nothing weighs
POWER = 4  # of the similarity that tells: how fast votes fall with distance
PRIOR = 1e-12  # weight of the rate among examples without terms in each vote
SURE = 20  # one over the chance that any term is called telling that tells nothing
REMEMBERED = 20_000  # texts whose score a task remembers

_WORD = re.compile(rf"(\w{{1,{LETTERS}}})\w*")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def term_counts(text: str | None) -> dict[str, int]:
    """How often each term occurs in a whole text."""
    return Counter(_WORD.findall((text or "").lower()))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each ``first`` on, as many as ``size`` says, one range after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Index:
    """Examples by their weighted terms, with exact search for the nearest."""

    def __init__(self, examples: list[tuple], idf: np.ndarray, unknown: float = 0.0, telling: np.ndarray | None = None) -> None:
        self.idf, self.unknown = np.asarray(idf, float), unknown
        self.telling = np.zeros(len(self.idf), bool) if telling is None else telling
        empty = [toxic for _, toxic, terms, _ in examples if not len(terms)]
        n_toxic = sum(toxic for _, toxic, _, _ in examples)
        self.rate = (sum(empty) + 0.5 * (n_toxic + 1) / (len(examples) + 2)) / (len(empty) + 0.5)
        filled = self._ordered([e for e in examples if len(e[2])])
        self.ids = [e[0] for e in filled]
        self.toxic = np.array([e[1] for e in filled], float)
        self.first = np.cumsum([0, *(len(e[2]) for e in filled)])
        none = [np.zeros(0, np.int32)]
        self.terms = np.concatenate([np.asarray(e[2], np.int32) for e in filled] or none)
        weights = self._weights(self.terms, np.concatenate([np.asarray(e[3], np.int32) for e in filled] or none))
        sums = np.add.reduceat(weights * weights, self.first[:-1]) if len(filled) else np.zeros(0)
        self.weights = weights / np.sqrt(np.where(sums > 0, sums, 1.0)).repeat(np.diff(self.first))
        self.visited = [0, 0]  # blocks that were visited, and all of them
        self._lists: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}  # made again where they are used

    def _ordered(self, examples: list[tuple]) -> list[tuple]:
        """Examples that hold the same common terms side by side, so that blocks differ."""
        held = np.bincount(np.concatenate([np.asarray(e[2], np.int64) for e in examples]), minlength=len(self.idf)) if examples else np.zeros(0)
        common = np.argsort(-held, kind="stable")[:24]
        return [e for _, _, e in sorted((np.isin(common, e[2], invert=True).tolist(), k, e) for k, e in enumerate(examples))]

    def _weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[terms]

    def vector(self, terms: np.ndarray, counts: np.ndarray, others: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights under the norm of the whole text; ``others`` is the sum of the squares of
        1 + log(count) over its terms that no example holds."""
        terms, counts = np.asarray(terms, np.int64), np.asarray(counts, float)
        if not len(terms):
            return terms, counts
        weights = self._weights(terms, counts)
        return terms, weights / np.sqrt(max((weights * weights).sum() + others * self.unknown**2, 1e-300))

    def example(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[row], self.first[row + 1]
        return self.terms[a:b], self.weights[a:b]

    def lists(self) -> tuple:
        """Rows of common terms: the place of each term among them or -1, and their weights over all examples.

        Then postings of the other terms: example and weight; their blocks by term: number,
        greatest weight, first posting, postings; where the blocks of each term begin, and
        the greatest weight of each term.
        """
        if self._lists is None:
            n = len(self.ids)
            held = np.bincount(self.terms, minlength=len(self.idf))
            common = np.flatnonzero(held > COMMON * n)
            place = np.full(len(held), -1)
            place[common] = np.arange(len(common))
            members = np.repeat(np.arange(n), np.diff(self.first))
            matrix = np.zeros((len(common), n))
            among = place[self.terms] >= 0
            matrix[place[self.terms[among]], members[among]] = self.weights[among]
            rare = np.flatnonzero(~among)
            order = rare[np.argsort(self.terms[rare], kind="stable")]
            terms, weights, members = self.terms[order], self.weights[order], members[order]
            block = members // BLOCK
            new = np.ones(len(terms), bool)
            new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(terms)))
            most = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0)
            begin = np.searchsorted(terms[first], np.arange(len(self.idf) + 1))
            greatest = np.zeros(len(self.idf))
            np.maximum.at(greatest, terms[first], most)
            self._lists = place, matrix, members, weights, block[first], most, first, size, begin, greatest
        return self._lists

    def given(self, vectors: list[tuple]) -> np.ndarray:
        """What the common terms of each vector give to every example."""
        place, matrix = self.lists()[:2]
        wanted = np.zeros((len(vectors), len(matrix)))
        for row, (terms, weights) in enumerate(vectors):
            at = place[terms]
            wanted[row, at[at >= 0]] = weights[at >= 0]
        return wanted @ matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest examples that share a term, nearest first; ties to the lower number."""
        return self.search(terms, weights, k, self.given([(terms, weights)])[0])[:2]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``nearest``, and what of the similarity with every example rests on telling terms."""
        place, matrix, members, listed, block, most, first, size, begin, greatest = self.lists()
        n, n_blocks = len(self.ids), math.ceil(len(self.ids) / BLOCK)
        told = np.zeros(n)
        for at in np.flatnonzero(self.telling[terms] & (place[terms] >= 0)):
            told += weights[at] * matrix[place[terms[at]]]
        rare = place[terms] < 0
        all_terms, all_weights, terms, weights = terms, weights, terms[rare], weights[rare]
        long = begin[terms + 1] - begin[terms]
        entry = _ranges(begin[terms], long)
        owner, weight = np.repeat(np.arange(len(terms)), long), np.repeat(weights, long)
        in_block, bound = block[entry], most[entry] * weight

        def sums(entries: np.ndarray) -> np.ndarray:
            """What the postings of some blocks give to every example."""
            of = entry[entries]
            postings = _ranges(first[of], size[of])
            return np.bincount(members[postings], listed[postings] * np.repeat(weight[entries], size[of]), n)

        before = np.zeros(n_blocks * BLOCK)
        before[:n] = given
        bounds = np.bincount(in_block, bound, n_blocks) + before.reshape(n_blocks, BLOCK).max(axis=1, initial=0.0)
        by_bound = np.argsort(-bounds, kind="stable")
        by_bound = by_bound[bounds[by_bound] > 0]
        # terms in order of their bounds, the least first, and how far they come together
        limits = greatest[terms] * weights
        rising = np.argsort(limits, kind="stable")
        together = np.cumsum(limits[rising])
        found, scores, least, at, turn = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, ROUND
        while at < len(by_bound):
            now = by_bound[at : at + turn]
            now = now[bounds[now] >= least]
            if not len(now):
                break
            at, turn = at + turn, turn * 5
            self.visited[0] += len(now)
            visit = np.zeros(n_blocks, bool)
            visit[now] = True
            here = visit[in_block]
            rows = (np.sort(now)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < n]
            slight = np.zeros(len(terms), bool)
            slight[rising[together < least / 4]] = True
            light = slight[owner]
            own = (given + sums(np.flatnonzero(here & ~light)))[rows]
            rest = np.flatnonzero(here & light)
            if len(rest):  # only examples that could come near enough with the slight terms take them in
                left = np.bincount(in_block[rest], bound[rest], n_blocks)
                keep = own + left[rows // BLOCK] >= least
                rows, own = rows[keep], own[keep]
                if (self.first[rows + 1] - self.first[rows]).sum() < size[entry[rest]].sum():
                    own = self._products(all_terms, all_weights, rows)
                else:
                    own = own + sums(rest)[rows]
            found, scores = np.concatenate([found, rows[own > 0]]), np.concatenate([scores, own[own > 0]])
            if len(scores) >= k:
                # a little less, as sums in another order differ by rounding
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k] * (1 - 1e-9))
                found, scores = found[scores >= least], scores[scores >= least]
        self.visited[1] += len(by_bound)
        order = np.lexsort([found, -np.round(scores, 12)])[:k]
        return found[order], scores[order], told + sums(np.flatnonzero(self.telling[terms][owner]))

    def _products(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Similarity of examples, from all their terms."""
        if not len(rows):
            return np.zeros(0)
        full = np.zeros(len(self.idf))
        full[terms] = weights
        size = self.first[rows + 1] - self.first[rows]
        at = _ranges(self.first[rows], size)
        begin = np.cumsum(size) - size
        return np.add.reduceat(full[self.terms[at]] * self.weights[at], begin)

    def _voters(self, rows: np.ndarray, told: np.ndarray) -> np.ndarray:
        """The nearest examples and as many with most told similarity, most told first; ties to the lower number."""
        least = np.partition(told, len(told) - NEAREST)[len(told) - NEAREST] if len(told) > NEAREST else 0.0
        some = np.flatnonzero((told >= least) & (told > 0))
        some = some[np.lexsort([some, -told[some]])[:NEAREST]]
        return np.concatenate([some, rows[~np.isin(rows, some)]])

    def _vote(self, rows: np.ndarray, scores: np.ndarray, told: np.ndarray) -> float:
        voters = self._voters(rows, told)
        weight = told[voters] ** POWER
        untold = ((UNTOLD * scores) ** POWER).sum()
        vote = (weight @ self.toxic[voters] + PRIOR * self.rate) / (weight.sum() + untold + PRIOR)
        return float(np.clip(vote, 1e-9, 1 - 1e-9))

    def told_by(self, contexts: np.ndarray) -> np.ndarray:
        """Which terms tell, by a likelihood ratio test against all terms tried.

        The ratio holds the share of a term's examples that are toxic against the share that
        toxic examples have of all terms: both are rates of their class, and long texts, which
        hold more of all terms, make no term tell. Only higher toxic rates count. A term has
        no more toxic examples than ``contexts``, the words that it follows in them.
        """
        t, c = (np.bincount(self.terms, np.repeat(side, np.diff(self.first)), len(self.idf)) for side in (self.toxic, 1 - self.toxic))
        if not t.sum() or not c.sum():
            return np.zeros(len(self.idf), bool)
        share = t.sum() / (t.sum() + c.sum())
        t = np.minimum(t, contexts)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(t > 0, t * np.log(t / ((t + c) * share)), 0) + np.where(c > 0, c * np.log(c / ((t + c) * (1 - share))), 0))
        return (t > (t + c) * share) & (ratio > 2 * math.log(max(2, len(t)) * SURE))

    def own_votes(self, rows: list[int]) -> list[float]:
        """Votes of examples, each without itself."""
        votes = []
        for k, given in zip(rows, self.given([self.example(k) for k in rows])):
            near, scores, told = self.search(*self.example(k), NEAREST + 1, given)
            other, told[k] = near != k, 0.0
            votes.append(self._vote(near[other][:NEAREST], scores[other][:NEAREST], told))
        return votes

    def calibrated(self, votes: np.ndarray) -> tuple[float, float]:
        """Shift and slope of the logit of a vote, held near 0 and 1 by a prior: the least of a convex loss."""
        x = np.log(votes / (1 - votes)) if len(votes) else votes
        prior = np.array([1.0, 4.0])

        def loss(at: np.ndarray) -> float:
            line = at[0] + at[1] * x
            return float((np.logaddexp(0, line) - self.toxic * line).sum() + (prior * (at - [0, 1]) ** 2).sum() / 2)

        at = np.array([0.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -500, 500)))
            error, spread = p - self.toxic, p * (1 - p)
            gradient = np.array([error.sum(), (error * x).sum()]) + prior * (at - [0, 1])
            curve = np.array([[spread.sum(), (spread * x).sum()], [(spread * x).sum(), (spread * x * x).sum()]]) + np.diag(prior)
            step = np.linalg.solve(curve, gradient)
            now = loss(at)
            while loss(at - step) > now and abs(step).max() > 1e-12:
                step = step / 2
            at = at - step
            if abs(step).max() < 1e-9:
                break
        return float(at[0]), float(max(0.1, at[1]))

    def scores(self, texts: list[tuple], line: tuple[float, float]) -> list[tuple[float, list[int], list[float]]]:
        """For terms, counts and others of each text its calibrated score, and the examples it rests on with their similarity."""
        out: list = []
        vectors = [self.vector(*text) for text in texts]
        for vector, given in zip(vectors, self.given(vectors)):
            if not len(vector[0]):
                out.append((self.rate, [], []))
                continue
            rows, near, told = self.search(*vector, NEAREST, given)
            vote = self._vote(rows, near, told)
            value = 1 / (1 + math.exp(-max(-500.0, line[0] + line[1] * math.log(vote / (1 - vote)))))
            most = self._voters(rows, told)[:3]  # evidence: what the vote rests on most
            out.append((value, most.tolist(), self._products(*vector, most).tolist()))
        return out


class Space:
    """The terms of the examples and what finds them in a text."""

    def __init__(self, terms: list[str], telling: np.ndarray | None = None) -> None:
        self.terms, self.telling = terms, telling
        self._number: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_number": None}

    def number(self) -> dict[str, int]:
        if self._number is None:
            self._number = {term: k for k, term in enumerate(self.terms)}
        return self._number

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Terms of the space in a whole text, how often each occurs, and what ``Index.vector`` needs of the others."""
        if not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0
        found = term_counts(text)
        number = self.number()
        terms = np.array([number.get(term, -1) for term in found], np.int64)
        times = np.fromiter(found.values(), np.int64, len(found))
        others = ((1 + np.log(times[terms < 0])) ** 2).sum()
        order = np.argsort(terms, kind="stable")[(terms < 0).sum() :]
        return terms[order], times[order], float(others)


def labelled(labels: DataFrame) -> DataFrame:
    """At most about ``EXAMPLES`` labelled documents outside the held-out fold, by hash."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    share = EXAMPLES / max(EXAMPLES, usable.count())
    return usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 20)) < int(share * (1 << 20)))


def term_contexts(text: str | None) -> set[tuple[str, str]]:
    """Each term of a text with the words it follows."""
    words = _WORD.findall((text or "").lower())
    return set(zip(words, ["", *words]))


def example_terms(chosen: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the examples in order, and how many words each follows in toxic ones; none without examples of both kinds."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms: set = set()
            pairs: set = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                terms.update(term_counts(text))
                if toxic:
                    pairs |= term_contexts(text)
            rows = [*((term, None) for term in terms), *pairs]
            columns = zip(*rows) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["term", "before"])

    if chosen.select("toxic").distinct().count() < 2:
        return [], np.zeros(0)
    seen = chosen.select("text", "toxic").mapInArrow(split, "term string, before string").distinct()
    counts = seen.groupBy("term").agg(F.count("before").alias("n")).toArrow().sort_by("term")  # bounded as the examples are
    return counts.column("term").to_pylist(), counts.column("n").to_numpy().astype(float)


def held_by(docs: DataFrame, shared: Broadcast) -> np.ndarray:
    """In how many documents each term of the space is."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        seen = np.zeros(len(space.terms), np.int64)
        number = space.number()
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column("text").to_pylist():
                held.update(set(_WORD.findall((text or "").lower())))
            for term in held.keys() & number.keys():
                seen[number[term]] += held[term]
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(seen[terms], pa.int64())], names=["term", "n"])

    held = np.zeros(len(shared.value.terms))
    if len(held):
        found = docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        held[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return held


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, Broadcast, np.ndarray, tuple[float, float]]:
    """The space and the index of examples at every task, sent once, which terms tell, and what calibrates votes."""
    spark = docs.sparkSession
    examples = written(labelled(labels), "labels")
    # the sample is bounded by EXAMPLES, so it may be sent to every task; a doc_id on many rows gives one text
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(examples), "doc_id")
    chosen = written(found.groupBy("doc_id", "toxic").agg(F.max(F.struct(F.xxhash64("text").alias("draw"), "text")).alias("t")).select(
        "doc_id", "toxic", "t.text"), "examples")
    terms, contexts = example_terms(chosen)
    space = spark.sparkContext.broadcast(Space(terms))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [space.value.counts(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    known = chosen.mapInArrow(find, f"doc_id {kind}, toxic int, terms array<int>, counts array<int>").toArrow()  # bounded by EXAMPLES
    rows = [
        (doc_id, toxic, t.values.to_numpy(), n.values.to_numpy())
        for doc_id, toxic, t, n in zip(known.column("doc_id").to_pylist(), known.column("toxic").to_pylist(), known.column("terms"), known.column("counts"))]
    rows.sort(key=lambda r: (r[0], r[2].tobytes(), r[3].tobytes()))
    n = docs.count()
    index = Index(rows, np.log((1 + n) / (1 + held_by(docs, space))), math.log((1 + n) / 2))
    if not index.ids:
        return space, spark.sparkContext.broadcast(index), index.telling, (0.0, 1.0)
    shared, n_examples = spark.sparkContext.broadcast(index), len(index.ids)

    telling = index.told_by(contexts)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.telling = telling
        for batch in batches:
            own = model.own_votes(batch.column("id").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.float64())], names=["id", "vote"])

    votes = spark.range(0, n_examples, 1, math.ceil(n_examples / 256)).mapInArrow(vote, "id bigint, vote double").toArrow().sort_by("id")
    return space, shared, telling, index.calibrated(votes.column("vote").to_numpy())


def _scored(space: Space, index: Index, line: tuple[float, float], seen: dict, texts: list[str | None]) -> list[tuple]:
    """Score, telling terms, nearest examples and their similarity of each text; equal texts are scored once while remembered."""
    keys = [hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for text in texts]
    if len(seen) > REMEMBERED:
        seen.clear()
    new = {key: text for key, text in zip(keys, texts) if key not in seen}
    found = [space.counts(text) for text in new.values()]
    for key, (terms, _, _), result in zip(new, found, index.scores(found, line)):
        seen[key] = (result[0], " ".join(space.terms[t] for t in terms[index.telling[terms]]), *result[1:])
    return [seen[key] for key in keys]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, then evidence: terms and nearest examples.

    Every row of ``docs`` gets a score from its whole text. A null or empty text, or one
    without a term of any example, gets the toxic rate of such examples. Evidence names the
    terms that tell by themselves; the score rests on all. Labels come from rows of
    ``labels`` outside the held-out fold; a doc_id labelled twice is toxic if one label
    says so; null labels are left out. Without labels of both kinds no term tells and all
    scores are one low prior rate. Of rows that repeat a labelled doc_id with several texts
    one text is learned from. Similarities that are equal take the neighbour that comes
    first in the index. Other columns are ignored; no rows give no rows. A very long text is
    read whole; its terms and counts are what memory holds of it.
    """
    space, index, telling, line = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = index.value, {}
        model.telling = telling
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                id_type = batch.schema.field("doc_id").type
                values, words, rows, alike = zip(*_scored(space.value, model, line, seen, batch.column("text").to_pylist()))
                near = [[{"doc_id": model.ids[r], "similarity": s} for r, s in zip(*some)] for some in zip(rows, alike)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(values, pa.float64()), pa.array(words, pa.string()),
                    pa.array(near, pa.list_(pa.struct([("doc_id", id_type), ("similarity", pa.float64())]))),
                ], names=["doc_id", "score", "evidence", "nearest"])

    scored = docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, score double, evidence string, nearest array<struct<doc_id:{kind},similarity:double>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "nearest")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns.

    Scores are those of ``toxicity``: null and empty texts get the prior rate and stay,
    repeated rows stay or go together, no rows give no rows, without labels all stay.
    """
    space, index, telling, line = fit(docs, labels)

    def keep(batch: pa.RecordBatch, text: int) -> pa.RecordBatch:
        seen: dict = {}
        kept: list[bool] = []
        model = index.value
        model.telling = telling
        for at in range(0, batch.num_rows, SLICE):
            kept += [found[0] < THRESHOLD for found in _scored(space.value, model, line, seen, batch.column(text).slice(at, SLICE).to_pylist())]
        return batch.filter(pa.array(kept, pa.bool_()))

    return map_rows(docs, keep)
