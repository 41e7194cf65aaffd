"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation,
and a hashed linear scorer trained on the posterior labels.

Each labeller looks at one property of a text and votes good, bad or not at all. Votes of
all documents are counted by pattern; on these counts EM estimates how often each labeller
is right on good and on bad texts. The posterior of a document's pattern is its label. A
logistic scorer over hashed words and word shapes learns the labels of a bounded sample,
and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.store import written
from tallystone.llm.words import mixed, text_bytes, word_hashes

SAMPLE = 8_000  # documents the scorer is trained on, by hash; the expected number
DIM = 1 << 13
EPOCHS = 15
THRESHOLD = 0.5
SEED = 31
GOOD, BAD, SILENT = 1, 0, 2

_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _MARK, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = _MARK
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = _STOP

LABELLERS = ("prose", "variety", "capitals", "marks", "repeats", "lone_marks", "word_length", "digits", "length")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Batch:
    """Words and characters of a batch of texts, as arrays."""

    def __init__(self, texts: pa.Array) -> None:
        data, self.offsets = text_bytes(texts)
        kinds = _CLASS[data]
        self.chars = {k: _sums(kinds == k, self.offsets) for k in (_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _OTHER)}
        self.hashes, self.words = word_hashes(texts)
        space = kinds == _SPACE
        before = np.concatenate([[True], space[:-1]])
        before[self.offsets[:-1][self.offsets[:-1] < len(before)]] = True
        starts = np.flatnonzero(~space & before)
        after = np.concatenate([space[1:], [True]]) if len(space) else space
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = True
        spans = np.stack([starts, np.flatnonzero(~space & after) + 1], 1)
        count = lambda k: self._per_word(kinds == k, spans)
        upper, lower, digit, stop, mark, other = (count(k) for k in (_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _OTHER))
        length = spans[:, 1] - spans[:, 0]
        self.lone = (upper + lower + digit + other == 0) & (mark > 0)
        n = self.words[1:] - self.words[:-1]
        self.owner = np.repeat(np.arange(len(n)), n)
        first = np.zeros(len(self.hashes), bool)
        first[self.words[:-1][n > 0]] = True
        self.again = np.concatenate([[False], self.hashes[1:] == self.hashes[:-1]]) & ~first if len(first) else first
        self.shapes = (np.minimum(length, 15) // 2 * 256 + np.minimum(upper, 3) * 64 + (lower + other > 0) * 32 + (digit > 0) * 16
                       + np.minimum(mark, 3) * 4 + np.minimum(stop, 1) * 2 + self.again).astype(np.uint64)
        self.first = first
        self.plain = (lower + other > 0) & (upper <= 1) & (digit + mark == 0) & (stop <= 2)

    @staticmethod
    def _per_word(mask: np.ndarray, spans: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[spans[:, 1]] - total[spans[:, 0]]

    def votes(self) -> np.ndarray:
        """Row per text, column per labeller."""
        n = np.diff(self.words)
        some = np.maximum(n, 1)
        letters = np.maximum(self.chars[_UPPER] + self.chars[_LOWER], 1)
        chars = np.maximum(sum(self.chars.values()), 1)
        pairs = np.unique(self.owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(self.hashes), return_index=True)[1]
        distinct = np.bincount(self.owner[pairs], minlength=len(n))

        def vote(known: np.ndarray, bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
            return np.where(known & bad, BAD, np.where(known & good, GOOD, SILENT))

        enough = n >= 8
        plain = _sums(self.plain, self.words) / some
        fresh = distinct / np.minimum(some, 200)
        return np.stack([
            vote(n > 0, plain < 0.6, plain > 0.85),
            vote(enough, fresh < 0.15, fresh > 0.4),
            vote(letters >= 8, self.chars[_UPPER] / letters > 0.4),
            vote(n > 0, self.chars[_MARK] / some > 0.4),
            vote(enough, _sums(self.again, self.words) / some > 0.15),
            vote(enough, _sums(self.lone, self.words) / some > 0.12),
            vote(n > 0, np.abs(chars / some - 7.5) > 6),
            vote(n > 0, self.chars[_DIGIT] / chars > 0.3),
            vote(n >= 0, n <= 2, n >= 20),
        ], 1).astype(np.int8)

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, weight): shares of words, shapes and pairs of shapes; rows have length one."""
        before = np.concatenate([[0], self.shapes[:-1]]).astype(np.uint64) if len(self.shapes) else self.shapes
        before = np.where(self.first, np.uint64(1 << 20), before)
        tokens = np.concatenate([
            mixed(self.hashes), mixed(self.shapes + np.uint64(1 << 32)),
            mixed(self.shapes * np.uint64(1 << 21) + before + np.uint64(1 << 50))])
        owners = np.concatenate([self.owner] * 3)
        keys, counts = np.unique(owners * DIM + (tokens % np.uint64(DIM)).astype(np.int64), return_counts=True)
        rows, buckets = keys // DIM, keys % DIM
        weights = np.sqrt(counts)
        norm = np.sqrt(np.bincount(rows, weights * weights, minlength=len(self.words) - 1))
        return rows, buckets, weights / norm[rows]


def batches_of(texts: pa.Array, most: int = 1 << 21) -> Iterator[Batch]:
    """Batches of about ``most`` bytes; a longer text is one by itself."""
    sizes = np.cumsum([0, *(len(t) if t else 0 for t in texts.to_pylist())])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield Batch(texts.slice(at, end - at))
        at = end


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, how labellers vote on bad and on good ones, and posteriors, by EM.

    The votes are an array (class, labeller, vote), silence being a vote of its own: most
    labellers know one fault and say nothing else. A labeller's accuracy on a class is its
    share of right votes among those cast. EM begins with texts that draw more bad votes
    than good ones, or any from those who never praise, as bad.
    """
    votes = votes_of(patterns)
    cast = np.stack([votes == v for v in (BAD, GOOD, SILENT)], 2).astype(float)
    posterior = np.where((votes == BAD).any(1), 0.15, 0.95)
    share, rates = 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        new = np.tensordot(weight, cast, (1, 0)) + 0.5
        new /= new.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        logit = np.log(share / (1 - share)) + np.tensordot(cast, np.log(new[1] / new[0]), ([1, 2], [0, 1]))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, rates = np.abs(new - rates).max(), new
        if moved < 1e-9:
            break
    return float(share), rates, posterior


def train(rows: list[tuple[bytes, bytes, float]], epochs: int = EPOCHS, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft labels, by mini batches with decaying steps."""
    weights, bias = np.zeros(DIM), 0.0
    if not rows:
        return weights, bias
    buckets = [np.frombuffer(b, np.uint16).astype(np.int64) for b, _, _ in rows]
    values = [np.frombuffer(v, np.float32).astype(float) for _, v, _ in rows]
    labels = np.array([y for _, _, y in rows])
    # both classes weigh the same in a step, however rare bad texts are
    balance = np.where(labels >= 0.5, 0.5 / max(1, (labels >= 0.5).sum()), 0.5 / max(1, (labels < 0.5).sum())) * len(rows)
    squares, rng = np.full(DIM, 1e-4), np.random.default_rng(SEED)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            which = np.concatenate([buckets[k] for k in part])
            value = np.concatenate([values[k] for k in part])
            owner = np.repeat(np.arange(len(part)), [len(buckets[k]) for k in part])
            logits = np.bincount(owner, weights[which] * value, minlength=len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[part]) * balance[part] / len(part)
            gradient = np.bincount(which, value * error[owner], minlength=DIM) + 1e-6 * weights
            squares += gradient * gradient
            weights -= rate * gradient / np.sqrt(squares)
            bias -= rate / (1 + epoch) * error.sum()
    return weights, bias


def _voted(docs: DataFrame) -> DataFrame:
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = [pattern_of(part.votes()) for part in batches_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(patterns) if patterns else [], pa.int64())], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(vote, f"doc_id {dict(docs.dtypes)['doc_id']}, pattern bigint")


def _features(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, found = [], ([], [])
            for part in batches_of(batch.column("text")):
                patterns.append(pattern_of(part.votes()))
                rows, buckets, weights = part.hashed()
                cuts = np.searchsorted(rows, np.arange(1, len(part.words) - 1))
                for column, array, kind in zip(found, (buckets, weights), (np.uint16, np.float32)):
                    column += [piece.astype(kind).tobytes() for piece in np.split(array, cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(patterns) if patterns else [], pa.int64()), *(pa.array(c, pa.binary()) for c in found)],
                names=["pattern", "buckets", "weights"])

    return docs.select("text").mapInArrow(make, "pattern bigint, buckets binary, weights binary")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, score, keep and weak_label of every row of ``docs``, from its whole text.

    ``score`` is between 0 and 1, higher for better texts; ``keep`` says it is at least one
    half; ``weak_label`` is the posterior of the votes. A null or empty text is one without
    words. Repeated rows and null ids are scored like any other; other columns are
    ignored; no rows give no rows.
    """
    voted = written(_voted(docs), "votes")
    counts = voted.groupBy("pattern").count().collect()  # three to the number of labellers at most
    patterns = np.array([r["pattern"] for r in counts], np.int64)
    n = np.array([r["count"] for r in counts], float)
    posterior = estimate(patterns, n)[2] if len(n) else np.zeros(0)
    label = dict(zip(patterns.tolist(), posterior.tolist()))
    share = SAMPLE / max(SAMPLE, n.sum())
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = sorted((bytes(r.buckets), bytes(r.weights), label[r.pattern]) for r in _features(sample).collect())
    model = docs.sparkSession.sparkContext.broadcast((*train(rows), label))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, posterior_of = model.value
        for batch in batches:
            scores, labels = [], []
            for part in batches_of(batch.column("text")):
                rows, buckets, values = part.hashed()
                logits = np.bincount(rows, values * weights[buckets], minlength=len(part.words) - 1) + bias
                scores.append(1 / (1 + np.exp(-np.clip(logits, -30, 30))))
                labels += [posterior_of[p] for p in pattern_of(part.votes()).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(labels, pa.float64())],
                names=["doc_id", "score", "weak_label"])

    scored = docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, weak_label double")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("keep"), "weak_label")
