"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 19
REMEMBERED = 500_000

# The space mark of the vocabulary also stands for a space when a text holds it.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_counters: dict[str, "PieceCounter"] = {}


def safe_parts(text: str) -> list[str]:
    """Cuts a text where no piece of the vocabulary can cross: at single spaces.

    Pieces hold the space mark only before a word or in a run of marks, and the encoder
    puts a mark before each text, which stands for the space that a cut takes away. So
    the counts of the parts sum to the count of the text.
    """
    if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    return text.split(" ")


class PieceCounter:
    """Counts of parts, each encoded once while it is remembered."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        parts = [safe_parts(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*parts).difference(self.known))
        self.known.update(zip(new, map(len, self.encoder.encode(new, num_threads=1))))
        return [sum(map(self.known.__getitem__, p)) for p in parts]


def _balanced(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BATCH_BYTES characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > BATCH_BYTES:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def token_lengths(texts: list[str], model: str) -> list[int]:
    counter = _counters.get(model) or _counters.setdefault(model, PieceCounter(model))
    return [n for run in _balanced(texts) for n in counter.lengths(run)]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    A null or empty text has no bytes and no tokens; a null doc_id and repeated rows give
    a row each; other columns are ignored; no rows give no rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(token_lengths(texts, model), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    read = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    id_type = dict(docs.dtypes)["doc_id"]
    counted = read.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
