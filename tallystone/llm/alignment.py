"""Alignment of the tokens of two vocabularies, and counts of the id pairs that it links.

A dictionary for each vocabulary leads from the ends of its tokens, as byte offsets, to their
places; the ends that both hold, in order, cut both token lists into groups, and within a
group every two tokens whose bytes overlap are linked. Texts are cut at single spaces, where tokens of both
vocabularies always end, so a segment is aligned once and remembered.

Documents are handled in bundles of bounded size. A bundle's distinct id pairs are moved
once, with the number of its documents that hold them; corpus-wide counts come back to the
bundle in the same order and are summed over the links of each document.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.store import written

BUNDLE_BYTES = 1 << 21  # of the texts of a bundle; a longer text is a bundle of its own
REMEMBERED = 200_000  # segments whose alignment a task remembers between bundles
TOGETHER = 8192  # segments that are aligned one behind the other
MARK = "▁"

_SAFE = re.compile(f"(?<=[^\\s{MARK}]) (?=[^\\s{MARK}])")
_aligners: dict[tuple[str, str], "Aligner"] = {}


def segments(text: str) -> list[str]:
    """A text cut at single spaces between characters that are neither white space nor marks.

    The byte-level vocabulary splits there before it merges, and no piece runs over a space;
    the space belongs to the segment behind it, as the space put before a text does.
    """
    return _SAFE.split(text)


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends that both token lists hold, in order, and how many tokens of each list come before them."""
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return tuple(np.array(x, np.int64) for x in (common, [index_a[end] for end in common], [index_b[end] for end in common]))


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every two tokens whose bytes overlap: the places of both, and the end of what they share.

    Between two neighbouring ends of either list lies one token of each, so there are as
    many links as different ends. A link never leaves its group, whose last end is in both.
    """
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


class Aligner:
    """Both vocabularies, and the alignment of every segment that is remembered.

    An id pair is one number: the id of the first vocabulary times 2**32 and the second's.
    """

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold memory
        self.first = Tokenizer.from_file(byte_vocabulary)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # characters in which every byte occurs that UTF-8 has
        every = [*range(0xC0), *range(0xC0, 0x800, 0x40), 0x800, *range(0x1000, 0xE000, 0x1000), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x30000), 0x100000]
        letters = {letter: byte for c in map(chr, every) for letter, byte in zip(as_bytes.pre_tokenize_str(c)[0][0], c.encode())}
        self.bytes_a = {i: bytes(letters[x] for x in token) for token, i in self.first.get_vocab(with_added_tokens=False).items() if all(x in letters for x in token)}
        self.bytes_b = [
            bytes([int(self.second.id_to_piece(i)[3:-1], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(self.second.get_piece_size())]
        if any(MARK in self.second.id_to_piece(i).lstrip(MARK) for i in range(self.second.get_piece_size())):
            raise ValueError(f"{piece_vocabulary} holds pieces that run over a space")
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.names_a = [str(i) for i in range(len(self.length_a))]
        self.names_b = self.names_a if len(self.length_b) <= len(self.names_a) else [str(i) for i in range(len(self.length_b))]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.n_links = array("q"), array("q"), array("q"), array("q")  # by number of the segment
        self.text: list[bytes | None] = []  # its groups as written; None where the bytes differ
        self.pairs = array("q")  # of all segments, one after the other

    def _keep(self, parts: list[str]) -> None:
        """Forgets all segments but ``parts``."""
        old = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        n_links = np.array(self.n_links)
        long = n_links[old]
        stop = np.cumsum(long)
        pairs = np.array(self.pairs)[np.repeat((np.cumsum(n_links) - n_links)[old] - stop + long, long) + np.arange(int(long.sum()))]
        text = list(map(self.text.__getitem__, old.tolist()))
        counts = [np.array(held)[old] for held in (self.n_a, self.n_b, self.n_groups, self.n_links)]
        self._forget()
        self._note(parts, *counts, text)
        self.pairs.frombytes(pairs.tobytes())

    def learn(self, parts: list[str]) -> None:
        """Aligns new segments, one behind the other as if they were one text: both lists have an end behind each."""
        spaced = [" " + part for part in parts]
        whole = [part.encode() for part in spaced]
        a = [encoding.ids for encoding in self.first.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.second.encode(parts, num_threads=1)
        raw_a, raw_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        if b"".join(map(raw_a, chain(*a))) != b"".join(whole) or b"".join(map(raw_b, chain(*b))) != b"".join(whole):
            good = [b"".join(map(raw_a, x)) == own == b"".join(map(raw_b, y)) for own, x, y in zip(whole, a, b)]
            for part, same in zip(parts, good):
                if not same:
                    self._note([part], [0], [0], [0], [0], [None])
            parts, whole, a, b = (list(compress(x, good)) for x in (parts, whole, a, b))
        if not parts:
            return
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        flat_a, flat_b = np.fromiter(chain(*a), np.int64, n_a.sum()), np.fromiter(chain(*b), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        last = np.cumsum(list(map(len, whole)))
        common, upto_a, upto_b = cut_groups(ends_a, ends_b)
        n_groups = np.diff(np.searchsorted(common, last, "right"), prepend=0)
        link_a, link_b, ends = linked(ends_a, ends_b)
        n_links = np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        names_a, names_b = list(map(self.names_a.__getitem__, flat_a.tolist())), list(map(self.names_b.__getitem__, flat_b.tolist()))
        from_a, from_b = [0, *upto_a.tolist()], [0, *upto_b.tolist()]
        groups = [f"{names_a[i]}|{names_b[k]}" if j - i == m - k == 1 else f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}"
                  for i, j, k, m in zip(from_a, from_a[1:], from_b, from_b[1:])]
        stop = np.cumsum(n_groups).tolist()
        text = [";".join(groups[i:j]).encode() for i, j in zip([0, *stop], stop)]
        self._note(parts, n_a, n_b, n_groups, n_links, text)
        self.pairs.frombytes(((flat_a[link_a] << 32) | flat_b[link_b]).tobytes())

    def _note(self, parts: list[str], n_a, n_b, n_groups, n_links, text: list[bytes | None]) -> None:
        self.number.update(zip(parts, range(len(self.text), len(self.text) + len(parts))))
        for held, values in zip((self.n_a, self.n_b, self.n_groups, self.n_links), (n_a, n_b, n_groups, n_links)):
            held.frombytes(np.asarray(values, np.int64).tobytes())
        self.text += text

    def bundle(self, texts: list[str]) -> tuple:
        """Rows of the texts of a bundle, their distinct pairs by place and how often, then the bundle's pairs and how many texts hold each."""
        cut = [segments(text) if text else [] for text in texts]
        asked = set().union(*cut)
        new = list(asked.difference(self.number))
        if len(self.number) + len(new) > REMEMBERED:  # those that come again stay
            self._keep(list(asked.intersection(self.number)))
        del asked
        for k in range(0, len(new), TOGETHER):
            self.learn(new[k : k + TOGETHER])
        numbers = [list(map(self.number.__getitem__, parts)) for parts in cut]
        del cut, new
        text = self.text
        written_groups: list[str] = []
        for k, own in enumerate(numbers):
            found = list(map(text.__getitem__, own))
            if not own or None in found:
                numbers[k] = []  # the bytes of one of the vocabularies are not those of the text
                written_groups.append("")
            else:
                written_groups.append(hashlib.sha256(b";".join(found)).hexdigest())
        size = np.array([len(own) for own in numbers], np.int64)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(size.sum()))
        del numbers
        row = np.repeat(np.arange(len(texts)), size)
        sums = [np.bincount(row, np.array(held)[flat], len(texts)).astype(np.int64) for held in (self.n_a, self.n_b, self.n_groups, self.n_links)]
        # each segment of a text once, with how often it comes
        width = len(self.text)
        keys, times = np.unique(row * width + flat, return_counts=True)
        row, segment = keys // width, keys % width
        n = np.array(self.n_links)
        first = np.cumsum(n) - n
        long = n[segment]
        at = np.repeat(first[segment] - np.cumsum(long) + long, long) + np.arange(int(long.sum()))
        codes, place = np.unique(np.array(self.pairs)[at], return_inverse=True)
        keys, place = np.unique(np.repeat(row, long) * max(1, len(codes)) + place, return_inverse=True)
        often = np.bincount(place, np.repeat(times, long), len(keys)).astype(np.int64)
        row, place = keys // max(1, len(codes)), keys % max(1, len(codes))
        held = np.bincount(place, minlength=len(codes))
        return sums, written_groups, np.searchsorted(row, np.arange(len(texts) + 1)), place, often, codes, held


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > BUNDLE_BYTES:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def aligned(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """A row per document: bundle, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and, by place in
    the bundle's list, its distinct id pairs and how often each is linked. The first row of a bundle
    holds that list and the number of the bundle's documents with each pair."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = _aligners.get((byte_vocabulary, piece_vocabulary)) or _aligners.setdefault(
            (byte_vocabulary, piece_vocabulary), Aligner(byte_vocabulary, piece_vocabulary))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("text")
            for a, b in _runs(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = [text or "" for text in column.slice(a, b - a).to_pylist()]
                sums, sha, first, place, often, codes, held = using.bundle(texts)
                lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))  # noqa: E731, B023
                once = lambda values, kind: pa.array([values, *[None] * (b - a - 1)], pa.list_(kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(b - a, number), pa.int64()), batch.column("doc_id").slice(a, b - a), *(pa.array(s, pa.int64()) for s in sums),
                    pa.array(sha, pa.string()), lists(place, pa.int32()), lists(often, pa.int32()), once(codes, pa.int64()), once(held, pa.int32()),
                ], names=["bundle", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "codes", "held"])
                number += 1

    return docs.select("doc_id", "text").mapInArrow(
        run, f"bundle bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs array<int>, times array<int>, codes array<bigint>, held array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """code, n_docs and best (whether no pair of the same first id is in more documents) of every id pair."""
    own = rows.filter("codes is not null").select(F.explode(F.arrays_zip("codes", "held")).alias("p"))
    counted = own.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.held").cast("bigint").alias("n_docs"))
    # a first id has at most as many rows as the second vocabulary has ids
    most = F.max("n_docs").over(W.partitionBy(F.shiftrightunsigned("code", 32)))
    return counted.withColumn("best", F.col("n_docs") == most)


def alignment_report(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A null or empty text has no tokens, nor has one whose bytes either vocabulary does not
    give back: zeros, and an empty groups_sha256. Repeated rows count as documents of their
    own, ties for the highest count all count as best, a null doc_id gives a row, other
    columns are ignored, no rows give no rows. A very long text is a bundle of its own.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    rows = written(aligned(docs, byte_vocabulary, piece_vocabulary), "aligned")
    held = rows.filter("codes is not null").select("bundle", F.posexplode("codes").alias("place", "code"))
    looked = held.join(pair_counts(rows), "code").select(F.col("bundle").alias("of"), "place", "n_docs", "best")

    def sums(own: pa.Table, counts: pa.Table) -> pa.Table:
        size = counts.num_rows + 1
        n_docs, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = counts.column("place").to_numpy()
        n_docs[place], best[place] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        pairs, times = (own.column(name).combine_chunks() for name in ("pairs", "times"))
        place, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
        total = []
        for values in (best, n_docs):
            through = np.concatenate([[0], np.cumsum(values[place] * often)])
            total.append(pa.array(through[ends[1:]] - through[ends[:-1]], pa.int64()))
        kept = [own.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*kept, *total, own.column("groups_sha256")], names=[
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.drop("codes", "held").groupBy("bundle").cogroup(looked.groupBy("of")).applyInArrow(
        sums, f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
