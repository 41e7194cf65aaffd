"""Best-fit packing: documents become token pieces, pieces fill sequences by bin completion.

Only lengths decide a packing, so a group of pieces is packed as counts per length. Best
fit by decreasing length gives the first solution. Where it needs more sequences than the
total length does, branch and bound packs its sequences anew, in blocks of the loosest ones
that grow until none is left out: it completes one sequence after the other around the
largest piece left, with the undominated fillings of the space beside it, and gives up a
branch once its waste exceeds what a solution with one sequence less could waste.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.store import written

CAPACITY = 4096
END = 1
GROUP = 16_384  # pieces packed together; whole groups are spread over tasks
EFFORT = 100  # steps that the search may take for each sequence of a block
SLICE_CHARS = 1 << 20
REMEMBERED = 400_000  # words whose ids a task remembers
MARK = "<|endoftext|>"
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts, each word encoded once while it is remembered.

    The tokenizer drops white space before it splits, so words between spaces or line ends
    are independent of each other. Letters are plain if the tokenizer says that they stay as
    they are, or as their small form, and are split from a full stop or comma behind them;
    a word ends before these, and words of plain letters go straight to the merges.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        self.known: dict[str, bytes] = {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {c: as_bytes.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        small = [c for c in _LETTERS if self._plain(c, letters[c])]
        large = [c.upper() for c in small if len(c.upper()) == 1 and c.upper().lower() == c and self._normal(c.upper()) == c]
        self.letters = {ord(c): letters[c] for c in small}
        plain = re.escape("".join([*small, *large])) or r"\0"
        self.direct = re.compile(f"[{plain}]+").fullmatch
        self.tails = re.compile(f"(?<=[{plain}])([.,]+)(?=[ \\n]|\\Z)")

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _plain(self, c: str, letter: str) -> bool:
        """Whether a letter stays in a word of letters, and a full stop or comma behind it does not."""
        def split(text: str) -> list[str]:
            return [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self._normal(text))]

        return split(c + c) == [letter + letter] and split(c + ".") == [letter, "."] and split(c + ",") == [letter, ","]

    def _encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        model, letters = self.tokenizer.model, self.letters
        other = []
        for word in words:
            if self.direct(word):
                yield word, array("I", [token.id for token in model.tokenize(word.lower().translate(letters))]).tobytes()
            else:
                other.append(word)
        yield from zip(other, self._tokenizer_ids(other))

    def _tokenizer_ids(self, words: list[str]) -> list[bytes]:
        """Many words in one text, with a special token between them."""
        out = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            if self.mark is None or any("<|" in word for word in part):
                encoded = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in part]
                out.extend(np.array(ids, "<u4").tobytes() for ids in encoded)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast(
                [f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            ends = [*(marks * 4).tolist(), len(raw)]
            out.extend(raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        words = [self.tails.sub(r" \1", text).replace("\n", " ").split(" ") for text in texts]
        known = self.known
        known.update(self._encode(list(set().union(*words).difference(known))))
        return [b"".join(map(known.__getitem__, w)) for w in words]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > SLICE_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def token_ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of every text, without special tokens."""
    encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
    for a, b in _slices(texts):
        yield from encoder.ids(texts[a:b])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with ``ids`` if asked for.

    A document is its ids and an end id; one longer than ``capacity`` is cut there. A null
    or empty text is one piece that holds the end id.
    """
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for k, raw in enumerate(token_ids(texts, tokenizer)):
                raw += end
                for start in range(0, len(raw) // 4, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((k, start // capacity, start, len(part) // 4, zlib.crc32(part), part))
            which, piece, start, length, crc, part = zip(*rows) if rows else [[]] * 6
            columns = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(part, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def best_fit(counts: list[int], capacity: int) -> list[list[int]]:
    """Best fit by decreasing length: each piece into the fullest sequence that still takes it."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, bins = 0, []
    for size in range(capacity, 0, -1):
        for _ in range(counts[size]):
            room = spaces >> size
            if room:
                space = size + (room & -room).bit_length() - 1
                at = by_space[space].pop()
                if not by_space[space]:
                    spaces &= ~(1 << space)
                bins[at].append(size)
            else:
                at, space = len(bins), capacity
                bins.append([size])
            by_space[space - size].append(at)
            spaces |= 1 << (space - size)
    return bins


def _undominated(filling: tuple[int, ...], slack: int, available: int) -> bool:
    """No piece left out could take the place of any set of pieces of the filling and fill more.

    ``available`` has a bit for each length of which pieces are left out. The bits of the
    sums of all sets of the filling, each moved on by one up to ``slack``, are the lengths of
    pieces that could.
    """
    if not slack:
        return True
    sums = 1
    for size in filling:
        sums |= sums << size
    reach, width = sums << 1, 1
    while width < slack:
        step = min(width, slack - width)
        reach |= reach << step
        width += step
    return not reach & available


class _Left:
    """Pieces that are in no sequence yet: how many of each length, a bit for each length, and their number."""

    def __init__(self, counts: list[int]) -> None:
        self.counts, self.n = list(counts), sum(counts)
        self.bits = sum(1 << size for size, n in enumerate(counts) if n and size)

    def take(self, sizes: Iterable[int]) -> None:
        for size in sizes:
            self.n -= 1
            self.counts[size] -= 1
            if not self.counts[size]:
                self.bits &= ~(1 << size)

    def give(self, sizes: Iterable[int]) -> None:
        for size in sizes:
            self.n += 1
            self.counts[size] += 1
            self.bits |= 1 << size


def fillings(space: int, left: _Left, most: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated sets of pieces that leave at most ``most`` of ``space``, larger pieces first.

    What is left must be as it was whenever the next one is asked for. Between fillings it
    gives None for every step of the search, so that steps can be counted.
    """
    def extend(space: int, limit: int, chosen: tuple[int, ...], most: int) -> Iterator[tuple[int, ...] | None]:
        yield None
        fits = left.bits & ((2 << min(space, limit)) - 1)
        if not fits:
            if space <= most:
                left_out = left.bits
                for size in set(chosen):
                    if left.counts[size] == chosen.count(size):
                        left_out &= ~(1 << size)
                if _undominated(chosen, space, left_out):
                    yield chosen
            return
        size = fits.bit_length() - 1
        held = left.counts[size]
        for n in range(min(held, space // size), -1, -1):
            # a piece left out must not fit into what stays free
            yield from extend(space - n * size, size - 1, chosen + (size,) * n, most if n == held else min(most, size - 1))

    return extend(space, space, (), most)


def bin_completion(counts: list[int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[list[int]]:
    """Sequences as lists of lengths, as few as the search finds.

    Best fit is the incumbent. While it needs more sequences than the total length does,
    branch and bound packs its loosest sequences anew: first the fewest whose waste could
    save one, then four times as many, until all of them were packed together or the bound is
    met. ``effort`` bounds the steps for each sequence; beyond it the best solution so far
    stands. All pieces are always packed.
    """
    best = best_fit(counts, capacity)
    least = math.ceil(sum(size * n for size, n in enumerate(counts)) / capacity)
    best.sort(key=sum)
    block = 0
    while block < len(best) and len(best) > least:
        if not block:
            wasted = 0
            while wasted < capacity and block < len(best):
                wasted += capacity - sum(best[block])
                block += 1
        else:
            block = min(len(best), 4 * block)
        loose, kept = best[:block], best[block:]
        again = [0] * (capacity + 1)
        for sizes in loose:
            for size in sizes:
                again[size] += 1
        found = _branch_and_bound(again, loose, capacity, effort * block)
        if len(found) < len(loose):
            best, block = sorted(kept + found, key=sum), 0
    return best


def _branch_and_bound(counts: list[int], best: list[list[int]], capacity: int, steps: int) -> list[list[int]]:
    """``best``, or as soon as one is found a solution with fewer sequences."""
    left = _Left(counts)
    spare = (len(best) - 1) * capacity - sum(size * n for size, n in enumerate(counts))  # what one sequence less may waste
    stack: list[list] = []  # the largest piece of a sequence, its fillings not yet tried, the one chosen
    while spare >= 0:
        if not left.n:
            return [[first, *filling] for first, _, filling in stack]
        first = left.bits.bit_length() - 1
        left.take([first])
        stack.append([first, fillings(capacity - first, left, spare), None])
        while stack:  # the next filling of the deepest sequence that has one
            first, options, filling = stack[-1]
            if filling is not None:
                left.give(filling)
                spare += capacity - first - sum(filling)
            for filling in options:
                steps -= 1
                if filling is not None or steps < 0:
                    break
            else:
                filling = None
            if steps < 0:
                return best
            if filling is not None:
                left.take(filling)
                spare -= capacity - first - sum(filling)
                stack[-1][2] = filling
                break
            left.give([first])
            stack.pop()
        if not stack:
            break
    return best


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True)
    lengths = group["length"].to_numpy()
    counts = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate([[0], np.cumsum(counts)]).tolist()
    sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for number, sizes in enumerate(bin_completion(counts.tolist(), capacity)):
        at = 0
        for size in sizes:
            row = first[size]
            first[size] += 1
            sequence[row], offset[row] = number, at
            at += size
    return group.assign(sequence_id=group["pack"].astype("int64") * (1 << 32) + sequence, offset=offset).drop(columns="pack")


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` with sequence_id and offset; pieces of a sequence follow one another without gaps.

    Pieces are dealt by hash into groups of about ``group``, each packed by itself, which
    costs less than one sequence a group against packing all together. Repeated pieces are
    packed as often as they come; no pieces give no rows.
    """
    groups = max(1, math.ceil(cut.count() / group))
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    fields = ", ".join(f"{name} {kind}" for name, kind in cut.dtypes)

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            for _, rows in pd.concat(held, ignore_index=True).groupby("pack"):
                yield _pack_group(rows, capacity)

    # a task for each group: its rows are few bytes but work for a whole task
    return dealt.repartitionById(groups, "pack").mapInPandas(fill, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Where every piece of every document goes: see ``pieces`` and ``pack``.

    Empty tables give no rows, a null text counts as empty, a null doc_id and repeated rows
    give pieces of their own, and other columns are ignored.
    """
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity, group)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """sequence_id and its token ids: the packed training rows themselves."""
    packed = pack(written(pieces(docs, tokenizer, capacity, with_ids=True), "pieces"), capacity, group)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        return pd.DataFrame({
            "sequence_id": rows["sequence_id"].iloc[:1],
            "ids": [np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int32)],
        })

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(
        join, "sequence_id bigint, ids array<int>")
