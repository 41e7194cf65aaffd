"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

A text with its spaces written as marks starts as single characters. The agenda holds each
adjacent pair that is a piece of the vocabulary, best score first and leftmost among equals;
the pair on top is merged and its neighbours form new pairs, until none is left. Characters
that are no piece fall back to their bytes. Short segments of a batch go through together,
an agenda per row of a matrix; a long one has a heap. Every segment is also encoded by the
library, a whole Arrow batch at a time, and the two are compared.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallystone.llm.tokencounts import safe_parts

SLICE_CHARS = 1 << 20  # characters of texts handled at once; a longer text goes alone
REMEMBERED = 400_000  # segments whose ids a task remembers
LONG = 40  # a longer segment is cut where no piece can cross; what is still longer has a heap
ROWS = 8192  # segments that go through the agenda together
MARK = "▁"

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_coders: dict[str, "PieceCoder"] = {}


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class PieceCoder:
    """Ids of texts and texts of ids under a merge-type vocabulary with byte fallback.

    Refuses, by ValueError, vocabularies of another type, with a normaliser, or with pieces
    that users defined or that are unused.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        normaliser = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError(f"{model} is not a merge-type vocabulary with byte fallback")
        if normaliser.precompiled_charsmap or spec.denormalizer_spec.precompiled_charsmap or (
                normaliser.remove_extra_whitespaces or not normaliser.add_dummy_prefix or not normaliser.escape_whitespaces):
            raise ValueError(f"{model} changes texts before it encodes them")
        if {p.type for p in spec.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{model} holds pieces that are user-defined or unused")
        self.end = self.library.eos_id()
        self.pieces = [(p.piece, p.type) for p in spec.pieces]
        self.ids = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:-1], 16): k for k, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.bytes = {k: b for b, k in self.byte_ids.items()}
        self.joined = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        if any(pair[1] == MARK and pair[0] != MARK for pair in self.joined):
            raise ValueError(f"{model} holds pieces that run over a space")
        self.raw = [bytes([self.bytes[k]]) if k in self.bytes else piece.replace(MARK, " ").encode() for k, (piece, _) in enumerate(self.pieces)]
        self.names = [b"%d" % k for k in range(len(self.pieces))]
        self._tables()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()

    def _tables(self) -> None:
        """Symbols as numbers: pieces by id, other characters of pieces behind them, all others negative."""
        single = {c for piece in self.ids for c in piece}
        extra = sorted(c for c in single if c not in self.ids)
        number = self.ids | {c: len(self.pieces) + k for k, c in enumerate(extra)}
        self.extra = extra
        self.symbol = -2 - np.arange(0x110000, dtype=np.int32)
        for c in single:
            self.symbol[ord(c)] = number[c]
        self.base = len(self.pieces) + len(extra)
        splits = [(number[piece[:k]] * self.base + number[piece[k:]], joined, self.rank[piece]) for piece, joined in self.ids.items()
                  for k in range(1, len(piece)) if piece[:k] in number and piece[k:] in number]
        splits.sort()
        self.pairs, self.into, self.order = (np.array(x, kind) for x, kind in zip(zip(*splits), (np.int64, np.int32, np.float64)))

    def _noted(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols the rank, infinite where they join to no piece, and what they join to."""
        wanted = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.order[at], np.inf), self.into[at]

    def merged_all(self, runs: list[str]) -> list[list[int]]:
        """``merged`` of many short runs: in each turn every run takes the top of its agenda."""
        out: list = [None] * len(runs)
        by_length = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        for start in range(0, len(runs), ROWS):
            rows = np.array(by_length[start : start + ROWS])
            width = len(runs[rows[-1]])
            size = np.array([len(runs[k]) for k in rows])
            text = "".join([runs[k].ljust(width) for k in rows])
            symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)].reshape(len(rows), width)
            symbols[np.arange(width) >= size[:, None]] = -1
            rank, into = self._noted(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                going = np.zeros(len(rows), bool)
                if rank.shape[1]:
                    top = rank.argmin(axis=1)  # the leftmost of equals
                    going = rank[np.arange(len(rows)), top] < np.inf
                self._finish(out, rows[~going], symbols[~going])
                rows, symbols, rank, into = rows[going], symbols[going], rank[going], into[going]
                if not len(rows):
                    break
                top, each = top[going], np.arange(len(rows))
                joined = into[each, top]
                columns = np.arange(symbols.shape[1] - 1)
                symbols = np.take_along_axis(symbols, columns + (columns > top[:, None]), 1)
                symbols[each, top] = joined
                columns = columns[:-1]
                keep = columns + (columns >= top[:, None])
                rank, into = np.take_along_axis(rank, keep, 1), np.take_along_axis(into, keep, 1)
                before = np.flatnonzero(top > 0)
                at = top[before]
                rank[before, at - 1], into[before, at - 1] = self._noted(symbols[before, at - 1], joined[before])
                after = np.flatnonzero(top < symbols.shape[1] - 1)
                at = top[after]
                rank[after, at], into[after, at] = self._noted(joined[after], symbols[after, at + 1])
        return out

    def _finish(self, out: list, rows: np.ndarray, symbols: np.ndarray) -> None:
        there = symbols != -1
        flat, ends = symbols[there].tolist(), np.cumsum(there.sum(axis=1)).tolist()
        plain = ((symbols >= -1) & (symbols < len(self.pieces))).all(axis=1).tolist()
        begin = 0
        for row, end, easy in zip(rows.tolist(), ends, plain):
            ids = flat[begin:end]
            if not easy:
                ids = [i for s in ids for i in ([s] if 0 <= s < len(self.pieces) else self._bytes_of(
                    self.extra[s - len(self.pieces)] if s >= 0 else chr(-2 - s)))]
            out[row] = ids
            begin = end

    def _bytes_of(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()]

    def runs(self, part: str) -> list[str]:
        """A segment with its marks, a long one in parts that no merge can join: no piece holds the two characters at a cut."""
        escaped = MARK + part.replace(" ", MARK)
        if len(escaped) <= LONG:
            return [escaped]
        cuts = [k for k in range(1, len(escaped)) if escaped[k - 1 : k + 1] not in self.joined]
        return [escaped[a:b] for a, b in zip([0, *cuts], [*cuts, len(escaped)])]

    def merged(self, run: str) -> list[int]:
        """Ids of one run of characters, by the agenda."""
        rank, symbols, n = self.rank, list(run), len(run)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[pair], k, k + 1, pair) for k, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in rank]
        heapify(agenda)
        while agenda:
            _, left, right, pair = heappop(agenda)
            # both sides must be as they were when the pair was noted
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                joined = pair + symbols[following]
                if joined in rank:
                    heappush(agenda, (rank[joined], left, following, joined))
            ahead = before[left]
            if ahead >= 0:
                joined = symbols[ahead] + pair
                if joined in rank:
                    heappush(agenda, (rank[joined], ahead, left, joined))
        found: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                if known is not None:
                    found.append(known)
                else:
                    found += self._bytes_of(symbol)
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        return [i for ids in self.segments(safe_parts(text)) for i in ids] if text else []

    def segments(self, parts: list[str]) -> list[list[int]]:
        """Ids of each segment of a cut text, the space before it included."""
        cut = [self.runs(part) for part in parts]
        runs = [run for some in cut for run in some]
        short = [k for k, run in enumerate(runs) if len(run) <= LONG]
        found: list = [None] * len(runs)
        for k, ids in zip(short, self.merged_all([runs[k] for k in short])):
            found[k] = ids
        at = iter([self.merged(run) if ids is None else ids for run, ids in zip(runs, found)])
        return [next(at) if len(some) == 1 else [i for _ in some for i in next(at)] for some in cut]

    def surface(self, ids: list[int], start: bool = False) -> str:
        """The text of ids; at the start of a text the mark put before it is taken away.

        Runs of byte pieces are read as UTF-8, each byte that is none as U+FFFD.
        """
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "each_byte"))
                held.clear()
                start = False
            piece, kind = self.pieces[i]
            if kind == _CONTROL:
                continue
            if kind == _UNKNOWN:
                out.append(" ⁇ ")
                start = False
                continue
            if start and piece[:1] == MARK:
                piece = piece[1:]
            start = False
            out.append(piece.replace(MARK, " "))
        out.append(held.decode("utf-8", "each_byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.surface(ids, start=True)

    def learn(self, parts: list[str]) -> None:
        """Ids of new segments by the agenda, beside the library's for the whole batch; where the two
        differ, the library's stand and the segment is noted as odd."""
        raw, names = self.raw.__getitem__, self.names.__getitem__
        for part, ids, checked in zip(parts, self.segments(parts), self.library.encode(parts, num_threads=1)):
            if ids == checked:
                text = b"".join(map(raw, ids))  # what was encoded is made of whole characters
            else:
                text = self.surface(checked).encode()
                self.odd.add(part)
            self.known[part] = b" ".join(map(names, checked)), text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, bool]]:
        """Of each text: number of ids with the end id, digest of the ids, digest of the text they decode to, agreement."""
        cut = [safe_parts(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.odd = {}, set()
        self.learn(list(set().union(*cut).difference(self.known)))
        end, known, out = self.names[self.end], self.known.__getitem__, []
        for parts in cut:
            found = list(map(known, parts))
            ids = b" ".join([f[0] for f in found] + [end])
            text = b"".join([f[1] for f in found])[1:]  # without the space put before a text
            out.append((ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), self.odd.isdisjoint(parts)))
        return out


def coder(model: str) -> PieceCoder:
    return _coders.get(model) or _coders.setdefault(model, PieceCoder(model))


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``SLICE_CHARS`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > SLICE_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """All columns of ``docs`` and ``ids``: the ids of each whole text with an end id.

    Null and empty texts have the end id alone. A column ``ids`` of ``docs`` is replaced.
    """
    text = docs.columns.index("text")
    kept = [name for name in docs.columns if name.lower() != "ids"]
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    places = [docs.columns.index(name) for name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = coder(model)
        for batch in batches:
            ids = [[*using.encode(t or ""), using.end] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in places), pa.array(ids, pa.list_(pa.int32()))], names=[*(f"c{k}" for k in places), "ids"])

    fields = ", ".join(f"c{k} {plain.schema[k].dataType.simpleString()}" for k in places)
    return plain.mapInArrow(run, f"{fields}, ids array<int>").toDF(*kept, "ids")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and ``text`` of rows that hold ``ids``; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = coder(model)
        for batch in batches:
            texts = [None if ids is None else using.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and agenda_agrees of every row of ``docs``.

    Texts are encoded whole, with an end id only, and the ids decoded again. A null or empty
    text is the end id alone and decodes to the empty text. A null doc_id and repeated rows
    give a row each, other columns are ignored, no rows give no rows. Texts of any length
    are cut where no piece can cross, so memory follows the longest run without such a place
    beside the text itself. Ties of score go to the leftmost pair. agenda_agrees is false
    where the library found other ids, which then stand in the row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = coder(model)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            rows = [row for some in slices(texts) for row in using.digests(some)]
            n, ids, back, agrees = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), pa.array(agrees, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agenda_agrees"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agenda_agrees boolean")
