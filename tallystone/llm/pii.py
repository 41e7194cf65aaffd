"""Personal data behind disguises, with offsets into the text as it was.

A chain of transducers rewrites a text and keeps, for every character written, the span of
the source it stands for. The first turns homoglyphs, wide and styled characters into
ASCII and drops invisible ones; the second turns spelled digits into digits; the third
turns disguised at signs and dots into the signs. Identifiers are sought in the text as it
was and in what the chain wrote, and spans of the latter are mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallystone.llm.store import map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: before each at sign the longest local part behind the last match."""
    done = 0
    for match in _DOMAIN.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield start, done


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def find_spans(text: str) -> list[Span]:
    """Identifiers of the four kinds, leftmost and not overlapping within a kind."""
    spans: list[Span] = []
    if "@" in text:
        spans.extend(("email", a, b) for a, b in _emails(text))
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            spans.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = _DIGITS.sub("", match[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", match[0])) <= 15:
                spans.append(("phone", *match.span()))
    return spans


# Letters of other scripts that look like the Latin letter beside them.
LOOKALIKES = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κк",
    "l": "ӏⅼ", "m": "мⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս",
    "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "-": "‐‑‒–—―−﹣", ".": "․。｡·∙•‧", "@": "﹫", "+": "﹢",
}
# Characters that show nothing.
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
# Digits from zero to nine in the four languages of the documents.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)

_ASCII = {ord(c): a for a, many in LOOKALIKES.items() for c in many} | {ord(c): "" for c in INVISIBLE}
_SPELLED = {word: str(n) for words in DIGIT_WORDS for n, word in enumerate(words.split())} | {"oh": "0", "plus": "+"}
_STRANGE = re.compile(r"[^\x00-\x7f¡-¬®-±´-¶¸º-ɏ‘-‟]")

_SIGN = r"(?:[\[({<]\s{0,3}%s\s{0,3}[\])}>]|(?<=[\s\w])[_*-]%s[_*-](?=\w))"
_AT_WORDS, _DOT_WORDS = r"(?:at|arroba|@)", r"(?:dot|punkt|point|punto|\.)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})"
_AT = rf"\s{{0,3}}{_SIGN % (_AT_WORDS, 'at')}\s{{0,3}}"
_DOT = rf"\s{{0,3}}{_SIGN % (_DOT_WORDS, 'dot')}\s{{0,3}}"
_DOT_BARE = rf"(?:{_DOT}|\s{{1,3}}(?:dot|punkt|point|punto)\s{{1,3}})"
_BRACKET_AT = re.compile(_AT, re.I)
_ANY_DOT = re.compile(_DOT, re.I)
# A disguised address has the greatest lengths of mail: 64 characters before the sign, labels of 63. So
# each sign is tried for a bounded number of steps. Addresses in plain sight have no such bound.
USER_CHARS = 64
_LABELS = rf"{_LABEL}(?:\.{_LABEL}){{0,8}}"
_ANY_AT = re.compile(rf"\s{{1,3}}(?:at|arroba|@)\s{{1,3}}|{_AT}|@", re.I)
_DOTTED = re.compile(rf"{_LABELS}(?:{_DOT_BARE}{_LABELS}){{1,8}}", re.I)
_WORD_AT = re.compile(r"\s{1,3}at\s{1,3}|\s{1,3}@\s{0,3}|@\s{1,3}", re.I)
_PLAIN = re.compile(rf"{_LABELS}\.[A-Za-z]{{2,24}}\b", re.I)
_DOT_WORD = re.compile(_DOT_BARE, re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT_BARE}|\s{{0,3}}\.\s{{0,3}})(?=[0-9])", re.I)
_SPELL = "|".join(sorted(_SPELLED, key=len, reverse=True))
_GAP, _SPOKEN_DOT = r"[\s,.\-]{1,3}", r"(?:(?:dot|punkt|point|punto)\s{1,3})?"
_RUN = rf"(?:{_SPELL})(?:{_GAP}{_SPOKEN_DOT}(?:{_SPELL})){{2,}}"
_SPELLED_RUN = re.compile(rf"(?<!\w){_RUN}(?:{_GAP}{_SPOKEN_DOT}(?:{_SPELL}|[0-9]+))*(?!\w)", re.I)
Edits = list[tuple[int, int, str]]


class Rewritten:
    """A text with, for each of its characters, the span of the source it stands for."""

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        self.text = text
        self.first = np.arange(len(text)) if first is None else first
        self.last = np.arange(1, len(text) + 1) if last is None else last

    def apply(self, edits: Edits) -> Rewritten:
        """The text with each (start, end, replacement) made; edits are in order and apart."""
        if not edits:
            return self
        parts, first, last, at = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            first += [self.first[at:start], np.full(len(new), self.first[start] if start < end else 0)]
            last += [self.last[at:start], np.full(len(new), self.last[end - 1] if start < end else 0)]
            at = end
        parts.append(self.text[at:])
        first.append(self.first[at:])
        last.append(self.last[at:])
        return Rewritten("".join(parts), np.concatenate(first), np.concatenate(last))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.last[end - 1])


def _plain(c: str) -> str:
    """ASCII that a character stands for; itself where there is none."""
    if ord(c) in _ASCII:
        return _ASCII[ord(c)]
    if c.isspace() and c not in "\x85  ":
        return " "
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    wide = unicodedata.normalize("NFKC", c)
    return "".join(_ASCII.get(ord(x), x) for x in wide) if len(wide) < 4 and all(ord(x) < 128 or ord(x) in _ASCII for x in wide) else c


def homoglyphs(text: str) -> Edits:
    return [(m.start(), m.end(), new) for m in _STRANGE.finditer(text) if (new := _plain(m[0])) != m[0]]


def spelled_digits(text: str) -> Edits:
    """Runs of at least three spelled digits: words to digits, gaps between them closed."""
    edits: Edits = []
    for run in _SPELLED_RUN.finditer(text):
        at = None
        for token in re.finditer(rf"(?:{_SPELL})(?!\w)|[0-9]+|(?:dot|punkt|point|punto|\.)", run[0], re.I):
            start, end = run.start() + token.start(), run.start() + token.end()
            if at is not None and start > at:
                edits.append((at, start, ""))
            word = token[0].lower()
            new = _SPELLED.get(word, token[0] if token[0][0].isdigit() else ".")
            if new != token[0]:
                edits.append((start, end, new))
            at = end
    return edits


def _user(text: str, done: int, at: int) -> str:
    """The longest user name before a sign that begins no earlier than ``done`` and not inside a word."""
    first = None
    start = at
    while start > max(done, at - USER_CHARS) and text[start - 1] in _LOCAL:
        start -= 1
        before = text[start - 1 : start]
        if not (before.isalnum() or before in ("_", ".")) or not before:
            first = start
    return "" if first is None else text[first:at]


def _addresses(text: str, sign: re.Pattern, domain: re.Pattern, odd: bool = False) -> Iterator[tuple[re.Match, re.Match]]:
    """Signs between a user name and a domain; the name holds more than letters if ``odd``."""
    done = 0
    for at in sign.finditer(text):
        if at.start() >= done and (user := _user(text, done, at.start())) and not (odd and user.isalpha()):
            found = domain.match(text, at.end())
            if found:
                done = found.end()
                yield at, found


def at_and_dot(text: str) -> Edits:
    """Bracketed signs, and bare words where a whole address stands around them."""
    edits = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)]
    edits += [(m.start(), m.end(), ".") for m in _ANY_DOT.finditer(text)]
    edits += [(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text) if m[0] != "."]
    for at, domain in _addresses(text, _ANY_AT, _DOTTED):
        if at[0] != "@":
            edits.append((*at.span(), "@"))
        edits += [(domain.start() + d.start(), domain.start() + d.end(), ".") for d in _DOT_WORD.finditer(domain[0])]
    edits += [(*at.span(), "@") for at, _ in _addresses(text, _WORD_AT, _PLAIN, odd=True)]
    kept: Edits = []
    for edit in sorted(set(edits), key=lambda e: (e[0], -e[1])):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept


# What a text must hold for the chain to change it, as a linear-time engine can tell.
TRIGGER = "(?i)" + "|".join((
    _STRANGE.pattern.replace("\\x00-\\x7f", r"\x{0}-\x{7f}"), _RUN, r"\b(?:dot|punkt|point|punto)\b",
    r"[\[({<_*-]\s{0,3}(?:at|arroba|dot|@|\.)\s{0,3}[\])}>_*-]", rf"[A-Za-z0-9._%+-]\s{{1,3}}at\s{{1,3}}{_LABEL}\.[A-Za-z0-9]",
    r"\s@", r"@\s", r"[0-9]\s{1,3}\.", r"\.\s{1,3}[0-9]",
))
# the engine's white space lacks some of Python's; what is not ASCII is found as strange
TRIGGER = TRIGGER.replace(r"[\s", "[<blank>").replace(r"\s", "[<blank>]").replace("<blank>", r"\s\x0b\x1c-\x1f")
CHAIN: tuple[Callable[[str], Edits], ...] = (homoglyphs, spelled_digits, at_and_dot)


def deobfuscated(text: str) -> Rewritten | None:
    """What the chain makes of a text; None where nothing changes."""
    now = Rewritten(text)
    for transducer in CHAIN:
        now = now.apply(transducer(now.text))
    return None if now.text == text else now


def all_spans(text: str, disguised: bool = True) -> tuple[list[Span], list[Span]]:
    """Spans of the text as it was, and those with what disguises added, by kind and start."""
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    base = sorted(find_spans(text), key=order)
    rewritten = deobfuscated(text) if disguised else None
    if rewritten is None:
        return base, base
    found = set(base)
    for kind, a, b in find_spans(rewritten.text):
        start, end = rewritten.source(a, b)
        if not any(k == kind and s <= start and end <= e for k, s, e in base):
            found.add((kind, start, end))
    return base, sorted(found, key=order)


def batch_spans(texts: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Each text of a batch with its spans; only texts that hold a trigger go through the chain."""
    texts = texts.fill_null("")
    marked = pc.match_substring_regex(texts, TRIGGER)
    for text, disguised in zip(texts.to_pylist(), marked.to_pylist()):
        yield text, *all_spans(text, disguised)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_disguised.

    ``spans`` lists kind:start:end by kind, then start, in code points of the whole text,
    end exclusive; the counts are of these. ``base_sha256`` is the digest of the same list
    without what only shows behind a disguise; ``n_disguised`` counts that. A null or empty
    text has no spans. Every row, repeated ones too, has a row; other columns are ignored.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, lists, more = [], [], []
            for _, base, spans in batch_spans(batch.column("text")):
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in spans))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                lists.append(_joined(spans))
                more.append(len(spans) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(lists, pa.string()), pa.array(more, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
              "spans string, n_disguised bigint")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets."""
    def hide(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                parts += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join(parts) + text[at:]

    def replace(batch: pa.RecordBatch, text: int) -> pa.RecordBatch:
        column = batch.column(text)
        texts = [hide(value, spans) for value, _, spans in batch_spans(column)]
        hidden = pa.array([t if known else None for t, known in zip(texts, column.is_valid().to_pylist())], pa.string())
        return batch.set_column(text, batch.schema.field(text), hidden)

    return map_rows(docs, replace)
