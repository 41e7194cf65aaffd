"""Piece encoding, token alignment and ranked search, held against the libraries and the definitions."""

import bisect
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallystone.llm import agenda, alignment, ranked
from test_packing_and_mixing import odd_texts
from test_words_and_links import documents, families

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def hexes(text):
    return hashlib.sha256(text.encode()).hexdigest()


def more_odd_texts(seed=9):
    rng = random.Random(seed)
    letters = ["a", "b", " ", "▁", "é", "\n", "\t", "x", "中", "🙂", "\r", ";", "  ", "<0x41>", "<s>", "\x1c", "\x85", " ", "'s", "1", "‍", "<|endoftext|>"]
    return odd_texts() + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 60, 300]))) for _ in range(400)] + [
        "ab" * 40_000, "z" * 5_000, " " * 3_000, "▁" * 3_000, "." * 5_000 + " x", "\n" * 500, "one two " * 20_000]


def rows_of(texts):
    return list(zip(range(len(texts)), texts, ["s"] * len(texts)))


def test_agenda_against_the_library():
    coder, library = agenda.PieceCoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in more_odd_texts():
        ids = library.encode(text or "")
        assert coder.encode(text or "") == ids
        assert [i for part in ([text] if text else []) for run in coder.runs(part) for i in coder.merged(run)] == ids  # the heap alone
        assert coder.decode([*ids, coder.end]) == library.decode([*ids, coder.end])


def test_any_ids_decode_as_in_the_library():
    coder, library, rng = agenda.PieceCoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, 28705]) for _ in range(rng.randrange(8))]
        assert coder.decode(ids) == library.decode(ids)


def test_piece_digests(spark):
    library, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), more_odd_texts()
    found = agenda.piece_digests(documents(spark, [*rows_of(texts), (None, "a b", "s"), (3, "a b", "s"), (3, "a b", "s")]), PIECES).collect()
    assert len(found) == len(texts) + 3 and all(r.agenda_agrees for r in found)
    for r in found[: len(texts)]:
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hexes(" ".join(map(str, ids))), hexes(library.decode(ids)))
    assert len({(r.n_tokens, r.ids_sha256) for r in found[len(texts):]}) == 1
    assert agenda.piece_digests(documents(spark, rows_of(["x"])).limit(0), PIECES).count() == 0


def test_ids_go_out_and_come_back(spark):
    texts = ["a b", None, "  x▁y ", "🙂", ""]
    ids = agenda.encoded(documents(spark, rows_of(texts)), PIECES)
    assert ids.columns == [*documents(spark, []).columns, "ids"]
    back = {r.doc_id: r.text for r in agenda.decoded(ids, PIECES).collect()}
    assert back == {k: (t or "").replace("▁", " ") for k, t in enumerate(texts)}


def test_a_differing_segment_takes_the_ids_of_the_library(monkeypatch):
    coder = agenda.PieceCoder(PIECES)
    monkeypatch.setattr(coder, "segments", lambda parts: [[5] for _ in parts])
    n, ids, text, agrees = coder.digests(["hello there"])[0]
    expected = [*coder.library.encode("hello there"), coder.end]
    assert (n, ids, text, agrees) == (len(expected), hexes(" ".join(map(str, expected))), hexes("hello there"), False)


def plain_alignment(texts):
    """By definition, on whole texts: groups and links of each, and the counts of all pairs."""
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    letters = bytes_of_letters()
    entry = {i: bytes(letters[c] for c in token) for token, i in first.get_vocab(with_added_tokens=False).items()}
    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        raw_a = [entry[i] for i in a]
        raw_b = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            rows.append(([], [], [], []))
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for token in raw:
                own.append((at, at + len(token)))
                at += len(token)
            spans.append(own)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        cut = [([], []) for _ in common]
        for side, (own, where) in enumerate(zip((a, b), spans)):
            for i, (s, _) in zip(own, where):
                cut[bisect.bisect_right(common, s)][side].append(i)
        linked, low = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while spans[1][low][1] <= s:
                low += 1
            at = low
            while at < len(b) and spans[1][at][0] < e:
                linked.append((i, b[at]))
                at += 1
        counts.update(set(linked))
        rows.append((a, b, cut, linked))
    return rows, counts


def bytes_of_letters():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


@pytest.mark.parametrize("chars", [200, 1 << 21])
def test_alignment_against_the_definition(spark, monkeypatch, chars):
    monkeypatch.setattr(alignment, "BUNDLE_BYTES", chars)
    texts = more_odd_texts() + [t for _, t, _ in families()]
    rows, counts = plain_alignment(texts)
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    found = {r.doc_id: r for r in alignment.alignment_report(documents(spark, rows_of(texts)), BYTES, PIECES).collect()}
    assert len(found) == len(texts)
    for k, (a, b, cut, linked) in enumerate(rows):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in cut)
        r = found[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(cut), len(linked)), texts[k]
        assert r.groups_sha256 == (hexes(text) if a else "")
        assert r.count_sum == sum(counts[x] for x in linked)
        assert r.n_best == sum(counts[x] == best[x[0]] for x in linked)


def test_an_aligner_keeps_only_segments_that_come_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 60)
    bundles = [[f"the whole {k} of it bytes{k * 7 + i} \u0301x" for i in range(40)] for k in range(6)] + [more_odd_texts()]
    using = alignment.Aligner(BYTES, PIECES)
    for k, texts in enumerate(bundles):
        held = using.number.keys() & {"the", "whole", "it"}
        learned, learn = [], alignment.Aligner.learn
        monkeypatch.setattr(alignment.Aligner, "learn", lambda self, parts: (learned.extend(parts), learn(self, parts)))
        found = using.bundle(texts)
        monkeypatch.setattr(alignment.Aligner, "learn", learn)
        assert not held & set(learned) and len(held) == (3 if k else 0)
        assert len(using.number) <= 60 + len(set(learned)) and len(using.text) == len(using.number)
        for x, y in zip(found, alignment.Aligner(BYTES, PIECES).bundle(texts)):
            assert np.array_equal(np.asarray(x), np.asarray(y))


def test_alignment_of_odd_tables(spark):
    docs = documents(spark, [(None, "a b", "s"), (1, None, "s"), (1, "a b", "s"), (1, "a b", None)])
    found = sorted(alignment.alignment_report(docs, BYTES, PIECES).collect(), key=lambda r: (r.n_a, r.doc_id is None))
    assert [r.doc_id for r in found] == [1, 1, 1, None] and [r.count_sum for r in found] == [0, 6, 6, 6]
    assert alignment.alignment_report(docs.limit(0), BYTES, PIECES).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k=20):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        wanted, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for doc, own in counted:
            n, score = sum(own.values()), 0
            for term, times in wanted.items():
                if own[term]:
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    score += times * w * ((1000000000 * own[term]) // (1000 * own[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        rows += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("slice_rows, owners, bundle", [(7, 3, 5), (4096, 4, 256), (50, 1, 1)])
def test_ranked_search_against_the_definition(spark, monkeypatch, slice_rows, owners, bundle):
    monkeypatch.setattr(ranked, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(ranked, "BUNDLE_ITEMS", bundle)
    rng = random.Random(7)
    texts = [t for _, t, _ in families(n=30)] + [None, "", "...", "É é e", "a-b_c A1b2", "x" * 50_000, "common " * 30_000, "中 文", "\x00 nul"]
    docs = rows_of(texts) + [(5, texts[5], "s"), (5, texts[5], "s"), (None, texts[12], "s")]
    items = [(k, " ".join(rng.sample(TERM.findall((texts[rng.randrange(len(texts) - 9)] or "none here").translate(LOWER)), 4) if k % 2 else "common É a1B2 a b 中".split()))
             for k in range(11)] + [(50, None), (51, ""), (52, "absentword"), (53, "common common a"), (54, texts[20])]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    found = ranked.ranked_search(documents(spark, docs), table, owners=owners)
    assert found.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r)[:4] for r in found.collect()], key=str) == plain_search([(i, t) for i, t, _ in docs], items)


def test_ranked_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_CHARS", 120)
    texts = [t for _, t, _ in families(n=12)]
    items = [(k, " ".join((t or "").split()[:6])) for k, t in enumerate(texts[8:14])]
    found = ranked.ranked_search(documents(spark, rows_of(texts)), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted([tuple(r)[:4] for r in found.collect()], key=str) == plain_search(list(enumerate(texts)), items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = documents(spark, rows_of(["a b"])), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked.ranked_search(docs.limit(0), items).count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0
