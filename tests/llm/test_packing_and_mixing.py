"""Token counts, packing and mixing, held against plain encoders and the definitions."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tallystone.llm import mixing, packing, tokencounts
from test_words_and_links import WORD, documents, families

PIECES, WORD_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab ▁é\n①.,A'sé <") for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(300)]
    return texts + [None, "", " ", "  a  b ", "▁a ▁b", "<s> x </s>", "x<|endoftext|>y", "<|startoftext|>", "🙂 🙂  ​ z", "I'LL don't.", "ΣΑΣ ς", "İI", "Á e ́",
                    "\x00a b\x00", "word " * 9000, "y" * 70_000]


def test_token_counts(spark):
    encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    found = tokencounts.count_tokens(documents(spark, list(zip(range(len(texts)), texts, ["s"] * len(texts)))), PIECES).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(encoder.encode(text)), len(text.encode()))
        assert r.over_limit == (r.n_tokens > 4096)


def test_no_piece_of_the_vocabulary_crosses_a_safe_boundary():
    encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = (encoder.id_to_piece(k) for k in range(encoder.get_piece_size()))
    assert not [p for p in pieces if any(a != "▁" and b == "▁" for a, b in itertools.pairwise(p))]


def test_pieces_are_those_of_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = odd_texts(8)
    rows = packing.pack_documents(documents(spark, list(zip(range(len(texts)), texts, ["s"] * len(texts)))), WORD_BPE).collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    expected = {}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            expected[i, start // 4096] = (start, len(part), zlib.crc32(part.tobytes()))
    assert found == expected and len(rows) == len(expected)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) == math.ceil(sum(v[1] for v in expected.values()) / 4096)


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, [(1, "one two", "s"), (2, None, "s"), (2, "three", "s")])
    ids = [i for r in packing.sequences(docs, WORD_BPE).collect() for i in r.ids]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert sorted(ids) == sorted(i for t in ("one two", "", "three") for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0


def least_bins(sizes, capacity):
    """The fewest bins there can be, by trying all."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in {b: n for n, b in enumerate(bins)}.values():
            if bins[b] + sizes[k] <= capacity:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion_finds_the_fewest_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50, 100])
    sizes = sorted((rng.randint(1, capacity * 2 // 3) for _ in range(rng.randint(1, 11))), reverse=True)
    counts = [0] * (capacity + 1)
    for s in sizes:
        counts[s] += 1
    bins = packing.bin_completion(counts, capacity, effort=2000)
    assert Counter(s for b in bins for s in b) == Counter(sizes) and all(sum(b) <= capacity for b in bins)
    assert len(bins) == least_bins(sizes, capacity)


def test_bin_completion_beats_best_fit_where_it_can():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 3
    counts = [sizes.count(s) for s in range(61)]
    assert len(packing.bin_completion(counts, 60)) <= len(packing.best_fit(counts, 60))


def expected_targets(sizes):
    """Resharing round by round, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, total, unbound = {}, sum(sizes.values()), set(names)
    while unbound:
        left, share = total - sum(target.values()), sum(weight[s] for s in unbound)
        above = [s for s in unbound if left * weight[s] / share > 3 * sizes[s] + 1e-9]
        for s in above or list(unbound):
            target[s] = 3 * sizes[s] if above else left * weight[s] / share
            unbound.discard(s)
    return target


def mix_rows(seed=9):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 3, 30, 200]))), rng.choice(["a", "a", "a", "é", "b", "c", "Z", None])) for k in range(900)]
    return rows + [(5000, None, "a"), (5001, "", "only empty"), (None, "no id here", "b"), (7, rows[7][1], rows[7][2])]


def test_mix_report_meets_its_targets(spark):
    rows = mix_rows()
    docs = documents(spark, rows)
    found = mixing.mix_report(docs, block_words=256, shard_words=2048).collect()
    assert len(found) == len(rows)
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, source = expected_targets(sizes), {i: s for i, _, s in rows}
    taken = Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(4, 0.01 * targets[s])
    again = mixing.mix_report(docs.repartition(5), block_words=256, shard_words=2048).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_a_very_long_document_leaves_no_target_unfilled(spark):
    names = "abcdefgh"
    rows = [(1000 * n + k, "w " * (4000 if k == 400 else 10), s) for n, s in enumerate(names) for k in range(401)]
    docs = documents(spark, rows)
    source, taken, target = {i: s for i, _, s in rows}, Counter(), {}
    for r in mixing.mix_report(docs, weights=(3.0, 1.0), block_words=128, shard_words=2048).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert sorted(set(target.values())) == [4000, 12000]
    assert all(0 <= target[s] - taken[s] <= 10 for s in names)
    mix = mixing.mixed_documents(docs, weights=(3.0, 1.0), block_words=128, shard_words=2048)
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(r.text.split())
    assert words == taken


def test_mixed_documents_are_the_rows_of_the_report(spark):
    rows = mix_rows()
    docs = documents(spark, rows)
    report = Counter()
    for r in mixing.mix_report(docs, block_words=256, shard_words=2048).collect():
        report[r.doc_id] += r.taken
    mix = mixing.mixed_documents(docs, block_words=256, shard_words=2048)
    assert mix.columns == docs.columns
    words = Counter()
    for r in mix.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in report.items() if v}


def test_shards_take_disjoint_runs_of_all_blocks(spark):
    quotas = {1: 400, 2: 100, 3: 7, 4: 0}
    rows = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "source_no int, blocks bigint"), 3).collect()
    per_shard = Counter()
    for source, blocks in quotas.items():
        runs = sorted((r.first, r.quota) for r in rows if r.source_no == source)
        assert sum(n for _, n in runs) == blocks
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(runs))
    for r in rows:
        per_shard[r.shard] += r.quota
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 3


def test_hypergeometric_draws_have_their_mean_and_variance(spark):
    from pyspark.sql import functions as F

    n, marked, drawn = 60, 25, 20
    frame = spark.range(4000).select(mixing._hypergeometric(
        F.lit(n).cast("bigint"), F.lit(marked).cast("bigint"), F.lit(drawn).cast("bigint"), (F.col("id") + 0.5) / 4000).alias("x"))
    values = np.array([r.x for r in frame.collect()])
    mean = drawn * marked / n
    variance = mean * (1 - marked / n) * (n - drawn) / (n - 1)
    assert abs(values.mean() - mean) < 0.02 and abs(values.var() - variance) < 0.05


def test_repeated_rows_pack_and_mix_as_often_as_they_come(spark):
    rows = families(n=5)
    docs = documents(spark, rows + rows)
    assert packing.pack_documents(docs, WORD_BPE).count() == 2 * packing.pack_documents(documents(spark, rows), WORD_BPE).count()


def test_every_letter_before_a_stop_has_the_ids_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    words = [f"{start}{chr(c)}{stop}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and (c < 0x3400 or 0xA000 <= c < 0xAC00 or c > 0xD7A3) and c < 0x20000
             for start, stop in (("a", "."), ("", ","), ("ab", ".,"))]
    ids = packing.WordEncoder(WORD_BPE).ids([" ".join(words[k : k + 500]) for k in range(0, len(words), 500)])
    for k, found in enumerate(ids):
        part = words[500 * k : 500 * (k + 1)]
        expected = tokenizer.encode_batch(part, add_special_tokens=False)
        assert np.frombuffer(found, "<u4").tolist() == [i for e in expected for i in e.ids]


def test_undominated_fillings_are_those_of_the_definition():
    rng = random.Random(8)
    for _ in range(60):
        counts = [0] * 31
        for _ in range(rng.randint(1, 7)):
            counts[rng.randint(1, 20)] += 1
        space, most = rng.randint(3, 30), rng.randint(0, 30)
        pieces = [size for size, n in enumerate(counts) for _ in range(n)]
        expected = set()
        for n in range(len(pieces) + 1):
            for places in itertools.combinations(range(len(pieces)), n):
                chosen = [pieces[p] for p in places]
                out = {pieces[p] for p in range(len(pieces)) if p not in places}
                slack = space - sum(chosen)
                sums = {sum(c) for m in range(n + 1) for c in itertools.combinations(chosen, m)}
                if 0 <= slack <= most and not any(s < x <= s + slack for s in sums for x in out):
                    expected.add(tuple(sorted(chosen, reverse=True)))
        found = [f for f in packing.fillings(space, packing._Left(counts), most) if f is not None]
        assert len(found) == len(set(found)) and set(found) == expected
