"""Word hashing, shingle sets, components and exact dedup, held against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallystone.llm import minhash, projections, recipes, words
from tallystone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, source string, salt int, id string, component string, `a.b` int"


def documents(spark, rows):
    """Documents with columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "x", "y", 2) for i, t, s in rows], DOCS)


def plain_set(text):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)}


def families(seed=4, n=40):
    """Texts with exact and near copies of all degrees, and the odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(1000, None, "s"), (1001, "", "s"), (1002, "One", None), (1003, "one", "s"), (1004, " \t\n ", "s"), (1005, "one two", "s"), (None, "One Two", "s")]
    for k in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 150, 900]))]
        rows.append((20 * k, " ".join(base), "s"))
        for c in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.04, 0.08]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((20 * k + c + 1, "  ".join(copy).upper() if c == 1 else " ".join(copy), "s"))
    return rows


def plain_components(rows):
    sets = [plain_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if sets[x] and 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                parent[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _, _) in enumerate(rows):
        least[find(x)].append(i)
    return {rows[x][0]: min(i for i in least[find(x)] if i is not None) for x in range(len(rows)) if rows[x][0] is not None}, sets


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_word_hashes_are_one_to_one(monkeypatch, size):
    monkeypatch.setattr(words, "SLICE", size)
    monkeypatch.setattr(words, "_powers", {})
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB cé\n\t\x0bd ") for _ in range(rng.choice([0, 3, 50, 500]))) for _ in range(200)] + [None, "x" * 300]
    hashes, offsets = words.word_hashes(pa.array(texts))
    found = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(offsets).tolist() == [len(f) for f in found]
    known = {}
    for word, value in zip([w for f in found for w in f], hashes.tolist()):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_shingle_sets_have_the_sizes_of_plain_sets():
    rows = families()
    sets = words.shingle_sets(pa.array([t for _, t, _ in rows]))
    assert [len(s) for s in sets] == [len(plain_set(t)) for _, t, _ in rows]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (9, 8)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 30)]])
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    expected = {x: find(x) for x in list(parent)}
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in components(frame).collect()} == expected


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_hold_against_whole_texts(spark, bits):
    """With three bits most identifiers clash, and digests must tell chunks apart."""
    rows = families(n=12)
    rng = random.Random(2)
    long = ". ".join("".join(rng.choice("abc de") for _ in range(90)) for _ in range(200))
    rows += [(5000, long, "s"), (5001, long.upper(), "s"), (5002, long[:-1] + "x", "s"), (5003, "É", "s"), (5004, "é", "s"), (5000, long, "s")]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    found = recipes.exact_groups(documents(spark, rows), bits).collect()
    assert len(found) == len(rows)
    by_sha = defaultdict(list)
    for r in found:
        by_sha[r.text_sha256].append(r)
    for text, ids in groups.items():
        held = by_sha.pop(hashlib.sha256(text.encode()).hexdigest())
        top = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in held) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in held} == {(top, len(ids))}
        assert [r.doc_id for r in held if r.kept] == [top]
    assert not by_sha


def test_exact_dedup_keeps_rows_with_their_columns(spark):
    rows = [(1, "A b", "s"), (2, "a B", None), (2, "a b", None), (3, None, "t"), (4, "", "t"), (None, "z", "u"), (None, "Z", "u")]
    docs = documents(spark, rows)
    kept = recipes.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect()) == [("2", "a b"), ("4", ""), ("None", "z")]
    assert recipes.deduplicated(docs.limit(0)).count() == 0


def test_minhash_links_all_that_brute_force_links(spark):
    rows = families()
    expected, sets = plain_components(rows)
    found = minhash.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    named = {r.doc_id: r for r in found if r.doc_id is not None}
    wrong = {i for i, c in expected.items() if named[i].component_id != c}
    assert not wrong
    assert all(named[i].n_shingles == len(s) for (i, _, _), s in zip(rows, sets) if i is not None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in named.values())
    nameless = next(r for r in found if r.doc_id is None)
    assert (nameless.component_id, nameless.kept) == (1005, False)


def test_large_clusters_are_split_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "UNIT_DOCS", 7)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.choice([2, 4, 8])):
            copy[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(copy), "s"))
    expected, _ = plain_components(rows)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert found == expected


def test_tensored_keys_need_few_minhashes():
    rng = np.random.default_rng(0)
    keys = minhash.tensored_keys(rng.integers(0, 1 << 32, (3, minhash.HASHES), dtype=np.uint32))
    assert keys.shape == (3, 64) and len(np.unique(keys)) == 3 * 64 and minhash.HASHES == 32


def test_near_dedup_keeps_rows_with_their_columns(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = documents(spark, [(7, text, "s"), (3, text + " more", "s"), (9, "other", None), (None, "other", "s"), (None, None, "s")])
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(120):
            base = rng.standard_normal(16)
            for _ in range(int(rng.choice([1, 1, 1, 3, 12]))):
                rows.append((k, (base / np.linalg.norm(base) + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.045])).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [float("nan")] * 16, 1), (k + 3, rows[0][1], None), (k + 4, [None] + rows[0][1][1:], 0),
             (k + 5, [float("inf")] * 16, 0), (k + 6, rows[0][1][:8], 0), (k + 7, [], 0), (k + 8, rows[0][1], 1), (k + 9, [2 * x for x in rows[0][1]], 0)]
    return rows


def test_embedding_links_against_brute_force(spark, monkeypatch):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, weight int, dim int")
    found = {r.vec_id: r for r in projections.near_duplicates(frame, window=16).collect()}
    assert len(found) == len(rows)
    unit = {}
    for i, v, label in rows:
        x = np.array(v if v and None not in v else [0.0], float)
        if label is not None and np.isfinite(x).all() and x.any():
            unit[i] = (label, x / np.sqrt((x * x).sum()))
    links = missed = 0
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = dict.fromkeys(parent, 0)
    for i in unit:
        for j in unit:
            if i < j and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.98:
                degree[i] += 1
                degree[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for i in parent:
        assert found[i].n_links <= degree[i]
        links, missed = links + degree[i], missed + degree[i] - found[i].n_links
        assert found[i].kept == (found[i].component_id == i)
    assert links > 500 and missed <= 0.01 * links
    assert sum(found[i].component_id != find(i) for i in parent) <= 2
    assert projections.near_duplicates(frame.limit(0)).count() == 0
