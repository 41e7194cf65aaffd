"""The pipeline from documents to packed sequences, on a small corpus and on empty tables."""

import random
from collections import defaultdict

import corpus_pipeline
from tallystone.llm import toxicity
from test_words_and_links import plain_set

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(seed=6, n=240):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 80, 300]))]
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorkish", "blarg", "vexful"]))
        texts.append(" ".join(words))
        labels.append((k, 1, int(toxic)))
    copies = [texts[1].upper(), texts[1], texts[2] + " more", texts[3] + " and more", None, "", "", texts[4]]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, 1) for k, t in enumerate([*texts, *copies])]
    return [*rows, rows[6]], labels


def written_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rows, labels = corpus()
    folder = written_tables(spark, tmp_path, rows, labels)
    table = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    found = corpus_pipeline.run(spark, folder).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    toxic = {r.doc_id for r in toxicity.toxicity(table("documents"), table("labels")).filter("predicted = 1").collect()}
    there = {r.doc_id for r in found}
    assert toxic and not toxic & there
    # of equal texts the largest id, of near copies the least, and no two alike are left
    assert len({texts[i].lower() for i in there}) == len(there)
    sets = [plain_set(texts[i]) for i in there]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a and b)
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = written_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_but_the_last_return_the_columns_of_documents(spark, tmp_path):
    rows, labels = corpus(n=30)
    folder = written_tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, folder).columns == docs.columns
