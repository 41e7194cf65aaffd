"""One query for each operator, and the pipeline's oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import (
    agenda, alignment, minhash, mixing, packing, pagetext, pii, projections, quality, ranked, recipes, tokencounts, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("nearest")


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(table(spark, sf_dir, "pages"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_weak_label_quality, op2_nearest_toxicity, op3_pii_spans, op4_main_text, op5_minhash_dedup,
        op6_best_fit_packing, op7_source_mixing, op8_exact_dedup, op9_embedding_dedup, op10_token_counts,
        op11_token_alignment, op12_ranked_search, op13_piece_codec,
    )
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
                   from documents)
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(low) as text_sha256
        from t window same as (partition by low)
    """,
    "op12_ranked_search": r"""
        with t as (select row_number() over () as row_no, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
             q as (select item_id, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
             d as (select row_no, doc_id, len(terms)::bigint as n from t),
             totals as (select count(*) filter (where n > 0) as docs, sum(n)::bigint as words from d),
             held as (select row_no, term, count(*) as tf from (select row_no, unnest(terms) as term from t) group by all),
             weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
                         from held, totals group by term),
             scores as (select item_id, row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) as score
                        from q join weights using (term) join held using (term) join d using (row_no), totals group by all)
        select item_id, rank::int as rank, doc_id, score::bigint as score from (
          select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
          from scores join d using (row_no) where score > 0) where rank <= 20
    """,
}
