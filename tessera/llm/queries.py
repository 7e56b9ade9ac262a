"""The training-data queries, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm._shared import pick

#: The key of the surrogates; in production a secret from the caller's own store.
SURROGATE_KEY = "documents"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    from tessera.llm.token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_language_id(spark, sf_dir):
    from tessera.llm.langid import fit, languages

    docs = _table(spark, sf_dir, "documents")
    return languages(docs, fit(docs, tokenizer_path("piece_bpe_32k.model")))


def op3_embedding_near_dedup(spark, sf_dir):
    from tessera.llm.embed_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark, sf_dir):
    from tessera.llm.quality_rules import apply_policy, ledger

    out = apply_policy(ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(3)) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op5_pii_surrogates(spark, sf_dir):
    from tessera.llm.pii import pseudonymise

    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pseudonymise(docs, SURROGATE_KEY, count="n_entities")


def op6_quality_classifier(spark, sf_dir):
    from tessera.llm.quality_model import fit, quality_scores

    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_minhash_near_dedup(spark, sf_dir):
    from tessera.llm.minhash import near_documents

    return near_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_toxicity(spark, sf_dir):
    from tessera.llm.toxicity import fit, toxicity_scores

    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op9_mixing(spark, sf_dir):
    from tessera.llm.mixing import mix, sized

    out, _ = mix(sized(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op10_best_fit_packing(spark, sf_dir):
    from tessera.llm.packing import pack, pieces

    return pack(pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


_OPERATORS = (
    op1_token_counts,
    op2_language_id,
    op3_embedding_near_dedup,
    op4_quality_rules,
    op5_pii_surrogates,
    op6_quality_classifier,
    op7_minhash_near_dedup,
    op8_toxicity,
    op9_mixing,
    op10_best_fit_packing,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
SQL = oracles.SQL
