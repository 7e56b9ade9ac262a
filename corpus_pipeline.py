"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir): it works on all that its
predecessor kept and returns the columns of ``documents``, the last one the
packed pieces.  Between stages the rows are written as Parquet and read again,
so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, mixing, packing, pii
from tessera.llm._shared import WORD, by_place, discard, pick, scope
from tessera.llm.queries import SURROGATE_KEY, tokenizer_path

#: Share of the probability that the likeliest language must have.
SURE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: keeps texts whose likeliest learned language has SURE of the probability.

    Rejects texts that are null or have no letter, and those that no learned
    language explains better than the others.  Repeated rows fare alike; an empty
    table, and one without any lang to learn from, stays or becomes empty.
    """
    return langid.confident(docs, langid.fit(docs, tokenizer_path("piece_bpe_32k.model")), SURE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group, that of the smallest doc_id, stays.

    Of repeated rows one stays.  Null, empty and wordless texts link with nothing
    and all stay.  Rows that share a doc_id but not the text are told apart.
    """
    kept = minhash.near_documents(docs).where("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias("_k"), F.xxhash64("text_hash", F.col("doc_id").isNull()).alias("_h")).distinct()
    placed, at, back = by_place(docs)
    text, key = at("text"), at("doc_id")
    words = F.coalesce(text.rlike(WORD), F.lit(False))
    placed = placed.withColumn("_id", F.coalesce(key, F.lit(0))).withColumn("_th", F.xxhash64(F.xxhash64(text), key.isNull()))
    placed = placed.withColumn("_own", F.when(words, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    stay = placed.join(kept, (F.col("_id") == F.col("_k")) & (F.col("_th") == F.col("_h")), "left_semi")
    return stay.dropDuplicates(["_id", "_th", "_own"]).select(*back)


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every detected entity is replaced by its surrogate.

    All rows stay, null and empty texts as they are; repeated rows are replaced alike.
    """
    return pii.pseudonymise(docs, SURROGATE_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each time that a document is taken, its text cut where it is taken in part.

    Texts that are null, empty or without words hold nothing to take and go.  A
    null source is a source of its own; repeated rows are taken each for itself.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces with their sequences and places.

    A null or empty text is one piece of one token; an empty table gives no piece.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", deduplicate),
    ("PII", protect),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the fitted language model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang", "source", "n_chars")
    for _, stage in STAGES:
        with scope() as keep:
            after = keep(stage(spark, docs, sf_dir))
        discard(docs)
        docs = after
    return docs
