"""A training-data pipeline over `documents`: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns pieces
with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figquarry.llm import decontamination, packing, secret_scan, simhash, toxicity
from figquarry.llm.common import materialise, small_side, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity of 0.8) the row with the smallest doc_id; of rows that share it, one.

    Of those, it is the row whose text has the least hash, then the least text. Rows without doc_id are in no group: of
    those, equal texts are kept once.
    """
    found = simhash.alike(docs, similarity=0.8, shingle_words=5)
    keep = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("rows"))
    # the row travels as one value, so that no name of its columns can clash with those used here
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    kept = whole.join(small_side(keep), F.col("id") == F.col("kept"))
    alone = kept.where("rows = 1").select("row.*")
    # only rows whose doc_id repeats are brought together
    shared = kept.where("rows > 1").groupBy("kept").agg(F.min_by("row", F.struct(F.xxhash64("text"), "text")).alias("row")).select("row.*")
    lost = whole.where("id IS NULL").groupBy(F.xxhash64("text"), "text").agg(F.first("row").alias("row")).select("row.*")
    return alone.union(shared).union(lost)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets; n_chars follows."""
    return secret_scan.redact_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages hold models, fingerprints and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
