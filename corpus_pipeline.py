"""Documents to packed training sequences, in five stages.

Each stage gets what the one before it kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, packing, quality, secrets, simhash, tokens
from gleaner.llm.common import cut, made, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least doc_id. Links are those of
    fingerprints of five words, and texts whose shingles have a similarity of 0.8."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths, in tokens."""
    import public_tokenizers

    # Workers and their JVM hold what the stages before left: they remember fewer words.
    counted = tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), most=100_000, keep=False)
    return packing.pack(counted, length="n_tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = made()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            used = [p for p in made() if p not in before]
            docs = cut(docs, name)
            remove(spark, used)  # what the stage wrote for itself
    return docs


#: The stages use fingerprints, components and a packing plan, which SQL cannot
#: express; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
