"""The queries ``opN_*`` and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, licenses, packing, pii, quality, secrets, sharding, simhash, tokens, warc
from gleaner.llm.common import join_spans
from gleaner.llm.oracles import ORACLE_SQL  # noqa: F401  read by the driver's entry

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_notices, families (sorted, comma-joined), best_p, spans (family:start:end)."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",")
    spans = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["family"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), families.alias("families"), F.array_max(F.transform("notices", lambda x: x["p"])).alias("best_p"), spans.alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", _of_kind("base", 0).alias("n_assign"), _of_kind("base", 1).alias("n_access"), _of_kind("base", 2).alias("n_hex"),
        F.sha2(join_spans(F.col("base"), secrets.KINDS), 256).alias("base_sha256"), join_spans(F.col("hits"), secrets.KINDS).alias("spans"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing here asks for payloads, so the reader parses headers and skips the rest."""
    path = warc.write_warc(_table(spark, sf_dir, "pages"))
    back = warc.read_warc(spark, path, payload=False)
    return back.select(
        warc.page_id_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", warc.page_id_of(F.col("refers_to")).alias("refers_to")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    base = tokens.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, base, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_capacity; lengths are
    tokens of the vocabulary that op6 takes, with one end mark for each document."""
    import public_tokenizers

    return packing.pack(tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), length="n_tokens")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then ``actions``: start:end:act of each term."""
    found = pii.scan(_table(spark, sf_dir, "documents"))
    spans = F.concat("base", F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m"))))
    actions = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"), x["act"])), ",")
    return found.select(
        "doc_id", *[_of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        F.sha2(join_spans(F.col("base"), pii.KINDS), 256).alias("base_sha256"), join_spans(spans, pii.KINDS).alias("spans"), actions.alias("actions"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    hits = decontaminate.hit_words()
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality.rate(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_sharding, op4_simhash_near_dedup, op5_warc, op6_token_files, op7_best_fit_packing, op8_pii, op9_decontamination, op10_quality_rules)}
