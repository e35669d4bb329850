"""One thin query for each operator: its whole table, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm_scores, mixing, near_dups, negatives, oracles, packing, pieces, quality, rules, sharding, spelling, storage, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).drop("payload")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")  # as it arrives in its shard
    return sharding.histogram_sort(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    back = pieces.decode(pieces.encode(docs, keep=("doc_id", "text_crc32")))
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.crc32("decoded").alias("decoded_crc32"), (F.crc32("decoded") == F.col("text_crc32")).alias("lossless"),
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), slips=97))


def rules_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4."""
    return rules.base_statistics(table(spark, sf_dir, "documents")).drop("lang", "source")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6."""
    corpus = storage.materialise(lm_scores.read_corpus(table(spark, sf_dir, "documents")), "corpus")
    found, _ = lm_scores.base_scores(corpus, storage.materialise(lm_scores.spelled_words(corpus), "words"))
    return found.drop("learn", "ids").withColumn("base_score", F.round("base_score", 5))


def shard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: sizes, and that each shard's slots run from 0 without a gap."""
    rows = op3_sharding(spark, sf_dir).select("doc_id", "size", "shard", "slot")
    of = rows.groupBy("shard").agg((F.countDistinct("slot") == F.count("*")).alias("different"), (F.max("slot") + 1 == F.count("*")).alias("dense"), F.min("slot").alias("least"))
    return rows.join(of, "shard").select("doc_id", "size", F.col("shard").between(0, 23).alias("in_a_shard"), (F.col("different") & F.col("dense") & (F.col("least") == 0)).alias("gapless"))


def shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3's groups: how many rows with its text a row's shard holds, where the group is not larger than a shard."""
    rows = sharding.histogram_sort(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = storage.materialise(rows.select("doc_id", F.sha2("text", 256).alias("of"), (F.octet_length("text").cast("bigint") + 8).alias("size"), "shard"), "shards")
    here = rows.groupBy("of", "shard").agg(F.count("*").alias("together"), F.sum("size").alias("part"))
    whole = here.groupBy("of").agg(F.sum("part").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    out = rows.join(here, ["of", "shard"]).join(whole, "of")
    return out.select("doc_id", F.when(F.col("bytes") * 24 <= total, F.col("together")).alias("together"), "bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
    "rules_base_counts": rules_base_counts,
    "lm_base_scores": lm_base_scores,
    "shard_layout": shard_layout,
    "shard_groups": shard_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op7_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op9_exact_top_k": oracles.TOP_K,
    "op11_mixing": oracles.MIXING,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_spelling_variants": oracles.SPELLING,
    "rules_base_counts": oracles.RULES_BASE,
    "lm_base_scores": oracles.LM_BASE,
    "shard_layout": oracles.SHARD_LAYOUT,
    "shard_groups": oracles.SHARD_GROUPS,
}
