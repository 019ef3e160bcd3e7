"""One registered query for each operator: whole tables, production parameters; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightgrid.llm import bpe, chat, jaccard_join, lm_scoring, merkle, mixing, packing, pii, quality, token_files, topk, toxicity, variants
from sightgrid.llm.common import documents
from sightgrid.session import fresh_folder
from sightgrid.sources.tables import table

END_ID = 2
#: In the order of the chain: a poor text is known first, and its probability is read when toxicity is judged.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_token_files(documents(spark, sf_dir), fresh_folder(spark, "token-files"),
                                           vocabulary("byte_bpe_50k.json"), END_ID)
    return token_files.read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(documents(spark, sf_dir))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 100).withColumnRenamed("id", "vec_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.assess(documents(spark, sf_dir), ["doc_id"])
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "perplexity", "low", "high")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"), CATEGORIES, ["doc_id"])
    return rows.select("row.doc_id", "p_poor", "poor", "p_toxic", "toxic")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(documents(spark, sf_dir), ["doc_id"])
    return rows.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(documents(spark, sf_dir)).select("word", "n", "n_near", "form", "form_n", "root")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.there_and_back(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return rows.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(documents(spark, sf_dir))


QUERIES = {
    "op1_token_files": (op1_token_files, None),
    "op2_jaccard_join": (op2_jaccard_join, None),
    "op3_lm_scoring": (op3_lm_scoring, None),
    "op4_topk": (op4_topk, topk.ORACLE),
    "op5_chat": (op5_chat, None),
    "op6_packing": (op6_packing, None),
    "op7_quality": (op7_quality, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_pii": (op9_pii, None),
    "op10_mixing": (op10_mixing, mixing.ORACLE),
    "op11_spelling_variants": (op11_spelling_variants, variants.ORACLE),
    "op12_bpe": (op12_bpe, None),
    "op13_merkle": (op13_merkle, merkle.ORACLE),
}
