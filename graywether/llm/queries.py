"""The queries of the training-data operators, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.llm import conversations, divergence, lexicon, licences, mixing, ordermin, passages, privacy, quality, secrets, sharding, simhash, suffixtree
from graywether.llm.tables import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def word_vocabulary() -> str:
    """Path of the vocabulary file that op3 is asked to use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = lexicon.encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), word_vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_licences", "licences")


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.report(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [f"n_{k}" for k in privacy.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_terms")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(documents(spark, sf_dir).select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=24)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    judged = quality.judge(docs, carry=["doc_id", "source"])
    return judged.select("doc_id", *quality.MEASURES, "kept")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.audit(rows).drop("n_rows")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [f"n_{k}" for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_decoded")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_ordermin": op2_ordermin,
    "op3_bpe": op3_bpe,
    "op4_passages": op4_passages,
    "op5_licences": op5_licences,
    "op6_privacy": op6_privacy,
    "op7_simhash": op7_simhash,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_secrets": op12_secrets,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op5_licences": licences.oracle(),
    "op10_quality": quality.oracle(),
    "op11_conversations": conversations.oracle(),
    "op13_divergence": divergence.oracle(),
}
