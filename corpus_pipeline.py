"""A corpus pipeline of five of the training-data operators.

STAGES are applied in order to documents; each stage's rows are written as Parquet in the shared folder and read
again as the documents of the next.

1. quality: documents that fail their own rules or their host's verdict go.
2. near_duplicates: of the documents whose five-word shingles are alike to 0.8 or more, and of those that such links
   reach, one stays.
3. privacy: personal data and disclosing terms are replaced in the texts; no document goes.
4. mixing: documents are taken as often as the mix of sources asks for (0 to 3 times).
5. bpe: texts are encoded and decoded; returns doc_id, source, n_tokens, ids (packed little-endian unsigned 32-bit
   integers) and the SHA-256 of ids and of the decoded text.

Null ids, texts and sources pass through as the operators describe; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.llm import lexicon, mixing, privacy, quality, simhash
from graywether.llm.queries import word_vocabulary
from graywether.llm.tables import Workspace, documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = privacy.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = lexicon.encode_and_decode(docs.select("doc_id", "text", "source"), word_vocabulary())
    return coded.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("privacy", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Rounding by hashes, fingerprints and merges aren't SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
