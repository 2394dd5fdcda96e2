"""Sources and sinks of the harness: corpus folders, row envelopes, item dumps, teacher columns, synthetic corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DOMAINS = 8


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """domain, name, text: <domain>.md is one document, <domain>/*.md are several; texts are trimmed.

    Refused (an error when the rows are read): an empty document. Refused at once: no domain, over MOST_DOMAINS,
    or a domain that is both a file and a folder; for these one row a domain is looked at.
    """
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    inside = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + folder.rstrip("/").split("/")[-1] + "/", "")
    parts = F.split(F.regexp_replace(inside, r"\.md$", ""), "/")
    rows = raw.select(F.get(parts, F.lit(0)).alias("domain"), inside.alias("name"), F.size(parts).alias("depth"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"))
    kinds = rows.groupBy("domain").agg(F.count_distinct("depth").alias("kinds")).limit(MOST_DOMAINS + 1).collect()
    if not kinds or len(kinds) > MOST_DOMAINS:
        raise ValueError(f"a corpus has 1 to {MOST_DOMAINS} domains")
    if twice := [r.domain for r in kinds if r.kinds > 1]:
        raise ValueError(f"domain is both a file and a folder: {twice[0]}")
    checked = F.when(F.col("text") == "", F.raise_error(F.concat(F.lit("empty document: "), F.col("name")))).otherwise(F.col("text"))
    return rows.select("domain", "name", checked.alias("text"))


def read_envelopes(spark: SparkSession, pages: str | list[str], row_schema: str) -> DataFrame:
    """page, row_idx and the row's fields of {"rows": [{"row_idx", "row": {...}}]} files; other files give no rows."""
    schema = f"rows array<struct<row_idx: long, row: struct<{row_schema}>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(pages)
    rows = raw.select(F.col("_metadata.file_name").alias("page"), F.explode("rows").alias("r"))
    return rows.select("page", "r.row_idx", "r.row.*")


def write_items(items: DataFrame, path: str, by: str | None = None) -> None:
    """Items as JSON lines, a folder for each value of `by`."""
    writer = items.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_teacher(columns: DataFrame, path: str) -> None:
    """row_id, gold, pick, q (array of floats) of a teacher, as Parquet."""
    columns.select("row_id", F.col("gold").cast("int").alias("gold"), F.col("pick").cast("int").alias("pick"), F.col("q").cast("array<float>").alias("q")).write.mode("overwrite").parquet(path)


def read_teacher(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id long, gold int, pick int, q array<float>").parquet(path)


def write_synthetic(rows: DataFrame, path: str, header: dict[str, str]) -> None:
    """A corpus of accepted rows (label, text, provenance) with its header and row count beside it."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    n = rows.count()
    head = rows.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in header.items()], F.lit(n).alias("accepted"))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_synthetic; refused if their number isn't the header's."""
    head = spark.read.json(f"{path}/header").first()
    rows = spark.read.schema("label string, text string, provenance string").json(f"{path}/rows")
    if rows.count() != head.accepted:
        raise ValueError("the corpus doesn't hold as many rows as its header says")
    return rows
