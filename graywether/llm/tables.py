"""What the operators of this subpackage share: written tables, word splitting and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.sources.steps import Workspace, shared_dir  # noqa: F401  for the operators

#: White space that separates words: \x20 and \x09-\x0D. bytes.split() takes the same six bytes.
BLANK = r"[\x20\x09-\x0D]+"


def numbered(df: DataFrame, order: list[Column], name: str, ws: Workspace, table: str) -> DataFrame:
    """df, written, with each row's rank from 1 by order as column `name`; ranges are sorted side by side.

    Only the ranges' sizes (a row for each) come together. Rows that tie are ranked in no given order.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = ws.save(at, table).withColumn("_range", F.shiftright("_at", 33))
    sizes = at.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0)")
    at = at.join(sizes.select("_range", before.alias("_before")), "_range")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.withColumn(name, rank.cast("long")).drop("_at", "_range", "_before")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows evenly, without a key, over as many tasks as a shuffle has."""
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of an ASCII string, which DuckDB lacks; `table` gives the one row (column crc_of) that the
    expression needs beside it."""
    if text == "table":
        step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
        return f"SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: {step}) ORDER BY b) AS crc_of FROM range(256) t(b)"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(crc_of[(xor(c, b) & 255) + 1], c >> 8)))"
