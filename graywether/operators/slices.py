"""Slices of labelled rows: stratified picks, folds, caps, samples, audits.

Places in a label come from a window per label, never over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def in_label(rows: DataFrame, label: str, order: str) -> DataFrame:
    """rows with place (from 0) in their label and label_first, where the label first appears."""
    w = W.partitionBy(label).orderBy(order)
    first = rows.groupBy(label).agg(F.min(order).alias("label_first"))
    return rows.withColumn("place", F.row_number().over(w) - 1).join(F.broadcast(first), label)


def heads(rows: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """label, order, place (from 0): the first k of each label. Spark keeps k a label and task before it shuffles, and only these
    two columns go."""
    w = W.partitionBy(label).orderBy(F.asc_nulls_last(order))
    return rows.select(label, order).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(label, order, (F.col("_n") - 1).alias("place"))


def round_robin(rows: DataFrame, label: str, order: str, budget: int) -> DataFrame:
    """The first `budget` rows when labels, in order of appearance, take turns. A top-k by place and label."""
    return in_label(rows, label, order).orderBy("place", "label_first").limit(budget)


def folds(rows: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """rows with fold: place in the label, modulo k."""
    return in_label(rows, label, order).withColumn("fold", (F.col("place") % k).cast("int"))


def per_label(rows: DataFrame, label: str, order: str, cap: int) -> DataFrame:
    return in_label(rows, label, order).where(F.col("place") < cap)


def split_three(rows: DataFrame, label: str, order: str, cal: int, test: int) -> DataFrame:
    """rows with slice: the first `cal` of each label are cal, the next `test` are test, the rest is pool; order is unique in a label.

    Only the bounds of a label's slices are worked out, from its first rows; the rows themselves stay where they are.
    """
    key = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at"))  # nulls last
    bounds = heads(rows, label, order, cal + test).groupBy(F.col(label).alias("_label")).agg(
        F.max(F.when(F.col("place") < cal, key)).alias("_cal"), F.max(key).alias("_test")
    )
    joined = rows.join(F.broadcast(bounds), F.col(label).eqNullSafe(F.col("_label")))  # a row a label
    return joined.withColumn("slice", F.when(key <= F.col("_cal"), "cal").when(key <= F.col("_test"), "test").otherwise("pool")).drop("_label", "_cal", "_test")


def overlaps(sliced: DataFrame, key: Column) -> DataFrame:
    """a, b, shared: distinct keys that two slices share (no null ones); keys are grouped once, with the slices they are in."""
    held = sliced.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.sort_array(F.collect_set("slice")).alias("s"))
    pairs = held.where(F.size("s") > 1).select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def modal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n: the most frequent value of each group, ties low."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v")))
    picked = counts.groupBy(*by).agg(best.alias("m")) if by else counts.agg(best.alias("m"))
    return picked.select(*by, F.col("m.v").alias(value), (-F.col("m.o")).alias("n"))
