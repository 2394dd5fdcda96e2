"""Measures of items (case_id, gold, pick, probs, conf, ok): one pass of aggregations each, windows by key only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions.maths import ece_bin
from graywether.operators.ordered import running
from graywether.sources.steps import Workspace

BINS = 15


def bins(items: DataFrame, n: int = BINS) -> DataFrame:
    """bin, n, mean_conf, acc of the items that are in a bin."""
    binned = items.withColumn("bin", ece_bin(F.col("conf"), n)).where("bin is not null")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("ok").alias("acc"))


def ece(items: DataFrame, n: int = BINS) -> DataFrame:
    """One row, ece: the mean gap of confidence and accuracy over bins, NaN without items."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("acc"))) / F.sum("n")
    return bins(items, n).agg(F.coalesce(gap, F.lit(float("nan"))).alias("ece"))


def brier_parts(items: DataFrame, n: int = BINS) -> DataFrame:
    """reliability, resolution, uncertainty over the bins."""
    b = bins(items, n)
    base = b.agg((F.sum(F.col("n") * F.col("acc")) / F.sum("n")).alias("base"), F.sum("n").alias("total"))
    joined = b.crossJoin(F.broadcast(base))  # base is one row
    w = F.col("n") / F.col("total")
    return joined.agg(
        F.sum(w * (F.col("mean_conf") - F.col("acc")) ** 2).alias("reliability"),
        F.sum(w * (F.col("acc") - F.col("base")) ** 2).alias("resolution"),
        F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def auroc(scores: DataFrame, *by: str) -> DataFrame:
    """auroc of score against y (0 or 1) by Mann and Whitney with mid-ranks; NaN for one class.

    Ranks come from counts per distinct score, summed range by range.
    """
    each = scores.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    ranked = running(each, "score", ["n"], by).withColumn("rank", F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    p = F.col("p").cast("double")
    value = (F.col("r") - p * (p + 1) / 2.0) / (p * F.col("q"))
    return sums.select(*by, F.when((F.col("p") == 0) | (F.col("q") == 0), float("nan")).otherwise(value).alias("auroc"))


def macro_f1(items: DataFrame) -> DataFrame:
    """One row, macro_f1: mean of 2tp / max(1, 2tp + fp + fn) over classes that are gold or picked."""
    gold = items.select(F.col("gold").alias("c"), F.lit(0).alias("fp"), (F.col("ok") == 0).cast("int").alias("fn"), "ok")
    pick = items.select(F.col("pick").alias("c"), (F.col("ok") == 0).cast("int").alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("ok"))
    per = gold.union(pick).groupBy("c").agg(F.sum("ok").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = 2.0 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per.agg(F.avg(f1).alias("macro_f1"))


def _by_confidence() -> object:
    return W.orderBy(F.desc("conf"), F.asc("case_id"))


def risk_coverage(items: DataFrame) -> DataFrame:
    """case_id, rank, coverage, acc: running accuracy by confidence, then case_id.

    Ranks are global, so items are range-partitioned by confidence first; running sums restart in each range and
    the ranges' own sums (one row a range) are added.
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.select("case_id", "conf", "ok").repartitionByRange(n, F.desc("conf"), F.asc("case_id"))
    # written, as the ranges are drawn from a sample and both uses have to see the same
    dealt = Workspace(items.sparkSession, "risk_coverage").save(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    w = W.partitionBy("part").orderBy(F.desc("conf"), F.asc("case_id"))
    own = dealt.withColumn("r", F.row_number().over(w)).withColumn("s", F.sum("ok").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = dealt.groupBy("part").agg(F.count("*").alias("pn"), F.sum("ok").alias("ps"))
    first = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("bn", F.coalesce(F.sum("pn").over(first), F.lit(0))).withColumn("bs", F.coalesce(F.sum("ps").over(first), F.lit(0)))
    all_of = parts.agg(F.sum("pn").alias("total"))
    joined = own.join(F.broadcast(parts.select("part", "bn", "bs")), "part").crossJoin(F.broadcast(all_of))
    rank = F.col("r") + F.col("bn")
    return joined.select(
        "case_id", rank.cast("long").alias("rank"), (rank / F.col("total")).alias("coverage"), ((F.col("s") + F.col("bs")) / rank).alias("acc")
    )


def hard_metrics(items: DataFrame) -> DataFrame:
    """n, accuracy, mean_conf, brier and nll (of being right at conf), in one aggregation."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("conf")))
    return items.agg(
        F.count("*").alias("n"),
        F.avg("ok").alias("accuracy"),
        F.avg("conf").alias("mean_conf"),
        F.avg((F.col("conf") - F.col("ok")) ** 2).alias("brier"),
        F.avg(F.when(F.col("ok") == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("nll"),
    )


def accuracy_at(items: DataFrame, *shares_of: float) -> DataFrame:
    """coverage, acc: accuracy of the max(1, floor(n * share)) most confident items."""
    curve = risk_coverage(items)
    n = F.max("rank")
    cuts = curve.agg(*[F.greatest(F.lit(1), F.floor(n * s)).alias(f"c{i}") for i, s in enumerate(shares_of)])
    cuts = cuts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"c{i}").cast("long").alias("rank")) for i, s in enumerate(shares_of)])))
    return curve.join(F.broadcast(cuts), "rank").select("share", "acc")


def confusion(items: DataFrame, k: int) -> DataFrame:
    """gold, pick, n, share of all errors: the k most frequent mistakes, ties by gold, pick."""
    wrong = items.where("ok = 0")
    counts = wrong.groupBy("gold", "pick").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    ranked = counts.crossJoin(total).withColumn("share", F.col("n") / F.col("total")).drop("total")
    return ranked.orderBy(F.desc("n"), "gold", "pick").limit(k)


def conformal_floor(cal: DataFrame, test: DataFrame) -> DataFrame:
    """case_id, floor: (1 + calibration scores at most the case's) / (n + 1).

    Both are counted per distinct score and summed range by range, so no pair of rows is made.
    """
    both = cal.select("score", F.lit(1).cast("long").alias("n")).union(test.select("score", F.lit(0).cast("long").alias("n")))
    below = running(both.groupBy("score").agg(F.sum("n").alias("n")), "score", ["n"]).select("score", F.col("n_upto").alias("k"), F.col("n_all").alias("cal_n"))
    return test.join(below, "score").select("case_id", ((1 + F.col("k")) / (F.col("cal_n") + 1.0)).alias("floor"))


def mid_entropy(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def mutual_information(items: DataFrame, a: str, b: str) -> DataFrame:
    """mi and h: mutual information of two columns and the entropy of the first, in bits."""
    joint = items.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pa, pb = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    total = F.broadcast(joint.agg(F.sum("n").alias("t")))
    mi = joint.join(pa, "a").join(pb, "b").crossJoin(total)
    mi = mi.agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = pa.crossJoin(total).agg(F.sum(mid_entropy(F.col("na") / F.col("t"))).alias("h"))
    return mi.crossJoin(F.broadcast(h))
