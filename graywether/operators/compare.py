"""Lanes side by side: pairing, flips, intervals, cascades and fusion of items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.functions.maths import argmax_first, sigmoid, total
from graywether.operators.metrics import auroc


def pair_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of two lanes with the same case: an equi-join on case_id."""
    left = a.select("case_id", "gold", *[F.col(c).alias(f"{c}_a") for c in ("pick", "conf", "ok")])
    right = b.select("case_id", *[F.col(c).alias(f"{c}_b") for c in ("pick", "conf", "ok")])
    return left.join(right, "case_id").select("case_id", "gold", "pick_a", "pick_b", "conf_a", "conf_b", "ok_a", "ok_b")


def flips(pairs: DataFrame) -> DataFrame:
    d = F.col("ok_b") - F.col("ok_a")
    return pairs.agg(*[F.sum((c).cast("long")).alias(n) for n, c in (("gained", d > 0), ("lost", d < 0), ("ties", d == 0))], F.count("*").alias("n"))


def mean_ci(rows: DataFrame, column: str) -> DataFrame:
    """mean, half width of the normal 95 % interval, lower bound, n."""
    half = 1.96 * F.stddev_samp(column) / F.sqrt(F.count("*"))
    return rows.agg(F.avg(column).alias("mean"), half.alias("half"), (F.avg(column) - half).alias("lb95"), F.count("*").alias("n"))


def unpaired_delta(pairs: DataFrame) -> DataFrame:
    """delta of accuracies and its one-sided 95 % bound, as of two unpaired binomials."""
    m = pairs.agg(F.avg("ok_a").alias("a"), F.avg("ok_b").alias("b"), F.count("*").alias("n"))
    se = F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("n") + F.col("b") * (1 - F.col("b")) / F.col("n"))
    return m.select((F.col("a") - F.col("b")).alias("delta"), (F.col("a") - F.col("b") - 1.644934 * se).alias("lcb95"))


def exact_mcnemar(wins: int, losses: int) -> float:
    """Two-sided binomial p of wins against losses at odds of a half, in logarithms."""
    n, k = wins + losses, min(wins, losses)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """wins, losses, p: the counts are one aggregated row, the test is of those two numbers."""
    found = flips(pairs).first()
    row = [(found.gained, found.lost, exact_mcnemar(found.gained, found.lost))]
    return pairs.sparkSession.createDataFrame(row, "wins long, losses long, p double")


def cascade(a: DataFrame, b: DataFrame, at: float) -> DataFrame:
    """Lane a's answer where its confidence reaches `at`, else lane b's."""
    p = pair_items(a, b)
    use = F.col("conf_a") >= at
    pick = lambda c: F.when(use, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c)
    return p.select("case_id", "gold", pick("pick"), F.when(use, "a").otherwise("b").alias("lane"), pick("ok"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("case_id", "gold", "labels", F.col("probs").alias("pa")).join(b.select("case_id", F.col("probs").alias("pb")), "case_id")


def _picked(df: DataFrame, scores: Column) -> DataFrame:
    return df.withColumn("q", scores).withColumn("pick", F.element_at("labels", argmax_first(F.col("q")) + 1))


def fuse_logs(a: DataFrame, b: DataFrame, floor: float = 1e-6) -> DataFrame:
    """The first largest mean of floored logarithms."""
    log = lambda p: F.log(F.greatest(p, F.lit(floor)))
    return _picked(_both(a, b), F.zip_with("pa", "pb", lambda x, y: F.round((log(x) + log(y)) / 2, 9))).select("case_id", "gold", "pick")


def fuse_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The least sum of ranks, ties low; equal probabilities rank by place."""

    def ranks(c: str) -> Column:
        order = F.array_sort(F.transform(c, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
        places = F.transform(order, lambda s: s["i"])
        return F.transform(c, lambda _, i: F.array_position(places, i))

    sums = F.zip_with(ranks("pa"), ranks("pb"), lambda x, y: -(x + y))
    return _picked(_both(a, b), sums).select("case_id", "gold", "pick")


def blend(a: DataFrame, b: DataFrame, weight: float | None = None, by: Column | None = None) -> DataFrame:
    """Weighted mean of both lanes' probabilities (nine decimals), its first largest and that probability."""
    g = F.lit(weight) if by is None else by
    mixed = _picked(_both(a, b) if by is None else a, F.zip_with("pa", "pb", lambda x, y: F.round(g * x + (1 - g) * y, 9)))
    return mixed.select("case_id", "gold", "pick", F.array_max("q").alias("conf"))


def teacher_gate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blend by the sigmoid of the lanes' difference in accuracy over 0.01."""
    acc = a.agg(F.avg("ok").alias("acc_a")).crossJoin(b.agg(F.avg("ok").alias("acc_b")))  # one row each
    rows = _both(a, b).crossJoin(F.broadcast(acc))
    return blend(rows, b, by=sigmoid((F.col("acc_a") - F.col("acc_b")) / 0.01))


def confusable_pairs(items: DataFrame, least: int, k: int) -> DataFrame:
    """a, b, n: the k unordered pairs most often mistaken for each other, from `least` mistakes on."""
    pair = items.where("ok = 0").groupBy(F.least("gold", "pick").alias("a"), F.greatest("gold", "pick").alias("b"))
    return pair.agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(k)


def ovr_auroc(items: DataFrame, least: int) -> DataFrame:
    """macro_auroc over classes with `least` cases inside and outside, n_classes."""
    long = items.select("gold", F.inline(F.arrays_zip("labels", "probs")))
    long = long.select(F.col("labels").alias("opt"), F.col("probs").alias("score"), (F.col("labels") == F.col("gold")).cast("int").alias("y"))
    size = long.groupBy("opt").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    enough = size.where((F.col("pos") >= least) & (F.col("neg") >= least)).select("opt")
    return auroc(long, "opt").join(enough, "opt").agg(F.avg("auroc").alias("macro_auroc"), F.count("*").alias("n_classes"))


def strata(items: DataFrame, column: str) -> DataFrame:
    """deff: 1 + squared variation of the strata's shares; majority: the largest share."""
    counts = items.groupBy(column).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("t")))
    s = F.col("n") / F.col("t")
    return counts.crossJoin(total).agg((1 + F.var_pop(s) / (F.avg(s) * F.avg(s))).alias("deff"), F.max(s).alias("majority"))


def soft_metrics(items: DataFrame, weight: float) -> DataFrame:
    """Against soft gold with `weight` on the label and the rest spread: mean probability of the label, squared
    distance, total variation and KL."""
    rest = (1.0 - weight) / (F.size("labels") - 1)
    gold = F.transform("labels", lambda x: F.when(x == F.col("gold"), F.lit(weight)).otherwise(rest))
    rows = items.withColumn("q", gold)
    over = lambda f: total(F.zip_with("probs", "q", f))
    hit = F.element_at("probs", F.array_position("labels", F.col("gold")).cast("int"))
    return rows.agg(
        F.avg(hit).alias("soft_acc"),
        F.avg(over(lambda p, q: (p - q) * (p - q))).alias("soft_brier"),
        F.avg(over(lambda p, q: F.abs(p - q)) / 2).alias("tv"),
        F.avg(over(lambda p, q: q * F.log(q / F.greatest(p, F.lit(1e-12))))).alias("kl"),
    )


def score_metrics(items: DataFrame) -> DataFrame:
    """For ordered labels: expected level, mean absolute error and the share within one level."""
    level = total(F.zip_with("labels", "probs", lambda x, p: x * p)) / total(F.col("probs"))
    rows = items.withColumn("level", level)
    off = F.abs(F.col("level") - F.col("gold"))
    return rows.agg(F.avg("level").alias("mean_level"), F.avg(off).alias("mae"), F.avg((off <= 1).cast("int")).alias("within_1"))
