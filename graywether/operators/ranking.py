"""Thresholds, percentiles, gates and histograms over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.operators.ordered import running


def percentiles(xs: DataFrame, rates: list[float]) -> DataFrame:
    """rate, threshold: element min(floor(n * rate), n - 1) of x in ascending order.

    Places are found in counts per distinct value, summed range by range.
    """
    each = running(xs.groupBy("x").agg(F.count("*").alias("n")), "x", ["n"])
    asked = F.inline(F.array(*[F.struct(F.lit(float(r)).alias("rate")) for r in rates]))
    rows = each.select("x", "n", "n_upto", "n_all", asked)
    place = F.least(F.floor(F.col("n_all") * F.col("rate")), F.col("n_all") - 1)
    return rows.where((place < F.col("n_upto")) & (place >= F.col("n_upto") - F.col("n"))).select("rate", F.col("x").alias("threshold"))


def curve_points(items: DataFrame) -> DataFrame:
    """threshold, support, accuracy, pass_rate at every distinct confidence: the items at or above it."""
    each = items.groupBy(F.col("conf").alias("threshold")).agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    sums = running(each, "threshold", ["n", "k"], desc=True)
    return sums.select(
        "threshold", F.col("n_upto").alias("support"), (F.col("k_upto") / F.col("n_upto")).alias("accuracy"), (F.col("n_upto") / F.col("n_all")).alias("pass_rate")
    )


#: Fewer observations of an axis give no recommendation.
LEAST_SUPPORT = 16


def recommend(observations: DataFrame, rho: float | None = None, target: float | None = None) -> DataFrame:
    """axis, threshold, status, accuracy, n, n_pass, n_abstain: a cutoff for each axis of observations (axis, score, ok).

    rho: the element min(floor(n * rho), n - 1) of the scores. target: the lowest cutoff at or above which the accuracy is
    the target, else the one of the best accuracy (of equals the lowest), status target_unmet. Accuracy and counts are
    those at or above the cutoff, ties included. With fewer than LEAST_SUPPORT observations all but axis and n are null.
    """
    if (rho is None) == (target is None):
        raise ValueError("either rho or target")
    each = observations.where("score is not null").groupBy("axis", "score").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("k"))
    sums = running(each, "score", ["n", "k"], by=("axis",), desc=True)
    accuracy = F.col("k_upto") / F.col("n_upto")
    point = F.struct("score", accuracy.alias("accuracy"), F.col("n_upto").alias("n_pass"))
    if target is None:
        place = F.least(F.floor(F.col("n_all") * rho), F.col("n_all") - 1)
        # n_all - n_upto scores are below this one
        hit = (place >= F.col("n_all") - F.col("n_upto")) & (place < F.col("n_all") - F.col("n_upto") + F.col("n"))
        best, status = F.max(F.when(hit, point)), F.lit("fitted")
    else:
        met = F.min(F.when(accuracy >= target, F.struct("score", point.alias("p"))))
        top = F.min(F.struct((-F.round(accuracy, 12)).alias("o"), "score", point.alias("p")))
        best, status = F.coalesce(met["p"], top["p"]), F.when(met.isNotNull(), "fitted").otherwise("target_unmet")
    found = sums.groupBy("axis").agg(F.max("n_all").alias("n"), best.alias("b"), status.alias("s"))
    enough = F.col("n") >= LEAST_SUPPORT
    when = lambda c: F.when(enough, c)
    return found.select(
        "axis", when(F.col("b.score")).alias("threshold"), when(F.col("s")).alias("status"), when(F.col("b.accuracy")).alias("accuracy"), "n",
        when(F.col("b.n_pass")).alias("n_pass"), when(F.col("n") - F.col("b.n_pass")).alias("n_abstain"),
    )


def target_threshold(items: DataFrame, target: float) -> DataFrame:
    """threshold, support, accuracy, met: the lowest threshold whose items reach the target accuracy, else the best
    (of equals the one that passes more)."""
    points = curve_points(items).withColumn("met", F.col("accuracy") >= target)
    order = [F.desc("met"), F.when(F.col("met"), F.col("threshold")).asc(), F.round("accuracy", 12).desc(), F.desc("support")]
    return points.orderBy(*order).limit(1).select("threshold", "support", "accuracy", "met")


def abstain(items: DataFrame, score_at: float, gate_at: float) -> DataFrame:
    """items with cause: the first gate that declines, or answered."""
    cause = F.when(F.col("conf") < score_at, "score_gate").when(F.col("gate") < gate_at, "distance_gate").otherwise("answered")
    return items.withColumn("cause", cause)


def selective(gated: DataFrame) -> DataFrame:
    answered = F.col("cause") == "answered"
    return gated.agg(F.avg((~answered).cast("int")).alias("abstain_rate"), F.avg(F.when(answered, F.col("ok"))).alias("answered_accuracy"), F.count("*").alias("n"))


def histogram(xs: DataFrame, bins: int, smooth: float = 0.0) -> DataFrame:
    """bin, n, share of x in [0, 1]; the last bin is closed, empty bins are listed, shares are smoothed."""
    counts = xs.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("x") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    every = xs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))
    total = F.sum("n").over(W.partitionBy())  # a row for each bin
    return joined.select("bin", "n", ((F.col("n") + smooth) / (total + smooth * bins)).alias("share"))
