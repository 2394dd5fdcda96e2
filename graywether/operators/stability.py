"""How stable a percentile threshold is: resampled thresholds, their spread, and the curve around the fitted one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.operators.ranking import LEAST_SUPPORT, recommend
from graywether.operators.verdicts import poisson_weights
from graywether.sources.steps import Workspace

#: Fixed values of the published audit: distances around the threshold, the most spread, the drop that is an edge, and the
#: least answers that a resample may leave.
OFFSETS = (0.02, 0.05, 0.1)
MOST_SPREAD = 0.05
EDGE = 2.0
LEAST_PASS, LEAST_SHARE = 10, 0.05


def resampled(obs: DataFrame, rho: float, draws: int = 200) -> DataFrame:
    """axis, draw, threshold, m, n_pass of observations (axis, key, score, ok): in each draw a row counts as often as its
    key and the draw decide; the threshold is the element min(floor(m * rho), m - 1) of the m weighted scores. A draw
    without weight has none.

    Rows are dealt to ranges of the scores and written. A draw's weights are summed a range (a row for a range and draw), which
    tells the range that holds its element; only there weights are summed a score, the range's rows dealt to all tasks.
    """
    ws = Workspace(obs.sparkSession, "resampled")
    ranges = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = obs.where("score is not null").select("axis", "key", "score").repartitionByRange(ranges, "axis", "score")
    dealt = ws.save(rows.withColumn("part", F.spark_partition_id()), "dealt")
    weight = poisson_weights(F.col("key"), F.col("draw")).cast("long")
    every = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    spread = dealt.repartition(ranges, "key")  # a small table may lie in one file
    sums = ws.save(spread.select("axis", "part", "key", every).groupBy("axis", "part", "draw").agg(F.sum(weight).alias("w")), "sums")
    of = W.partitionBy("axis", "draw")
    upto = of.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    parts = sums.withColumns({"_upto": F.sum("w").over(upto), "m": F.sum("w").over(of)}).withColumn("_place", F.least(F.floor(F.col("m") * rho), F.col("m") - 1))
    held = parts.where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("w")))
    held = held.select("axis", "part", "draw", "m", "_place", (F.col("_upto") - F.col("w")).alias("_before"))  # one part a draw
    met = spread.join(F.broadcast(held), ["axis", "part"])
    each = met.groupBy("axis", "draw", "score", "m", "_place", "_before").agg(F.sum(weight).alias("w")).where("w > 0")
    ordered = of.orderBy("score").rowsBetween(W.unboundedPreceding, 0)  # scores of one range
    hit = each.withColumn("_upto", F.col("_before") + F.sum("w").over(ordered))
    hit = hit.where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("w")))
    return hit.select("axis", "draw", F.col("score").alias("threshold"), "m", (F.col("m") - F.col("_upto") + F.col("w")).alias("n_pass"))


def distribution(drawn: DataFrame, draws: int = 200) -> DataFrame:
    """axis, n_none, mean, sd, p05, p95, least, most, vacuous: of the draws' thresholds; vacuous ones leave fewer answers than
    LEAST_PASS or LEAST_SHARE of their rows. The places are floor(n * q)."""
    floor = F.greatest(F.lit(LEAST_PASS), F.floor(F.col("m") * LEAST_SHARE))
    listed = F.sort_array(F.collect_list("threshold"))  # `draws` entries
    at = lambda q: F.get("t", F.least(F.floor(F.size("t") * q), F.size("t") - 1).cast("int"))
    each = drawn.groupBy("axis").agg(
        listed.alias("t"), F.avg("threshold").alias("mean"), F.coalesce(F.stddev_samp("threshold"), F.lit(0.0)).alias("sd"), F.count_if(F.col("n_pass") < floor).alias("vacuous")
    )
    return each.select(
        "axis", (F.lit(draws) - F.size("t")).cast("long").alias("n_none"), "mean", "sd", at(0.05).alias("p05"), at(0.95).alias("p95"), F.array_min("t").alias("least"), F.array_max("t").alias("most"), "vacuous"
    )


def curve(obs: DataFrame, fitted: DataFrame) -> DataFrame:
    """axis, place, threshold, accuracy, n_pass, pass_rate of observations at the fitted threshold (axis, threshold) and the
    OFFSETS around it; place is the distance in steps, negative below. One pass over the rows."""
    steps = [(0, 0.0), *((s * (i + 1), s * o) for i, o in enumerate(OFFSETS) for s in (-1, 1))]
    points = F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(o).alias("by")) for i, o in steps)))
    asked = fitted.where("threshold is not null").select("axis", "threshold", points)  # a few rows an axis
    asked = asked.select("axis", "place", F.round(F.col("threshold") + F.col("by"), 9).alias("threshold"))
    met = obs.where("score is not null").join(F.broadcast(asked), "axis")
    above = F.col("score") >= F.col("threshold")
    return met.groupBy("axis", "place", "threshold").agg(
        F.avg(F.when(above, F.col("ok").cast("double"))).alias("accuracy"), F.count_if(above).alias("n_pass"), F.avg(above.cast("double")).alias("pass_rate")
    )


def cells(cal: DataFrame, held: DataFrame, rho: float, draws: int = 200) -> DataFrame:
    """axis, n, threshold, the distribution's columns, edge, stable: the verdict on each axis of calibration observations (axis, key,
    score, ok), the curve taken from held-out ones. edge names the metric that the nearest neighbour halves. Axes with
    fewer than LEAST_SUPPORT observations have no threshold and aren't stable."""
    fitted = recommend(cal, rho=rho).select("axis", "n", "threshold")
    enough = fitted.where(F.col("n") >= LEAST_SUPPORT)
    spread = distribution(resampled(cal.join(F.broadcast(enough.select("axis")), "axis", "left_semi"), rho, draws), draws)
    points = curve(held, fitted)
    star = points.where("place = 0").select("axis", F.col("accuracy").alias("sa"), F.col("pass_rate").alias("sp"))
    near = points.where("abs(place) = 1").join(star, "axis")
    by = lambda c, s: F.max(F.when((F.col(c) > 0) & (F.col(s) / F.col(c) >= EDGE), 1).otherwise(0))
    edges = near.groupBy("axis").agg(by("pass_rate", "sp").alias("ep"), by("accuracy", "sa").alias("ea"))
    edge = F.when(F.col("ep") == 1, "pass_rate").when(F.col("ea") == 1, "accuracy").otherwise("none")
    joined = fitted.join(spread, "axis", "left").join(edges, "axis", "left")
    stable = F.coalesce((F.col("sd") <= MOST_SPREAD) & (F.col("vacuous") == 0) & (edge == "none"), F.lit(False))
    return joined.select("axis", "n", "threshold", "n_none", "mean", "sd", "p05", "p95", "least", "most", "vacuous", edge.alias("edge"), stable.cast("int").alias("stable"))
