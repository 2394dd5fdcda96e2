"""Probes of answers: permutations, kernels, neighbours, discriminants, drift, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions.maths import argmax_first, dot, sigmoid, total, unit
from graywether.operators.ordered import running
from graywether.operators.similar import most_similar
from graywether.sources.steps import Workspace


def spread(runs: DataFrame) -> DataFrame:
    """case_id, swing, flip, margin over the runs (case_id, k, pick, conf) of a case."""
    return runs.groupBy("case_id").agg(
        (F.max("conf") - F.min("conf")).alias("swing"), (F.count_distinct("pick") > 1).cast("int").alias("flip"), F.avg("conf").alias("mean_conf")
    )


def far_class(probs: DataFrame) -> DataFrame:
    """case_id, pick, far: the class with the largest distance to the pick, ties low."""
    last = F.size("labels") - 1
    at = argmax_first(F.col("probs"))
    far = F.when(at >= last - at, 0).otherwise(last)
    return probs.select("case_id", "pick", F.get("labels", far).alias("far"))


def neighbours(vectors: DataFrame, k: int, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """case_id, row_id, label, sim, rank: the k most similar rows of every row, itself left out.

    Rows meet in tiles of blocks, so a task holds two blocks and not the table; each tile keeps k a row before the
    shuffle by row. All pairs are compared: this is the exact form, for labelled pools that are capped per label.
    """
    rows = vectors.select(F.lit(0).alias("grp"), F.col(key).alias("id"), F.col(label).alias("label"), unit(F.col(vector)).alias("u"))
    met = most_similar(rows, rows, k, "label").select("case_id", "row_id", "label", F.round("sim", 6).alias("sim"))
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("sim"), "row_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def smooth_labels(near: DataFrame) -> DataFrame:
    """case_id, label, mass: the label with most weight among a row's neighbours; weights are sigmoid(20 (sim - 0.3))."""
    mass = near.groupBy("case_id", "label").agg(F.round(F.sum(sigmoid(20.0 * (F.col("sim") - 0.3))), 6).alias("mass"))
    best = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("mass"), "label"))
    return mass.withColumn("r", best).where("r = 1").drop("r")


def label_means(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, dim, mean, n: per-label means of every dimension."""
    long = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x"))
    return long.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def pooled_variance(vectors: DataFrame, label: str = "label", vector: str = "embedding", shrink: float = 0.01) -> DataFrame:
    """dim, var: variance around the labels' means, pooled, shrunk towards its average by `shrink`."""
    long = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x"))
    per = long.groupBy("label", "dim").agg(F.var_pop(F.col("x").cast("double")).alias("v"), F.count("*").alias("n"))
    pooled = per.groupBy("dim").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("var"))
    mean = F.broadcast(pooled.agg(F.avg("var").alias("m")))  # one row
    return pooled.crossJoin(mean).select("dim", ((1 - shrink) * F.col("var") + shrink * F.col("m")).alias("var"))


def discriminants(vectors: DataFrame, means: DataFrame, var: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """case_id, gold, opt, delta: linear discriminants of diagonal LDA, sum over dimensions of x m / v - m^2 / 2 v.

    The model is labels times dimensions numbers and is joined as one array a label.
    """
    model = means.join(var, "dim").groupBy(F.col("label").alias("opt")).agg(
        F.sort_array(F.collect_list(F.struct("dim", (F.col("mean") / F.col("var")).alias("w"), (F.col("mean") ** 2 / (2 * F.col("var"))).alias("c")))).alias("m")
    )
    model = model.select("opt", F.transform("m", lambda s: s["w"]).alias("w"), total(F.transform("m", lambda s: s["c"])).alias("c"))
    rows = vectors.select(F.col(key).alias("case_id"), F.col(label).alias("gold"), F.col(vector).alias("x"))
    return rows.crossJoin(F.broadcast(model)).select("case_id", "gold", "opt", (dot(F.col("x"), F.col("w")) - F.col("c")).alias("delta"))


def drift(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by, least, most, p05, p50, p90, n: places ceil(q n) - 1 in counts per distinct value."""
    each = rows.groupBy(by, F.col(x).alias("x")).agg(F.count("*").alias("c"))
    placed = running(each, "x", ["c"], (by,)).select("*", (F.col("c_upto") - 1).alias("last"), F.col("c_all").alias("n"))
    at = lambda q: F.max(F.when((F.ceil(F.col("n") * q) - 1 <= F.col("last")) & (F.ceil(F.col("n") * q) - 1 > F.col("last") - F.col("c")), F.col("x")))
    return placed.groupBy(by).agg(F.min("x").alias("least"), F.max("x").alias("most"), at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n").alias("n"))


def stride(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows evenly strided in order: those at floor(i * size / n). Places come from ranges of the order, each
    numbered on its own, plus the sizes of the ranges before (a row a range)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the ranges are drawn from a sample and both uses have to see the same
    dealt = Workspace(rows.sparkSession, "stride").save(rows.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "dealt")
    own = dealt.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("pn"))
    before = F.coalesce(F.sum("pn").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).withColumn("size", F.sum("pn").over(W.partitionBy()))
    placed = own.join(F.broadcast(sizes.select("part", "before", "size")), "part").withColumn("place", F.col("r") + F.col("before"))
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("size") / n))
    return placed.where((F.col("size") <= n) | F.array_contains(picked, F.col("place")))


def pair_kernel(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, mean_cos: mean cosine of a label's pairs, from the sum of its unit vectors: no pair is made."""
    long = vectors.select(F.col(label).alias("label"), F.posexplode(unit(F.col(vector))).alias("dim", "x"))
    sums = long.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") ** 2).alias("q"), F.max("n").alias("n"))
    return per.select("label", "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))).alias("mean_cos"))


def option_table(events: DataFrame) -> DataFrame:
    """qid, option, tok, n_in, n_out of events (qid, option, tok): counts of the option and of the question's others."""
    own = events.groupBy("qid", "option", "tok").agg(F.count("*").alias("n_in"))
    whole = own.groupBy("qid", "tok").agg(F.sum("n_in").alias("n_all"))
    return own.join(whole, ["qid", "tok"]).select("qid", "option", "tok", "n_in", (F.col("n_all") - F.col("n_in")).alias("n_out"))
