"""Domains as unit centroids: routing, route scores and gates.

The domains of one engine are few (a corpus folder holds 8 at most, the test table 10 labels), so the centroids are
one row with an array: a broadcast of known size, whatever the number of vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywether.functions.maths import argmax_first, dot, gate_confidence, readout, shares, sigmoid, unit
from graywether.operators.similar import most_similar


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, dir: the mean of the label's unit vectors, scaled to length 1. One shuffle of partial sums."""
    rows = vectors.select(F.col(label).alias("label"), F.posexplode(unit(F.col(vector))).alias("dim", "x"))
    means = rows.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("p"))
    return packed.select("label", unit(F.transform("p", lambda s: s["x"])).alias("dir"))


def _packed(cents: DataFrame) -> DataFrame:
    """One row: labels and directions of all domains, by label."""
    all_of = cents.agg(F.sort_array(F.collect_list(F.struct("label", "dir"))).alias("domains"))
    return F.broadcast(all_of)


def route(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """case_id, gold, labels, dots (by label), pick: the label of the first largest dot."""
    joined = vectors.select(F.col(key).alias("case_id"), F.col(label).alias("gold"), unit(F.col(vector)).alias("u")).crossJoin(_packed(cents))
    routed = joined.select(
        "case_id", "gold", "u", F.transform("domains", lambda d: d["label"]).alias("labels"), F.transform("domains", lambda d: dot(F.col("u"), d["dir"])).alias("dots")
    )
    return routed.withColumn("pick", F.element_at("labels", argmax_first(F.transform("dots", lambda x: F.round(x, 9))) + 1))


def answer(routed: DataFrame, scale: float = 8.0) -> DataFrame:
    """Items: case_id, gold, pick, labels, probs (sigmoid of scaled dots, as shares; six decimals), conf, ok."""
    probs = shares(F.transform("dots", lambda d: sigmoid(scale * (d - 0.35))))
    out = routed.withColumn("probs", F.transform(probs, lambda p: F.round(p, 6)))
    return out.select(
        "case_id",
        "gold",
        F.element_at("labels", argmax_first(F.col("probs")) + 1).alias("pick"),
        "labels",
        "probs",
        F.round(F.array_max("probs"), 6).alias("conf"),
        (F.element_at("labels", argmax_first(F.col("probs")) + 1) == F.col("gold")).cast("int").alias("ok"),
    )


def confidences(items: DataFrame) -> DataFrame:
    """The three readouts of every item."""
    return items.select("case_id", *[F.round(readout(F.col("probs"), k), 6).alias(k) for k in ("dispatch", "max_prob", "inv_entropy")])


def max_similarity(routed: DataFrame, vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """case_id, pick, max_sim, gate: the largest cosine to a row of the routed domain (the case itself left out).

    A domain's cases and rows meet in tiles of blocks.
    """
    corpus = vectors.select(F.col(label).alias("grp"), F.col(key).alias("id"), unit(F.col(vector)).alias("u"), F.col(label).alias("pick"))
    met = most_similar(routed.select(F.col("pick").alias("grp"), F.col("case_id").alias("id"), "u"), corpus, 1, "pick")
    best = met.groupBy("case_id", "pick").agg(F.max("sim").alias("max_sim"))
    return best.select("case_id", "pick", F.round("max_sim", 6).alias("max_sim"), F.round(gate_confidence(F.col("max_sim")), 6).alias("gate"))
