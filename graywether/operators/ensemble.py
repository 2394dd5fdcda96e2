"""Ensembles of answers under dropped features: samples by a hash, folded into counts and moments of each option.

Sample 0 drops nothing and is the plain answer. A sample is a row of its case until the fold, which is one aggregation
with map-side partials, so the number of samples costs time and no memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.functions.maths import dot, unit
from graywether.operators.vectors import answer


def dropped(key: Column, sample: Column, dims: Column, rate: float) -> Column:
    """An array over dimensions, true where the sample drops it: a byte of the MD5 of key, sample and 16 dimensions' number
    is under rate * 256. Sample 0 drops none. Each MD5 is taken once."""
    most = int(rate * 256)
    numbers = F.sequence(F.lit(0), F.floor((dims - 1) / 16).cast("int"))
    # bytes are compared as two hex digits
    under = lambda h: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(h, 2 * i + 1, F.lit(2)) < f"{most:02x}" if most < 256 else F.lit(True))
    block = lambda b: F.md5(F.concat_ws(":", key.cast("string"), sample.cast("string"), b.cast("string")))
    bound = F.flatten(F.transform(F.transform(numbers, block), under))
    return F.when(sample > 0, F.slice(bound, F.lit(1), dims)).otherwise(F.array_repeat(F.lit(False), dims))


def samples(vectors: DataFrame, cents: DataFrame, n: int, rate: float, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """sample and the items (case_id, gold, pick, labels, probs, conf, ok) of each vector under n samples."""
    domains = F.broadcast(cents.agg(F.sort_array(F.collect_list(F.struct("label", "dir"))).alias("domains")))  # one row, a label each
    rows = vectors.select(F.col(key).alias("case_id"), F.col(label).alias("gold"), unit(F.col(vector)).alias("u"))
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("_mask", dropped(F.col("case_id"), F.col("sample"), F.size("u"), rate))
    rows = rows.withColumn("u", unit(F.zip_with("u", "_mask", lambda x, d: F.when(d, 0.0).otherwise(x)))).crossJoin(domains)
    routed = rows.select(
        F.struct("case_id", "sample").alias("case_id"),
        "gold",
        F.transform("domains", lambda d: d["label"]).alias("labels"),
        F.transform("domains", lambda d: dot(F.col("u"), d["dir"])).alias("dots"),
    )
    return answer(routed).select("case_id.sample", "case_id.case_id", "gold", "pick", "labels", "probs", "conf", "ok")


def fold(sampled: DataFrame) -> DataFrame:
    """case_id, gold, opt, n, picks, mean, sigma: how often each option is picked, and its probability's moments."""
    long = sampled.select("case_id", "gold", "pick", F.inline(F.arrays_zip("labels", "probs")))
    return long.groupBy("case_id", "gold", F.col("labels").alias("opt")).agg(
        F.count("*").alias("n"), F.sum((F.col("pick") == F.col("labels")).cast("long")).alias("picks"), F.avg("probs").alias("mean"), F.stddev_pop("probs").alias("sigma")
    )


def readouts(folded: DataFrame, lam: float = 1.0) -> DataFrame:
    """case_id, gold, majority, by_mean, by_bound, u_pair, u_bon: picks by counts, by mean probability and by mean less lam
    sigma (ties to the lesser option), the chance that two samples disagree, and the share of samples off the majority."""
    first = lambda x: F.min(F.struct((-F.round(x, 9)).alias("o"), F.col("opt").alias("opt")))["opt"]
    n, c = F.col("n"), F.col("picks")
    return folded.groupBy("case_id", "gold").agg(
        first(c.cast("double")).alias("majority"),
        first(F.col("mean")).alias("by_mean"),
        first(F.col("mean") - lam * F.col("sigma")).alias("by_bound"),
        F.coalesce(1 - F.sum(c * (c - 1)) / F.nullif(F.max(n) * (F.max(n) - 1), F.lit(0)), F.lit(0.0)).alias("u_pair"),
        (1 - F.max(c) / F.max(n)).alias("u_bon"),
    )


def rules(read: DataFrame) -> DataFrame:
    """One row: n, accuracy of each rule, and how many cases' pick by the bound differs from that by the mean."""
    right = lambda c: F.avg((F.col(c) == F.col("gold")).cast("double")).alias(c)
    return read.agg(F.count("*").alias("n"), right("majority"), right("by_mean"), right("by_bound"), F.count_if(F.col("by_bound") != F.col("by_mean")).alias("bound_flips"))
