"""Scalar functions over probabilities and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this many options the dispatch readout is 1 - H / ln K, beyond it the largest probability.
DISPATCH_OPTIONS = 8
EPS = 1e-12


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = EPS) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(xs: Column) -> Column:
    """xs scaled to length 1; an all-zero vector stays as it is. The length is bound once, not worked out for each element."""
    norm = lambda s: F.when(s == 0, 1.0).otherwise(F.sqrt(s))
    square = lambda s, x: s + x.cast("double") * x.cast("double")
    return F.aggregate(xs, F.lit(0.0), square, lambda s: F.transform(xs, lambda x: x.cast("double") / norm(s)))


def shares(xs: Column) -> Column:
    """xs divided by their sum; even shares if they sum to 0. The sum is bound once."""
    each = lambda s: F.transform(xs, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(xs)))
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x, each)


def argmax_first(xs: Column) -> Column:
    """Index of the largest element, the first of equals."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def entropy(ps: Column) -> Column:
    """Shannon entropy in nats; zero probabilities add nothing."""
    return total(F.transform(ps, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)))


def normalised_entropy(ps: Column) -> Column:
    """H / ln K, held in [0, 1]; 0 for one option."""
    k = F.size(ps)
    return F.when(k <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy(ps) / F.log(k.cast("double")))))


def readout(ps: Column, kind: str = "dispatch") -> Column:
    """Confidence of a distribution: dispatch, max_prob or inv_entropy."""
    inverse, largest = 1.0 - normalised_entropy(ps), F.array_max(ps)
    if kind == "max_prob":
        return largest
    if kind == "inv_entropy":
        return inverse
    return F.when(F.size(ps) <= DISPATCH_OPTIONS, inverse).otherwise(largest)


def gate_confidence(similarity: Column) -> Column:
    return sigmoid(8.0 * (similarity - 0.35))


def skill(s: Column, chance: Column) -> Column:
    """Share of what chance leaves, held in [0, 1]; 0 where chance is (nearly) 1."""
    return F.when(1 - chance < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - chance) / (1 - chance))))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of k successes in n; (0, 1) for none."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    return (
        F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)),
        F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high)),
    )


def ece_bin(conf: Column, bins: int = 15) -> Column:
    """Bin of a confidence, left-open and right-closed, from 0; null for 0.0, which is in no bin."""
    return F.when((conf > 0) & (conf <= 1), F.least(F.lit(bins - 1), (F.ceil(conf * bins) - 1).cast("int")))


def wire(v: Column) -> Column:
    """Six decimals, nothing negative."""
    return F.round(F.greatest(v, F.lit(0.0)) * 1e6) / 1e6
