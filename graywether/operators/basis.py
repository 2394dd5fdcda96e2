"""Certificates of a basis: do the differences that a change of presentation makes lie in few directions?

Everything comes from second moments, summed over tasks: the population's covariance gives the whitening, the pairs'
moment in the whitened space gives a spectrum, and held-out pairs' moments tell what that spectrum's leading directions
miss. The driver gets matrices of dims x dims (MOST_DIMS at most).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywether.operators.features import moments

#: Fixed values of the published certificate: the least gap of the spectrum, and the share of the mean variance that keeps solves sound.
GAP = 4.0
SHRINK = 1e-8
MOST_DIMS = 2048


@dataclass(frozen=True)
class Certificate:
    """verdict: certified, unidentified_insufficient_pairs or unidentified_no_gap. spectrum falls; directions (k unit vectors of the raw
    space) and leakage (by family, the share of whitened energy outside them) are None unless certified."""

    verdict: str
    n_pairs: int
    n_population: int
    spectrum: np.ndarray
    k: int | None = None
    gap: float | None = None
    directions: np.ndarray | None = None
    leakage: dict[str, float] | None = None


def whitening(second: np.ndarray, n: float, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and plain square root of the covariance, its variances raised by SHRINK of their mean."""
    cov = second / n - np.outer(total, total) / n**2
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values = np.maximum(values, 0) + SHRINK * max(np.trace(cov) / len(cov), 1e-300)
    return (vectors / np.sqrt(values)) @ vectors.T, (vectors * np.sqrt(values)) @ vectors.T


def certify(population: DataFrame, pairs: DataFrame, dims: int, gap: float = GAP) -> Certificate:
    """population: vector; pairs: family (`fit`, or the name of a family held against it), vector (a difference). Fewer fitted
    pairs than dims don't identify a spectrum; null vectors and those of another length are left out."""
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions: {MOST_DIMS} at most")
    unpack = lambda m: np.frombuffer(m, np.float64).reshape(dims + 1, dims + 1)
    seen = moments(population.select(F.lit(0).alias("one"), "vector"), ["one"], dims).collect()  # one row
    families = {r.family: unpack(r.m) for r in moments(pairs, ["family"], dims).collect()}  # a row a family
    n_pop = int(unpack(seen[0].m)[0, 0]) if seen else 0
    fit = families.pop("fit", np.zeros((dims + 1, dims + 1)))
    n = int(fit[0, 0])
    if n < dims or n_pop < 2:
        return Certificate("unidentified_insufficient_pairs", n, n_pop, np.array([]))
    pop = unpack(seen[0].m)
    white, back = whitening(pop[1:, 1:], pop[0, 0], pop[0, 1:])
    moment = white @ (fit[1:, 1:] / n) @ white
    moment = (moment + moment.T) / 2 + SHRINK * np.trace(moment) / dims * np.eye(dims)
    values, vectors = np.linalg.eigh(moment)
    values, vectors = values[::-1], vectors[:, ::-1]
    ratios = values[:-1] / np.maximum(values[1:], 1e-300)
    k = int(ratios.argmax()) + 1
    if ratios[k - 1] < gap:
        return Certificate("unidentified_no_gap", n, n_pop, values, gap=float(ratios[k - 1]))
    lead = vectors[:, :k]
    leakage = {}
    for family, m in families.items():
        moved = white @ m[1:, 1:] @ white
        energy = np.trace(moved)
        if energy > 0:
            leakage[family] = float(1 - np.trace(lead.T @ moved @ lead) / energy)
    raw = back @ lead
    return Certificate("certified", n, n_pop, values, k, float(ratios[k - 1]), (raw / np.linalg.norm(raw, axis=0)).T, leakage)


def moved(rows: DataFrame, directions: np.ndarray, step: float, carry: list[str]) -> DataFrame:
    """carry, direction, vector: every vector moved by `step` along each direction and scaled to length 1 again; direction -1 is the vector itself."""
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, (step * d).tolist())).alias("d")) for i, d in enumerate(directions)))
    zero = F.array(F.struct(F.lit(-1).alias("i"), F.array(*[F.lit(0.0)] * directions.shape[1]).alias("d")))
    long = rows.select(*carry, "vector", F.explode(F.concat(zero, listed)).alias("p"))
    shifted = F.zip_with("vector", "p.d", lambda x, y: x.cast("double") + y)
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    out = long.select(*carry, F.col("p.i").alias("direction"), shifted.alias("v"))
    return out.select(*carry, "direction", F.when(norm == 0, F.col("v")).otherwise(F.transform("v", lambda x: x / norm)).alias("vector"))
