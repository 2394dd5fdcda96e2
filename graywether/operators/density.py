"""Two-density support gates: diagonal mixtures of a domain's projected vectors against one of all domains.

The expectation step runs in Arrow batches, the maximisation step is a sum over tasks; one job moves the mixtures of all
domains and folds together. The driver holds their parameters (at most MOST_NUMBERS, else an error). With folds, a
row's mixtures come from the rows of other folds. The start is fixed: a mixture's means are the COMPONENTS rows whose
keys hash least, its variances those of all its rows, its weights even; so fits can be repeated up to the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions.maths import sigmoid
from graywether.operators.features import summed
from graywether.sources.steps import Workspace

#: Fixed values of the published gate.
COMPONENTS = 16
PROJECTED = 64
#: Steps of a fit, the least variance, the count below which a component keeps its place.
STEPS = 8
VAR_FLOOR = 1e-4
LEAST_COUNT = 1e-6
MOST_NUMBERS = 16_000_000
POOLED = -1


def sign_matrix(dims: int, out: int, seed: int) -> np.ndarray:
    """A random projection of entries +-1 / sqrt(out), by a hash of row and column."""
    x = np.arange(dims * out, dtype=np.uint64) + np.uint64(seed)
    x = x * np.uint64(2654435761) % np.uint64(1 << 32)
    x = (x ^ x >> np.uint64(16)) * np.uint64(73244475) % np.uint64(1 << 32)
    bit = (x >> np.uint64(15) & np.uint64(1)).astype(np.float64)
    return (2 * bit - 1).reshape(dims, out) / np.sqrt(out)


def projected(rows: DataFrame, carry: list[str], dims: int, out: int = PROJECTED, seed: int = 1) -> DataFrame:
    """carry, x: vectors (column vector, of length dims) projected to `out` dimensions; null and odd-sized ones are left out."""
    matrix = sign_matrix(dims, out, seed)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(len(carry)).flatten(), dtype=np.float64).reshape(batch.num_rows, dims)
            x = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out), pa.array((v @ matrix).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], x], names=[*carry, "x"])

    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return rows.where(F.size("vector") == dims).select(*carry, "vector").mapInArrow(run, f"{carried}, x array<double>")


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_terms(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, rows by components."""
        out = np.empty((len(x), len(self.weight)))
        with np.errstate(divide="ignore"):
            base = np.log(self.weight) - 0.5 * np.log(2 * np.pi * self.var).sum(axis=1)
        for k in range(len(self.weight)):
            out[:, k] = base[k] - 0.5 * ((x - self.mean[k]) ** 2 / self.var[k]).sum(axis=1)
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        terms = self.log_terms(x)
        top = terms.max(axis=1)
        return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Components by (count, sums of x, sums of x squared), and a last row with the log-likelihood and the rows."""
        terms, total = self.log_terms(x), self.log_density(x)
        r = np.exp(terms - total[:, None])
        last = np.zeros((1, 1 + 2 * x.shape[1]))
        last[0, 0], last[0, 1] = total.sum(), len(x)
        return np.vstack([np.hstack([r.sum(axis=0)[:, None], r.T @ x, r.T @ (x * x)]), last])

    def moved(self, sums: np.ndarray) -> Mixture:
        d = self.mean.shape[1]
        count = sums[:-1, 0]
        safe = np.maximum(count, LEAST_COUNT)[:, None]
        mean, square = sums[:-1, 1 : 1 + d] / safe, sums[:-1, 1 + d :] / safe
        live = (count >= LEAST_COUNT)[:, None]
        mean = np.where(live, mean, self.mean)
        var = np.where(live, np.maximum(square - mean * mean, VAR_FLOOR), self.var)
        return Mixture(count / sums[-1, 1], mean, var)


@dataclass
class Gates:
    """mixtures[fold, label's place or POOLED]; history: fold, model, step, mean log-likelihood before the step."""

    labels: tuple
    crossed: bool
    mixtures: dict[tuple[int, int], Mixture] = field(default_factory=dict)
    history: list[tuple[int, int, int, float]] = field(default_factory=list)


def start(rows: DataFrame, components: int, folds: list[int], crossed: bool) -> dict[tuple[int, int], Mixture]:
    """The first mixtures of rows (key, place, fold, x): place is the label's, each row counts for its own and POOLED."""
    model = F.explode(F.array(F.lit(POOLED), F.col("place"))).alias("model")
    to = F.explode(F.array(*map(F.lit, folds))).alias("to")
    long = rows.select("key", "fold", "x", model).select("key", "fold", "x", "model", to)
    long = long.where("to <> fold") if crossed else long
    order = F.pmod(F.col("key") * 2654435761, F.lit(1 << 32))
    rank = F.row_number().over(W.partitionBy("to", "model").orderBy(order, "key"))  # Spark keeps `components` a task
    firsts = long.withColumn("rank", rank).where(F.col("rank") <= components).select("to", "model", "rank", "x").collect()
    dims = long.select("to", "model", F.posexplode("x").alias("dim", "v")).groupBy("to", "model", "dim").agg(F.var_pop("v").alias("var")).collect()
    var: dict[tuple[int, int], dict[int, float]] = {}
    for r in dims:
        var.setdefault((r.to, r.model), {})[r.dim] = max(r["var"], VAR_FLOOR)
    means: dict[tuple[int, int], list] = {}
    for r in sorted(firsts, key=lambda r: r["rank"]):
        means.setdefault((r.to, r.model), []).append(r.x)
    out = {}
    for key, listed in means.items():
        spread = np.array([var[key][i] for i in range(len(var[key]))])
        out[key] = Mixture(np.full(len(listed), 1 / len(listed)), np.array(listed), np.tile(spread, (len(listed), 1)))
    return out


def fit(rows: DataFrame, components: int = COMPONENTS, steps: int = STEPS, crossed: bool = True) -> Gates:
    """Gates of rows (key long, label, fold, x). Null labels and vectors are left out; a model with fewer rows than components
    has as many components as rows."""
    ws = Workspace(rows.sparkSession, "density")
    rows = rows.where("label is not null and x is not null").select("key", "label", (F.col("fold") if crossed else F.lit(0)).cast("int").alias("fold"), "x")
    rows = ws.save(rows, "rows")
    seen = rows.groupBy("label", "fold").agg(F.max(F.size("x")).alias("d")).collect()  # a row a label and fold
    labels, folds = tuple(sorted({r.label for r in seen})), sorted({r.fold for r in seen})
    numbers = len(folds) * (len(labels) + 1) * components * 2 * max((r.d for r in seen), default=0)
    if numbers > MOST_NUMBERS:
        raise ValueError(f"{numbers} parameters: {MOST_NUMBERS} at most")
    gates = Gates(labels, crossed)
    if not labels:
        return gates
    places = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], f"label {rows.schema['label'].dataType.simpleString()}, place int")
    placed = ws.save(rows.join(F.broadcast(places), "label").drop("label"), "placed")  # a row a label
    gates.mixtures = start(placed, components, folds, crossed and len(folds) > 1)
    read = placed.select("fold", "place", "x")
    for step in range(steps):
        mixtures = dict(gates.mixtures)

        def expect(batches: Iterator[pa.RecordBatch], mixtures=mixtures) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    fold, place = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                    x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
                    for (to, model), mixture in mixtures.items():
                        mine = ((fold != to) | (not gates.crossed) | (len(folds) == 1)) & ((place == model) | (model == POOLED))
                        if mine.any():
                            part = mixture.sums(x[mine])
                            sums[to, model] = sums[to, model] + part if (to, model) in sums else part
            names = ["to", "model", "m"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=names
            )

        for r in summed(read.mapInArrow(expect, "to int, model int, m binary"), ["to", "model"], "float64").collect():  # a row a mixture
            mixture = gates.mixtures[r.to, r.model]
            total = np.frombuffer(r.m, np.float64).reshape(len(mixture.weight) + 1, -1)
            gates.history.append((r.to, r.model, step, total[-1, 0] / total[-1, 1]))
            gates.mixtures[r.to, r.model] = mixture.moved(total)
    return gates


def confidences(rows: DataFrame, gates: Gates, carry: list[str], tau: float = 1.0) -> DataFrame:
    """carry, support, confidence of rows (pick, fold, x): the log-density ratio of the picked label's mixture to the pooled one,
    and its sigmoid at temperature tau; null where the label or the fold has no mixture."""
    place = {x: i for i, x in enumerate(gates.labels)}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(carry)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                model = np.array([place.get(v, len(place)) for v in batch.column(n).to_pylist()])
                fold = np.asarray(batch.column(n + 1))
                x = np.asarray(batch.column(n + 2).flatten()).reshape(batch.num_rows, -1)
                ratio = np.full(batch.num_rows, np.nan)
                for f in np.unique(fold):
                    for m in np.unique(model[fold == f]):
                        if (int(f), int(m)) in gates.mixtures:
                            mine = (fold == f) & (model == m)
                            ratio[mine] = gates.mixtures[int(f), int(m)].log_density(x[mine]) - gates.mixtures[int(f), POOLED].log_density(x[mine])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ratio, from_pandas=True)], names=[*carry, "support"])

    fold = (F.col("fold") if gates.crossed else F.lit(0)).cast("int").alias("_fold")
    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    found = rows.select(*carry, "pick", fold, "x").mapInArrow(run, f"{carried}, support double")
    return found.withColumn("confidence", sigmoid(F.col("support") / tau))


def declined(scored: DataFrame, threshold) -> DataFrame:
    """scored with declined: 1 where the density confidence is below the threshold; a row without one never is."""
    return scored.withColumn("declined", F.coalesce((F.col("confidence") < threshold).cast("int"), F.lit(0)))


def arm_stats(rows: DataFrame, bins: int = 15) -> DataFrame:
    """arm, n, abstain_rate, selective_n, selective_accuracy, answered_ece of rows (arm, declined, conf, ok). The ECE has
    left-open bins of equal width and leaves out a confidence of 0; it is null where nothing is answered."""
    whole = rows.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.avg(F.col("declined").cast("double")).alias("abstain_rate"),
        F.sum((F.col("declined") == 0).cast("long")).alias("selective_n"),
        F.coalesce(F.avg(F.when(F.col("declined") == 0, F.col("ok").cast("double"))), F.lit(0.0)).alias("selective_accuracy"),
    )
    at = F.least(F.lit(bins - 1), (F.ceil(F.col("conf") * bins) - 1).cast("int")).alias("bin")
    each = rows.where("declined = 0 and conf > 0 and conf <= 1").groupBy("arm", at).agg(F.count("*").alias("c"), F.avg("conf").alias("m"), F.avg("ok").alias("a"))
    ece = each.groupBy("arm").agg((F.sum(F.col("c") * F.abs(F.col("m") - F.col("a"))) / F.sum("c")).alias("answered_ece"))
    return whole.join(ece, "arm", "left")
