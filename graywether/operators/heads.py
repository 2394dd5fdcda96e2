"""Linear one-vs-rest heads by gradient steps in a fixed order, mixed over shards.

A shard's rows are taken in the order of label and key; each row moves every label's weights by one logistic gradient
step. After each of the EPOCHS the shards' weights are averaged, weighted by rows, and all start the next epoch from
the average (iterative parameter mixing). One shard is the plain sequential fit; many shards are as many tasks. Rows are
dealt to shards by key and sums are taken in the order of shards, so a second fit gives the same bits.

The driver holds the weights alone (folds x labels x dimensions, at most MOST_WEIGHTS numbers, else an error).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graywether.functions.maths import sigmoid
from graywether.sources.steps import Workspace

#: Fixed values of the published fit.
EPOCHS = 12
RATE = 0.5
DECAY = 1e-4
#: Rows of a shard, numbers of all weights.
SHARD_ROWS = 100_000
MOST_WEIGHTS = 8_000_000


@dataclass(frozen=True)
class Heads:
    """weights[fold] is a matrix of labels by dimensions and a last column, the bias; fold 0 alone if not crossed."""

    labels: tuple
    weights: dict[int, np.ndarray]
    crossed: bool


def logistic(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def one_epoch(weights: np.ndarray, x: np.ndarray, gold: np.ndarray, epoch: int) -> np.ndarray:
    """The weights after one pass over a shard's rows; the rate falls evenly to 0 over all passes."""
    w, b = weights[:, :-1].copy(), weights[:, -1].copy()
    steps = EPOCHS * len(x)
    for i in range(len(x)):
        rate = RATE * (1 - (epoch * len(x) + i) / steps)
        z = w @ x[i] + b
        g = logistic(z)
        g[gold[i]] = -logistic(-z[gold[i]])
        w = w * (1 - rate * DECAY) - rate * np.outer(g, x[i])
        b -= rate * g
    return np.column_stack([w, b])


def fit(rows: DataFrame, crossed: bool = True, shard_rows: int = SHARD_ROWS) -> Heads:
    """Heads of rows (key, label, fold, shard_by, vector). Rows go to shards by pmod(shard_by, n); crossed: a fold's weights
    come from the rows of the other folds. Null labels, vectors and shard keys are left out."""
    ws = Workspace(rows.sparkSession, "heads")
    rows = rows.where("label is not null and vector is not null and shard_by is not null")
    rows = ws.save(rows.select("key", "label", (F.col("fold") if crossed else F.lit(0)).cast("int").alias("fold"), "shard_by", "vector"), "rows")
    seen = rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).collect()  # a row a label and fold
    labels = tuple(sorted({r.label for r in seen}))
    folds = sorted({r.fold for r in seen})
    dims, n = max((r.d for r in seen), default=0), sum(r.n for r in seen)
    if len(folds) * len(labels) * (dims + 1) > MOST_WEIGHTS:
        raise ValueError(f"{len(folds)} folds of {len(labels)} labels and {dims} dimensions: more than {MOST_WEIGHTS} weights")
    shards = max(1, -(-n // shard_rows))
    place = {label: i for i, label in enumerate(labels)}
    weights = {f: np.zeros((len(labels), dims + 1)) for f in folds}
    shape = (len(labels), dims + 1)
    to = F.explode(F.array([F.lit(f) for f in folds]) if folds else F.array().cast("array<int>")).alias("model")
    # every model's rows by shard, written once for all epochs
    dealt = rows.select(to, "fold", "key", "label", "vector", F.pmod("shard_by", F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.where("model <> fold") if crossed and len(folds) > 1 else dealt
    packed = dealt.groupBy("model", "shard").agg(F.array_sort(F.collect_list(F.struct("label", "key", "vector"))).alias("rows"))  # shard_rows at most, near enough
    packed = ws.save(packed, "packed")

    for epoch in range(EPOCHS):

        def step(batches: Iterator[pa.RecordBatch], weights=weights, epoch=epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for model, shard, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    found = listed.values
                    x = np.asarray(found.field("vector").flatten(), dtype=np.float64).reshape(len(found), dims)
                    gold = np.array([place[v] for v in found.field("label").to_pylist()])
                    moved = one_epoch(weights[model], x, gold, epoch) * len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([moved.tobytes()], pa.binary())],
                        names=["model", "shard", "n", "m"],
                    )

        def mixed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("shard")
            total = np.zeros(shape)
            for m in parts["m"]:
                total += np.frombuffer(m, np.float64).reshape(shape)
            return pd.DataFrame({"model": [key[0]], "shard": [parts["shard"].iloc[0]], "n": [parts["n"].sum()], "m": [total.tobytes()]})

        schema = "model int, shard int, n long, m binary"
        moved = packed.mapInArrow(step, schema)
        if shards > 64:  # two steps, so that no task gets every shard's weights
            moved = moved.withColumn("way", F.floor(F.col("shard") / 64)).groupBy("model", "way").applyInPandas(mixed, schema)
        for r in moved.groupBy("model").applyInPandas(mixed, schema).collect():  # a row a fold
            weights[r.model] = np.frombuffer(r.m, np.float64).reshape(shape) / r.n
    return Heads(labels, weights, crossed)


def logits(rows: DataFrame, heads: Heads, carry: list[str]) -> DataFrame:
    """carry, label, logit of rows (label, fold, vector) for every label, by their fold's weights. A null vector, or one of a fold
    that has no weights, has no rows."""
    dims = next(iter(heads.weights.values())).shape[1] - 1 if heads.weights else 0
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind = rows.schema["label"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                folds = np.asarray(batch.column(len(carry)))
                x = np.asarray(batch.column(len(carry) + 1).flatten(), dtype=np.float64).reshape(batch.num_rows, dims)
                z = np.zeros((batch.num_rows, len(heads.labels)))
                for f in np.unique(folds):
                    w = heads.weights[int(f)]
                    z[folds == f] = x[folds == f] @ w[:, :-1].T + w[:, -1]
                repeat = pa.array(np.repeat(np.arange(batch.num_rows), len(heads.labels)))
                yield pa.RecordBatch.from_arrays([*(c.take(repeat) for c in batch.columns[: len(carry)]), pa.array(list(heads.labels) * batch.num_rows, arrow), pa.array(z.ravel())], names=[*carry, "label", "logit"])

    fold = (F.col("fold") if heads.crossed else F.lit(0)).cast("int").alias("_fold")
    known = rows.select(*carry, fold, "vector").where(F.col("vector").isNotNull() & F.col("_fold").isin([int(f) for f in heads.weights]))
    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return known.mapInArrow(run, f"{carried}, label {kind.simpleString()}, logit double")


def blend_term(logit, scale: float):
    """0.5 + scale * (sigmoid(logit) - 0.5)."""
    return 0.5 + scale * (sigmoid(logit) - 0.5)


def scale_ladder(terms: DataFrame, ladder: list[float], margin: float = 0.05) -> DataFrame:
    """scale, accuracy, selected for answers (case_id, gold, opt, base, logit): the pick is the largest base + blend term,
    ties to the lesser option; scale 0 leaves the term out. A scale is selected if it beats scale 0 by the margin and is
    the best of those that do (of equals the least); else scale 0 is. All scales are one aggregation over the terms."""
    scaled = terms.withColumn("scale", F.explode(F.array(*map(F.lit, ladder))))
    score = F.round(F.col("base") + F.when(F.col("scale") == 0, 0.0).otherwise(0.5 + F.col("scale") * (sigmoid(F.col("logit")) - 0.5)), 9)
    best = F.min(F.struct((-score).alias("o"), "opt")).alias("b")
    picks = scaled.groupBy("scale", "case_id", "gold").agg(best)
    rungs = picks.groupBy("scale").agg(F.avg((F.col("b.opt") == F.col("gold")).cast("double")).alias("accuracy"))  # a row a scale
    base = F.broadcast(rungs.where("scale = 0").select(F.col("accuracy").alias("base")))
    clears = (F.col("scale") > 0) & (F.col("accuracy") >= F.col("base") + margin)
    marked = rungs.crossJoin(base).withColumn("clears", clears)
    top = F.broadcast(marked.agg(F.min(F.when(F.col("clears"), F.struct((-F.col("accuracy")).alias("o"), "scale"))).alias("t")))
    return marked.crossJoin(top).select("scale", "accuracy", (F.col("scale") == F.coalesce(F.col("t.scale"), F.lit(0.0))).cast("int").alias("selected"))
