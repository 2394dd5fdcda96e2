"""A closed-form one-vs-rest ridge over hashed counts: presence features scaled by each class's log-count ratio.

The features are the buckets that most rows have. Tasks count how many rows hold each pair of features, in blocks of a
matrix that all classes share; the blocks are summed over tasks, and each class's system
(R G R + lambda I) w = R X'y is solved in a task of its own block of classes. With folds, a fold's matrix is the sum of
the other folds' blocks, so every row is scored by weights of rows it isn't among, for one pass over the rows.

The driver gets the chosen buckets (at most MOST_FEATURES) and the weights (features times classes, a block of classes
at a time); no matrix of features by features passes through it.
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
from graywether.functions.text import BUCKETS
from graywether.operators.features import summed
from graywether.sources.steps import Workspace

#: Fixed values of the published readout.
FEATURES = 2048
LAMBDA = 10.0
#: Features at most (a matrix of 134 MB in a task), rows and columns of a block, classes that one task solves, weights
#: (of 8 bytes) that are sent to the scoring tasks at once.
MOST_FEATURES = 4096
BLOCK = 256
CLASSES = 32
MOST_WEIGHTS = 4_000_000
#: Rows of a product, rows whose counts floats of 32 bits hold exactly, folds' classes whose sums a task holds.
ROWS = 4096
EXACT = 1 << 24
CLASS_SUMS = 1000


@dataclass(frozen=True)
class Model:
    """weights: fold, label, tok (-1: the bias), ratio, weight. Written; the features are those of all folds."""

    features: tuple[int, ...]
    weights: DataFrame
    crossed: bool


def top_buckets(rows: DataFrame, k: int) -> list[int]:
    """The k buckets that most rows have, ties to the lesser, ascending. A task sends a count for each bucket it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            seen += np.bincount(np.asarray(batch.column(0).flatten()), minlength=BUCKETS)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["tok", "df"])

    seen = rows.select("toks").mapInArrow(run, "tok int, df long").groupBy("tok").agg(F.sum("df").alias("df"))
    return sorted(r.tok for r in seen.orderBy(F.desc("df"), "tok").limit(k).collect())


def class_counts(rows: DataFrame, features: list[int]) -> DataFrame:
    """fold, label, tok, n_in, df: how often the features occur in the rows (fold, label, toks, times) of a class and in how many
    of them, without zeros. A task sends a row for each fold, class and feature, and holds CLASS_SUMS folds' classes at most."""
    chosen = np.array(features, dtype=np.int64)
    k = len(features)
    kinds = [rows.schema[c].dataType for c in ("fold", "label")]
    arrow = [to_arrow_type(t) for t in kinds]

    def packed(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for of, total in sums.items():
            live = np.flatnonzero(total[1])
            keys = [pa.array([x] * len(live), t) for x, t in zip(of, arrow)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(chosen[live].astype(np.int32)), *(pa.array(x[live]) for x in total)], names=["fold", "label", "tok", "n_in", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                groups: dict[tuple, int] = {}
                mine = np.array([groups.setdefault(of, len(groups)) for of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
                toks, times = (np.asarray(batch.column(i).flatten()) for i in (2, 3))
                owner = np.repeat(mine, np.diff(np.asarray(batch.column(2).offsets)))
                place = np.minimum(np.searchsorted(chosen, toks), max(k - 1, 0))
                hit = np.flatnonzero(chosen[place] == toks) if k else np.array([], dtype=np.int64)
                key = owner[hit] * k + place[hit]
                cells, back = np.unique(key, return_inverse=True)
                n_in, df = np.bincount(back, weights=times[hit], minlength=len(cells)), np.bincount(back, minlength=len(cells))
                edges = np.searchsorted(cells, np.arange(len(groups) + 1) * k)
                for of, g in groups.items():
                    own = slice(edges[g], edges[g + 1])
                    total = sums.setdefault(of, np.zeros((2, k), np.int64))
                    total[0, cells[own] - g * k] += n_in[own].astype(np.int64)
                    total[1, cells[own] - g * k] += df[own]
                    if len(sums) > CLASS_SUMS:
                        yield from packed(sums)
                        sums = {}
        yield from packed(sums)

    shape = f"fold {kinds[0].simpleString()}, label {kinds[1].simpleString()}, tok int, n_in long, df long"
    parts = rows.select("fold", "label", "toks", "times").mapInArrow(run, shape)
    return parts.groupBy("fold", "label", "tok").agg(F.sum("n_in").alias("n_in"), F.sum("df").alias("df"))


def _presence(batch_toks: pa.ListArray, features: np.ndarray) -> np.ndarray:
    """Rows by features (and a last column of ones), 1 where a row has the feature."""
    sizes = np.diff(np.asarray(batch_toks.offsets))
    toks = np.asarray(batch_toks.flatten())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.searchsorted(features, toks)
    place[place == len(features)] = 0
    hit = features[place] == toks if len(features) else np.zeros(len(toks), bool)
    x = np.zeros((len(sizes), len(features) + 1), dtype=np.float32)
    x[owner[hit], place[hit]] = 1
    x[:, -1] = 1
    return x


def pair_counts(rows: DataFrame, features: list[int]) -> DataFrame:
    """fold, bi, bj, m: blocks (bi >= bj) of the number of rows (fold, toks) that hold two features; the last feature is in
    every row. m is a packed int64 matrix."""
    chosen = np.array(features, dtype=np.int64)
    size = len(features) + 1
    edges = [*range(0, size, BLOCK), size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums of less than 2**24 ones are exact in floats of 32 bits: whole numbers are added up once that many rows were seen
        grams: dict[int, np.ndarray] = {}
        fresh: dict[int, tuple[np.ndarray, int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                folds = np.asarray(batch.column(0))
                x = _presence(batch.column(1), chosen)
                for fold in map(int, np.unique(folds)):
                    own = x[folds == fold]
                    gram, seen = fresh.get(fold, (None, 0))
                    if gram is not None and seen + len(own) >= EXACT:
                        grams[fold] = grams.get(fold, 0) + gram.astype(np.int64)
                        gram, seen = None, 0
                    part = own.T @ own
                    if gram is not None:
                        part += gram
                    fresh[fold] = part, seen + len(own)
        for fold in sorted(fresh):
            gram = grams.pop(fold, 0) + fresh.pop(fold)[0].astype(np.int64)
            for i in range(len(edges) - 1):
                blocks = [gram[edges[i] : edges[i + 1], edges[j] : edges[j + 1]].tobytes() for j in range(i + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold] * (i + 1), pa.int32()), pa.array([i] * (i + 1), pa.int32()), pa.array(range(i + 1), pa.int32()), pa.array(blocks, pa.binary())],
                    names=["fold", "bi", "bj", "m"],
                )

    parts = rows.select("fold", "toks").mapInArrow(run, "fold int, bi int, bj int, m binary")
    return summed(parts, ["fold", "bi", "bj"], "int64")


def ratios(n_in: np.ndarray, n_out: np.ndarray, n_rows: float) -> np.ndarray:
    """Log-count ratio of a class: add-one counts over the vocabulary's size, outside over that and the number of rows."""
    return np.log((n_in + 1) / BUCKETS) - np.log((n_out + 1) / (n_rows + BUCKETS))


def solved(gram: np.ndarray, ratio: np.ndarray, df: np.ndarray, n_class: float, lam: float) -> np.ndarray:
    """Weights of the features, then the bias, in the scaled space."""
    r = np.append(ratio, 1.0)
    system = gram * r[:, None] * r[None, :] + lam * np.eye(len(r))
    return np.linalg.solve(system, r * np.append(df, n_class))


def _training(own: DataFrame, keys: list[str], values: list[str], folds: DataFrame, crossed: bool) -> DataFrame:
    """fold, keys, values: sums over the folds a model is fitted on, all but its own if crossed."""
    total = own.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
    every = total.crossJoin(F.broadcast(folds))  # a row a fold
    if not crossed:
        return every
    joined = every.join(own.select("fold", *keys, *(F.col(v).alias(f"own_{v}") for v in values)), ["fold", *keys], "left")
    return joined.select("fold", *keys, *((F.col(v) - F.coalesce(f"own_{v}", F.lit(0))).alias(v) for v in values))


def fit(rows: DataFrame, features: int = FEATURES, lam: float = LAMBDA, crossed: bool = True) -> Model:
    """The readout of rows (label, fold, toks, times). crossed: a fold's weights come from the other folds; else from all
    rows, and there is one fold, 0. A label that a fold's rows lack is scored by its bias and the others' counts."""
    if features > MOST_FEATURES:
        raise ValueError(f"{features} features: {MOST_FEATURES} at most")
    ws = Workspace(rows.sparkSession, "ridge")
    rows = rows.select("label", (F.col("fold") if crossed else F.lit(0)).cast("int").alias("fold"), "toks", "times")
    chosen = top_buckets(rows, features)
    k = len(chosen)
    folds = ws.save(rows.select("fold").distinct(), "folds")

    own = ws.save(class_counts(rows, chosen), "own")
    sizes = ws.save(rows.groupBy("fold", "label").agg(F.count("*").alias("n_class")), "sizes")
    # classes that a task solves together
    labels = sizes.select("label").distinct()
    blocks = max(1, -(-labels.count() // CLASSES))
    dealt = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("cb")

    classes = _training(sizes, ["label"], ["n_class"], folds, crossed)
    counts = _training(own, ["label", "tok"], ["n_in", "df"], folds, crossed)
    whole = _training(own.groupBy("fold", "tok").agg(F.sum("n_in").alias("n_all")), ["tok"], ["n_all"], folds, crossed)
    n_rows = classes.groupBy("fold").agg(F.sum("n_class").alias("n_rows"))
    listed = counts.join(whole, ["fold", "tok"]).groupBy("fold", "label").agg(F.collect_list(F.struct("tok", "n_in", "df")).alias("cells"))  # k entries
    alls = whole.groupBy("fold").agg(F.collect_list(F.struct("tok", "n_all")).alias("alls"))  # k entries
    stats = classes.join(n_rows, "fold").join(alls, "fold", "left").join(listed, ["fold", "label"], "left").select("*", dealt)

    grams = pair_counts(rows, chosen)
    fold_list = F.array_sort(F.collect_list("fold")).alias("folds")
    others = folds.agg(fold_list)
    to = F.explode(F.array_remove("folds", F.col("own")) if crossed else F.col("folds")).alias("fold")
    grams = grams.withColumnRenamed("fold", "own").crossJoin(F.broadcast(others)).select(to, "bi", "bj", "m")
    grams = ws.save(summed(grams, ["fold", "bi", "bj"], "int64"), "grams")
    sent = grams.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    chosen_array = np.array(chosen, dtype=np.int64)
    kind = rows.schema["label"].dataType.simpleString()

    def solve(key: tuple, gram_rows: pd.DataFrame, class_rows: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((k + 1, k + 1))
        for bi, bj, m in zip(gram_rows["bi"], gram_rows["bj"], gram_rows["m"]):
            i, j = bi * BLOCK, bj * BLOCK
            block = np.frombuffer(m, np.int64).reshape(min(BLOCK, k + 1 - i), min(BLOCK, k + 1 - j))
            gram[i : i + block.shape[0], j : j + block.shape[1]] = block
            gram[j : j + block.shape[1], i : i + block.shape[0]] = block.T
        out = []
        for label, n_class, n, alls, cells in zip(*(class_rows[c] for c in ("label", "n_class", "n_rows", "alls", "cells"))):
            n_all, n_in, df = np.zeros(k), np.zeros(k), np.zeros(k)
            for x in alls if alls is not None else []:
                n_all[np.searchsorted(chosen_array, x["tok"])] = x["n_all"]
            for x in cells if cells is not None else []:
                at = np.searchsorted(chosen_array, x["tok"])
                n_in[at], df[at] = x["n_in"], x["df"]
            ratio = ratios(n_in, n_all - n_in, float(n))
            w = solved(gram, ratio, df, float(n_class), lam)
            out.append(pd.DataFrame({"fold": key[0], "label": label, "tok": [*chosen, -1], "ratio": [*ratio, 1.0], "weight": w}))
        return pd.concat(out) if out else pd.DataFrame({"fold": [], "label": [], "tok": [], "ratio": [], "weight": []})

    weights = sent.groupBy("fold", "cb").cogroup(stats.groupBy("fold", "cb")).applyInPandas(solve, f"fold int, label {kind}, tok int, ratio double, weight double")
    return Model(tuple(chosen), ws.save(weights, "weights"), crossed)


def scores(rows: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """carry, label, score of rows (fold, toks, runs) for every label of their fold's weights. The weights go to the tasks in
    blocks of at most MOST_WEIGHTS numbers; beyond one block the rows are read once a block."""
    features = np.array(model.features, dtype=np.int64)
    k = len(features)
    pairs = model.weights.select("fold", "label").distinct().orderBy("label", "fold").collect()  # a row a class and fold
    each = max(1, MOST_WEIGHTS // (k + 1))
    labels = sorted({p.label for p in pairs}, key=lambda x: (x is None, x))
    folds = max(1, len({p.fold for p in pairs}))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    label_kind = model.weights.schema["label"].dataType
    arrow = to_arrow_type(label_kind)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", label {label_kind.simpleString()}, score double"
    fold = F.col("fold") if model.crossed else F.lit(0)
    read = rows.select(*carry, fold.cast("int").alias("_fold"), "toks", "runs")
    found = None
    for at in range(0, max(len(labels), 1), max(1, each // folds)):
        block = labels[at : at + max(1, each // folds)]
        named = model.weights.where(F.col("label").isin([x for x in block if x is not None]) | (F.col("label").isNull() if None in block else F.lit(False)))
        tables: dict[int, np.ndarray] = {}
        for r in named.select("fold", "label", "tok", (F.col("ratio") * F.col("weight")).alias("v")).toPandas().itertuples(index=False):
            table = tables.setdefault(int(r.fold), np.zeros((len(block), k + 1)))
            at_label = block.index(None if r.label is None or r.label != r.label else r.label)
            table[at_label, k if r.tok < 0 else int(np.searchsorted(features, r.tok))] = r.v

        def run(batches: Iterator[pa.RecordBatch], tables=tables, block=block) -> Iterator[pa.RecordBatch]:
            n = len(carry)
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    x = _presence(batch.column(n + 1), features).astype(np.float64)
                    toks, runs = (np.asarray(batch.column(n + i).flatten()) for i in (1, 2))
                    sizes = np.diff(np.asarray(batch.column(n + 1).offsets))
                    place = np.searchsorted(features, toks)
                    place[place == k] = 0
                    hit = features[place] == toks if k else np.zeros(len(toks), bool)
                    x[np.repeat(np.arange(len(sizes)), sizes)[hit], place[hit]] = runs[hit]
                    folds = np.asarray(batch.column(n))
                    score = np.zeros((len(sizes), len(block)))
                    for f in np.unique(folds):
                        if int(f) in tables:
                            score[folds == f] = x[folds == f] @ tables[int(f)].T
                    repeat = pa.array(np.repeat(np.arange(len(sizes)), len(block)))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(repeat) for c in batch.columns[:n]), pa.array(list(block) * len(sizes), arrow), pa.array(score.ravel())], names=[*carry, "label", "score"]
                    )

        part = read.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def temperature(scored: DataFrame, row: str) -> DataFrame:
    """temp: the mean over rows of their largest less their least score, at least 1e-6."""
    spread = scored.groupBy(row).agg((F.max("score") - F.min("score")).alias("s"))
    return spread.agg(F.greatest(F.avg("s"), F.lit(1e-6)).alias("temp"))


def blend_terms(scored: DataFrame, row: str, temp: DataFrame, scale: float = 1.0) -> DataFrame:
    """row, label, term: scale * sigmoid((score - the best other) / temp); a single label has its score as the margin."""
    top = scored.groupBy(row).agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))  # one a label
    joined = scored.join(top, row).crossJoin(F.broadcast(temp))  # one row
    other = F.when(F.col("score") == F.get("s", F.lit(0)), F.get("s", F.lit(1))).otherwise(F.get("s", F.lit(0)))
    margin = F.col("score") - F.coalesce(other, F.lit(0.0))
    return joined.select(row, "label", (scale * sigmoid(margin / F.col("temp"))).alias("term"))
