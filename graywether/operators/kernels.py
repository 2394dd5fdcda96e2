"""Kernel densities of a label's vectors: log-sum-exp of cosines over a temperature, in tiles of blocks.

A label's rows are dealt to blocks by key, as many as its size asks for; a tile compares two blocks by a matrix product
and gives each of their rows one number pair, so no pair of rows is ever made and a common label has many tiles on many
tasks. The work is quadratic in a label's rows, as the density itself is: it suits labelled pools.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.functions.maths import unit
from graywether.operators.probes import pair_kernel
from graywether.sources.steps import Workspace

#: Rows of a block, near enough. Smaller blocks can be asked for; a label of FEW_BLOCKS of them or more has BLOCK_ROWS a block as
#: it grows, as each block is sent to all others.
BLOCK_ROWS = 2048
FEW_BLOCKS = 16
LEAST_TAU = 1e-6
RUNGS = (0.5, 0.75, 0.9)


def block_count(n: Column, block_rows: int) -> Column:
    return F.least(F.ceil(n / block_rows), F.greatest(F.ceil(n / BLOCK_ROWS), F.lit(FEW_BLOCKS))).cast("int")


def temperatures(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, tau: mean cosine deficit of the label's pairs, from the sum of its unit vectors; labels of two rows or more."""
    return pair_kernel(vectors, label, vector).where("n >= 2").select("label", "n", F.greatest(1 - F.col("mean_cos"), F.lit(LEAST_TAU)).alias("tau"))


def _blocks(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """label, block, blocks, tau, rows: rows (label, key, src, u) packed by block; shape has a label's tau and blocks."""
    dealt = rows.join(shape, "label").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    return dealt.groupBy("label", "block", "blocks", "tau").agg(F.collect_list(F.struct("key", "u")).alias("rows"))


def _tiles(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """label, i, j, tau, a, b: packed blocks that meet, on a key of their own each. ordered: i <= j only."""
    partner = lambda c, low: F.explode(F.sequence(low, F.col(c) - 1))
    a = left.select("label", F.col("block").alias("i"), partner("others", F.col("block") if ordered else F.lit(0)).alias("j"), "tau", F.col("rows").alias("a"))
    if ordered:
        b = right.select("label", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("rows").alias("b"))
    else:
        b = right.select("label", partner("others", F.lit(0)).alias("i"), F.col("block").alias("j"), F.col("rows").alias("b"))
    return a.join(b, ["label", "i", "j"])


def _matrix(listed: pa.StructScalar) -> tuple[pa.Array, np.ndarray]:
    found = listed.values
    return found.field("key"), np.asarray(found.field("u").flatten()).reshape(len(found), -1)


def _partials(tiles: DataFrame, kind: str, label_kind: str, itself: bool) -> DataFrame:
    """label, key, top, sum, near (cosine, key) of the rows of a (and of b, if the blocks are of one table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                label, i, j, tau = (batch.column(c)[n] for c in range(4))
                (ka, a), (kb, b) = _matrix(batch.column(4)[n]), _matrix(batch.column(5)[n])
                cos = a @ b.T
                sides = [(ka, kb, cos)]
                if itself and i.as_py() == j.as_py():
                    np.fill_diagonal(cos, -np.inf)
                elif itself:
                    sides.append((kb, ka, cos.T))
                for keys, others, c in sides:
                    scaled = c / tau.as_py()
                    top = scaled.max(axis=1)
                    known = np.isfinite(top)
                    total = np.exp(scaled - np.where(known, top, 0)[:, None]).sum(axis=1)
                    # of the nearest, the least key
                    order = np.argsort(np.asarray(others), kind="stable")
                    near = order[c[:, order].argmax(axis=1)]
                    keep = pa.array(np.flatnonzero(known))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([label.as_py()] * len(keep), batch.schema.field(0).type),
                            keys.take(keep),
                            pa.array(top[known]),
                            pa.array(total[known]),
                            pa.array(c[np.arange(len(near)), near][known]),
                            others.take(pa.array(near[known])),
                        ],
                        names=["label", "key", "top", "total", "cos", "near"],
                    )

    schema = f"label {label_kind}, key {kind}, top double, total double, cos double, near {kind}"
    return tiles.select("label", "i", "j", "tau", "a", "b").mapInArrow(run, schema)


def _joined(parts: DataFrame) -> DataFrame:
    """label, key, lse, near: a row's partial sums, one a tile, put together; near is its nearest row, ties to the least key."""
    tops = F.array_max(F.transform("parts", lambda p: p["top"]))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"] * F.exp(p["top"] - F.col("most")))
    one = parts.groupBy("label", "key").agg(
        F.collect_list(F.struct("top", "total")).alias("parts"),  # one entry a block
        F.min(F.struct((-F.col("cos")).alias("o"), "near")).alias("n"),
    )
    return one.withColumn("most", tops).select("label", "key", (F.col("most") + F.log(total)).alias("lse"), F.col("n.near").alias("near"))


def densities(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """label, key, loo, near: each row's log-density under its label's other rows, and its nearest of them; also the packed
    blocks and label, n, tau, blocks. Null labels and vectors and labels of one row have no density. Keys are unique."""
    ws = Workspace(vectors.sparkSession, "kernels")
    known = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull())
    rows = known.select(F.col(key).alias("key"), F.col(label).alias("label"), unit(F.col(vector)).alias("u"))
    shape = temperatures(known, label, vector).withColumn("blocks", block_count(F.col("n"), block_rows))
    shape = ws.save(shape, "shape")
    packed = ws.save(_blocks(rows, shape), "blocks")
    tiles = _tiles(packed.withColumn("others", F.col("blocks")), packed, ordered=True)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
    found = _joined(_partials(tiles, *kinds, itself=True)).join(shape.select("label", "n"), "label")
    found = found.select("label", "key", (F.col("lse") - F.log(F.col("n") - 1.0)).alias("loo"), "near")
    return ws.save(found, "loo"), packed, shape


def candidate_deltas(cands: DataFrame, loo: DataFrame, packed: DataFrame, shape: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """label, key, delta of candidates (key, label, src, vector): their log-density under all rows of the label less the
    leave-one-out density of the row src that they come from."""
    rows = cands.select("key", "label", unit(F.col("vector")).alias("u"))
    sizes = rows.groupBy("label").agg(block_count(F.count("*"), block_rows).alias("blocks"))
    mine = _blocks(rows, sizes.join(shape.select("label", "tau", F.col("blocks").alias("others"), "n"), "label").select("label", "blocks", "tau"))
    mine = mine.join(shape.select("label", F.col("blocks").alias("others")), "label")
    pool = packed.drop("blocks", "tau").join(sizes.withColumnRenamed("blocks", "others"), "label")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
    found = _joined(_partials(_tiles(mine, pool, ordered=False), *kinds, itself=False)).drop("near")
    found = found.join(shape.select("label", "n"), "label").join(cands.select("key", "src"), "key")
    source = loo.select(F.col("key").alias("src"), "label", "loo")
    return found.join(source, ["label", "src"]).select("label", "key", (F.col("lse") - F.log(F.col("n").cast("double")) - F.col("loo")).alias("delta"))


def controls(loo: DataFrame) -> DataFrame:
    """label, eps_50, eps_75, eps_90: quantiles of the difference in density between a row and its nearest."""
    other = loo.select("label", F.col("key").alias("near"), F.col("loo").alias("near_loo"))
    gaps = loo.join(other, ["label", "near"]).select("label", F.abs(F.col("loo") - F.col("near_loo")).alias("gap"))
    return gaps.groupBy("label").agg(*(F.percentile("gap", F.lit(q)).alias(f"eps_{round(100 * q)}") for q in RUNGS))


def accepted(delta: Column, eps: Column) -> Column:
    return F.abs(delta) <= eps


def ladder(deltas: DataFrame, eps: DataFrame) -> DataFrame:
    """label, candidates, accept_50, accept_75, accept_90, ascent, delta_median, deviation: shares of a label's candidates
    within each rung, share that is denser than its source, median deviation over the middle rung."""
    joined = deltas.join(eps, "label")
    shares = [F.avg(accepted(F.col("delta"), F.col(f"eps_{r}")).cast("double")).alias(f"accept_{r}") for r in (50, 75, 90)]
    out = joined.groupBy("label").agg(
        F.count("*").alias("candidates"), *shares, F.avg((F.col("delta") > 0).cast("double")).alias("ascent"), F.percentile("delta", F.lit(0.5)).alias("delta_median"), F.max("eps_50").alias("eps_50")
    )
    return out.withColumn("deviation", F.when(F.col("eps_50") > 0, F.abs("delta_median") / F.col("eps_50")))
