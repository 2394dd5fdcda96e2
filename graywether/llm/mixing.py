"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same expected number of copies, target / source size. The whole part is
taken; the fraction is rounded by pairing documents: mass (in words) moves at random from one to the other, with
odds that keep each document's expected copies, until one of the two is integral. What is left of a pair meets
the next document. So the words a source gives stay exactly what they were, but for one document at the end.

The pairing runs as a reduction tree: leaves of about LEAF rows of one source, then FAN residuals to a node, a
Spark job for each level, until each source has one residual, which goes to the nearer integer. A source with
most of the rows has more leaves, not larger ones. Odds and order come from hashes of the rows, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace, numbered

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
LEAF = 2048
FAN = 256
#: Rows alike in key and text go to leaves in blocks of this many.
BLOCK = 1024
_NEAR = 1e-9
_TURN = 0.6180339887498949


def n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size, n_docs: one row per source) with source_no, weight and target.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes by weight, none more
    than `most` times its own size. The level is what a source gets per weight: it starts as an equal share and rises
    by the excess of those that stop at their limit, until none is above. Sources are ranked by ranges and the level
    is a sum over them, so there may be as many sources as documents.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "source_no", ws, "sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", turn.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    level, stopped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        sums = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("_cap"))).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("rest"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if sums.n == stopped or not sums.rest:
            break
        level, stopped = ((sums.all or 0) - (sums.capped or 0.0)) / sums.rest, sums.n
    return ranked.withColumn("target", F.least("_cap", F.when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("weight")))).drop("_cap")


def pivot(size: list[float], p: list[float], u: list[float]) -> tuple[list[float], int]:
    """Round the fractions p in order, at most one stays a fraction; gives the new p and its index or -1."""
    p, held = list(p), -1
    for j in range(len(p)):
        if p[j] <= _NEAR or p[j] >= 1 - _NEAR:
            p[j] = float(round(p[j]))
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        up, down = min((1 - p[held]) * a, p[j] * b), min(p[held] * a, (1 - p[j]) * b)
        move = up if u[j] * (up + down) < down else -down
        p[held] += move / a
        p[j] -= move / b
        fractions = []
        for i in (held, j):
            if p[i] <= _NEAR or p[i] >= 1 - _NEAR:
                p[i] = float(round(p[i]))
            else:
                fractions.append(i)
        held = fractions[0] if fractions else -1
    return p, held


def _round(rows: pa.Table) -> pa.Table:
    """The rows of a leaf or a node, one for each of `times` where there is such a column, with p rounded and open.

    Only numbers are looked at; the key stays an Arrow column, whatever its type and nulls.
    """
    if "times" in rows.column_names:
        times = rows["times"].to_numpy()
        at = np.repeat(np.arange(len(times)), times)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        u = (rows["u"].to_numpy()[at] + turn * _TURN) % 1  # rows alike have other odds each
        rows = rows.drop_columns(["times", "u"]).take(at).append_column("u", pa.array(u))
    u, size = rows["u"].to_numpy(), rows["size"].to_numpy()
    order = np.lexsort((size, rows["leaf"].to_numpy(), u))
    rows, u, size = rows.take(order), u[order], size[order]
    odds = (u * (1 << 20)) % 1  # the low bits: u itself has set the order
    p = rows["p"].to_numpy()
    p = np.where(size == 0, u < p, p)  # what has no words adds nothing: rounded by its own odds, outside the pairs
    p, held = pivot(size.tolist(), p.tolist(), odds.tolist())
    rows = rows.set_column(rows.column_names.index("p"), "p", pa.array(p, pa.float64()))
    return rows.append_column("open", pa.array(np.arange(len(p)) == held))


def _chance(*seed: Column | str) -> Column:
    """A number from 0 to below 1 that the seed decides."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _settle(residuals: DataFrame, ws: Workspace, leaves: int) -> DataFrame | None:
    """source_no, leaf, add (0 or 1) for each leaf's residual."""
    done, level, k = None, residuals, 0
    while leaves > 1:
        k, leaves = k + 1, -(-leaves // FAN)
        nodes = level.withColumn("node", F.floor(F.col("leaf") / F.lit(FAN**k)))
        # one row per leaf comes in, FAN at most to a node
        schema = "source_no long, leaf long, size long, p double, u double, node long, open boolean"
        nodes = nodes.withColumn("u", _chance("source_no", "leaf", F.lit(k))).select("source_no", "leaf", "size", "p", "u", "node")
        out = ws.save(nodes.groupBy("source_no", "node").applyInArrow(_round, schema), f"level{k}")
        closed = out.where(~F.col("open")).select("source_no", "leaf", F.col("p").cast("int").alias("add"))
        done = closed if done is None else done.unionByName(closed)
        level = out.where("open").drop("node", "open")
    last = level.select("source_no", "leaf", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("add"))
    return last if done is None else done.unionByName(last)


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Copies of every row of docs (key, text, source; further columns are ignored).

    Returns doc_id, text_hash, size (words), source, source_size, target, copies (0 to MAX_COPIES) and taken
    (size * copies). Documents without words add nothing to the mix and take copies at their source's rate.
    Null keys, texts and sources are values like others; repeated rows are rounded one by one, with other odds each.
    The table of sources has one row per source; documents never pass through one task or the driver.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.save(
        docs.select(F.col(key).alias("doc_id"), F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size"), "source"),
        "sized",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = ws.save(targets(sizes, ws, weights), "targets")
    most = plan.agg(F.max("n_docs")).first()[0] or 0
    each = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    plan = plan.select(
        F.col("source").alias("_source"), "source_no", "source_size", "target", each.alias("_each"), F.ceil(F.col("n_docs") / LEAF).alias("_leaves")
    )
    # rows alike are counted first and dealt in blocks, so that a row repeated without end fills no single leaf
    alike = rows.groupBy("doc_id", "text_hash", "size", "source").agg(F.count("*").alias("n"))
    alike = alike.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))))
    alike = alike.withColumn("times", F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK))
    due = alike.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("_each") + _NEAR)
    due = due.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.col("_each") - whole, F.lit(0.0)))
    due = due.withColumn("u", _chance("doc_id", "text_hash", "block", F.lit("mix")))
    due = due.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "text_hash", "block", F.lit("leaf")), F.col("_leaves")).cast("long"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text_hash long, size long, source string, source_no long, source_size long, target double, "
        "whole int, p double, leaf long, u double, open boolean"
    )
    due = due.select("doc_id", "text_hash", "size", "source", "source_no", "source_size", "target", "whole", "p", "leaf", "times", "u")
    leaves = ws.save(due.groupBy("source_no", "leaf").applyInArrow(_round, schema), "leaves")
    add = _settle(leaves.where("open").select("source_no", "leaf", "size", "p", "u"), ws, -(-most // LEAF))
    settled = leaves.where(~F.col("open")).withColumn("add", F.col("p").cast("int"))
    opened = leaves.where("open").join(add, ["source_no", "leaf"])
    out = settled.unionByName(opened.select(settled.columns)).withColumn("copies", F.col("whole") + F.col("add"))
    return out.select(
        "doc_id", "text_hash", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def take(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs as often as mix(docs) takes them.

    Rows with the same key and text are told apart by number only; those with most copies come first.
    """
    by = [F.col(key).alias("_key"), F.xxhash64("text").alias("_hash")]
    counts = mixed.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("_key"), F.col("text_hash").alias("_hash")).agg(
        *[F.sum((F.col("copies") >= n).cast("long")).alias(f"_n{n}") for n in range(1, MAX_COPIES + 1)]
    )
    by[0] = F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("_key")
    numbered = docs.select("*", *by).withColumn("_no", F.expr("row_number() over (partition by _key, _hash order by _hash)"))
    joined = numbered.join(counts, ["_key", "_hash"])
    copies = sum((F.col("_no") <= F.col(f"_n{n}")).cast("int") for n in range(1, MAX_COPIES + 1))
    repeated = joined.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    return repeated.select(*docs.columns)
