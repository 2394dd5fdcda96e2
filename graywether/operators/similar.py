"""The most similar rows of other rows, exactly: blocks of vectors meet in tiles, and a tile keeps k a row.

Rows are dealt to blocks by key, as many as a group's size asks for. A tile is a matrix product of two blocks, worked out a strip
at a time, so no pair of rows is ever a row of Spark. The comparisons are quadratic in a group's rows; what is shuffled is a
block once for each block that it meets, and k rows a row and tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywether.sources.steps import Workspace

#: Rows of a block at most; a smaller group has LEAST_BLOCKS of SMALL rows or more, so that it keeps several tasks busy.
BLOCK_ROWS = 16384
LEAST_BLOCKS = 16
SMALL = 256
#: Rows of a block that are compared at a time.
STRIP = 256
DIGITS = 6


def _packed(rows: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """grp, block, rows: rows (grp, id, payload) by block; and grp, blocks."""
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / BLOCK_ROWS), F.least(F.lit(LEAST_BLOCKS), F.ceil(n / SMALL))).cast("int")
    shape = rows.groupBy("grp").agg(blocks.alias("blocks"))
    dealt = rows.join(shape, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("grp", "block").agg(F.collect_list(F.struct("id", *payload)).alias("rows")), shape  # BLOCK_ROWS, near enough


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of equal length; shorter ones are filled with zeros."""
    offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values, dtype=np.float64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def strip_best(a: np.ndarray, b: np.ndarray, same: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b and product of the k largest of each row of a by rounded product, of equal ones the first in b. same: the
    places in b that a row of a is not compared with."""
    products = a @ b.T
    key = np.rint(products * 10**DIGITS).astype(np.int64) * products.shape[1] - np.arange(products.shape[1])
    least = np.iinfo(np.int64).min
    for i, places in enumerate(same):
        key[i, places] = least
    most = min(k, key.shape[1])
    best = np.argpartition(-(key + 1), most - 1, axis=1)[:, :most] if most < key.shape[1] else np.tile(np.arange(most), (len(key), 1))
    row = np.repeat(np.arange(len(key)), most)
    best = best.ravel()
    kept = key[row, best] != least
    row, best = row[kept], best[kept]
    return row, best, products[row, best]


def most_similar(left: DataFrame, right: DataFrame, k: int, tag: str | None = None) -> DataFrame:
    """case_id, row_id, sim and tag of the rows of right (grp, id, u, tag) with the largest products u . u to each row of left (grp,
    id, u), those of its own id left out: k or more a row, the first k by product (six decimals, not rounded here) and then
    by row_id among them. Rows with a null are left out."""
    ws = Workspace(left.sparkSession, "similar")
    here = lambda rows: rows.where("grp is not null and id is not null and u is not null")
    tags = [tag] if tag else []
    cases = ws.save(here(left).select("grp", "id", "u"), "cases")  # counted and dealt: what they are made of is worked out once
    rows = ws.save(here(right).select("grp", "id", "u", *tags), "rows")
    (a, a_shape), (b, b_shape) = _packed(cases, ["u"]), _packed(rows, ["u", *tags])
    a, b = ws.save(a, "left"), ws.save(b, "right")
    meets = lambda rows, shape, own, other: rows.join(shape, "grp").select("grp", F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other), F.col("rows").alias("rows_" + own))
    tiles = meets(a, b_shape, "i", "j").join(meets(b, a_shape, "j", "i"), ["grp", "i", "j"]).select("rows_i", "rows_j")
    kinds = {f.name: f.dataType.simpleString() for f in right.schema} | {"case_id": left.schema["id"].dataType.simpleString()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one, other = (batch.column(c)[n].values for c in (0, 1))
                ids = other.field("id")
                order = np.argsort(np.asarray(ids), kind="stable")
                other = other.take(pa.array(order))
                mine, theirs = np.asarray(one.field("id")), np.asarray(other.field("id"))
                x, y = _matrix(one.field("u")), _matrix(other.field("u"))
                width = max(x.shape[1], y.shape[1])
                x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
                first, last = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
                for at in range(0, len(x), STRIP):
                    same = [np.arange(f, t) for f, t in zip(first[at : at + STRIP], last[at : at + STRIP])]
                    row, best, products = strip_best(x[at : at + STRIP], y, same, k)
                    found = other.take(pa.array(best))
                    columns = [one.field("id").take(pa.array(row + at)), found.field("id"), pa.array(products), *(found.field(t) for t in tags)]
                    yield pa.RecordBatch.from_arrays(columns, names=["case_id", "row_id", "sim", *tags])

    extra = "".join(f", `{t}` {kinds[t]}" for t in tags)
    return tiles.mapInArrow(run, f"case_id {kinds['case_id']}, row_id {kinds['id']}, sim double{extra}")
