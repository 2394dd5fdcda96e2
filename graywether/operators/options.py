"""Option-conditioned count tables: a question's options are told apart by the texts that were answered with each.

A table belongs to a question and an option; its rest are the same question's other options. Small tables are sent to the
tasks. Larger ones go to their question's texts: a question's texts are dealt to parts, more for more events, and each part
gets the question's tables, which have fewer cells than the part's texts have events; so no event is shuffled on its own
and a question that most rows ask isn't one key. The cells of a question with very large tables meet texts by bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from graywether.functions import maths
from graywether.functions.text import BUCKETS
from graywether.operators.events import other_folds, pieces
from graywether.sources.steps import Workspace

#: Rows of counts whose tables are sent to the tasks whole (about 100 MB); more are joined.
MOST_CELLS = 4_000_000
#: Rows of counts of one question whose tables a task holds; the texts of questions with more are joined by bucket.
MOST_OF_ONE = 8_000_000
#: A part of a question's texts has so many events at least, and four times as many as the question's tables have cells.
PART_EVENTS = 1_000_000
#: Counts that a task holds before it sends them on.
HELD_CELLS = 4_000_000
_OF = ["fold", "qid", "option"]


def fold_counts(rows: DataFrame) -> DataFrame:
    """fold, qid, option, tok, n_in of rows (qid, option, fold, toks, times); rows without question or answer count for none.

    A task sums its rows' events and sends an array for each fold, question and option instead of a row for each count."""
    kinds = {f.name: f.dataType for f in rows.schema}
    arrow = [to_arrow_type(kinds[c]) for c in _OF]

    def packed(places: dict[tuple, int], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(keys, np.arange(len(places) + 1) * BUCKETS).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((keys % BUCKETS).astype(np.int32), n)]
        return pa.RecordBatch.from_arrays([*(pa.array([p[i] for p in places], t) for i, t in enumerate(arrow)), *lists], names=[*_OF, "toks", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple, int] = {}
        keys, ns, held = [], [], 0
        for batch in pieces(batches, 3, HELD_CELLS // 8):
            mine = np.array([places.setdefault(k, len(places)) for k in zip(*(batch.column(i).to_pylist() for i in range(3)))], dtype=np.int64)
            sizes = np.diff(np.asarray(batch.column(3).offsets))
            keys.append(np.repeat(mine, sizes) * BUCKETS + np.asarray(batch.column(3).flatten()))
            ns.append(np.asarray(batch.column(4).flatten()).astype(np.int64))
            held += len(keys[-1])
            if held > HELD_CELLS:
                keys, ns = ([x] for x in _summed(keys, ns))
                held = len(keys[0])
                if held > HELD_CELLS // 2:  # further rows would be summed too often
                    yield packed(places, keys[0], ns[0])
                    places, keys, ns, held = {}, [], [], 0
        if held:
            yield packed(places, *_summed(keys, ns))

    of = ", ".join(f"{c} {kinds[c].simpleString()}" for c in _OF)
    whole = rows.where("qid is not null and option is not null").select(*_OF, "toks", "times")
    parts = whole.mapInArrow(run, f"{of}, toks array<int>, ns array<bigint>").repartition(*_OF)
    cells = parts.select(*_OF, F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("ns").alias("n"))))
    return cells.groupBy(*_OF, "tok").agg(F.sum("n").alias("n_in"))  # dealt by the arrays' keys already


def _summed(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(ns), minlength=len(found)).astype(np.int64)  # exact below 2**53


def tables(counts: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """For each fold, by the counts of the others: fold, qid, tok, odds (log2 odds of each option) of each bucket, and fold, qid, fitted
    (the options, in the order of odds) of each question. A bucket gets alpha counts beforehand: the share of buckets that any
    question's rows have."""
    key = F.struct("qid", "option").alias("key")
    others = other_folds(counts.select("fold", key, "tok", "n_in"), "key", "fold", folds)
    alpha = others.select("fold", "tok").distinct().groupBy("fold").agg((F.count("*") / BUCKETS).alias("alpha"))
    flat = others.select("fold", "key.qid", "key.option", "tok", "n_in")
    cells = flat.groupBy("fold", "qid", "tok").agg(F.map_from_entries(F.collect_list(F.struct("option", "n_in"))).alias("n"), F.sum("n_in").alias("n_all"))  # one an option
    sizes = flat.groupBy("fold", "qid", "option").agg(F.sum("n_in").alias("size_in"))
    sizes = sizes.groupBy("fold", "qid").agg(F.sum("size_in").alias("size_all"), F.sort_array(F.collect_list(F.struct("option", "size_in"))).alias("sizes"))
    sizes = sizes.join(alpha, "fold")

    def odds(s: Column) -> Column:
        n_in, mass = F.coalesce(F.element_at("n", s["option"]), F.lit(0)), F.col("alpha") * BUCKETS
        inside = (n_in + F.col("alpha")) / (s["size_in"] + mass)
        outside = (F.col("n_all") - n_in + F.col("alpha")) / (F.col("size_all") - s["size_in"] + mass)
        return F.log2(inside) - F.log2(outside)

    fitted = sizes.select("fold", "qid", F.transform("sizes", lambda s: s["option"]).alias("fitted"))
    return cells.join(sizes, ["fold", "qid"]).select("fold", "qid", "tok", F.transform("sizes", odds).alias("odds")), fitted


def term(score: Column, scores: Column, at: Column, n: Column, scale: float) -> Column:
    """scale * sigmoid(margin / n): the margin is over the best of the others' scores, or the score itself without any; half the scale
    for a text without events; null for an option without a table. scores: of all options, null for those without a table."""
    others = F.filter(scores, lambda s, i: (i != at) & s.isNotNull())
    margin = score - F.coalesce(F.array_max(others), F.lit(0.0))
    return F.when(score.isNull(), None).when(n == 0, scale * 0.5).otherwise(scale * maths.sigmoid(margin / n))


def _joined(rows: DataFrame, counts: DataFrame, wide: DataFrame, carry: list[str], folds: int) -> DataFrame:
    """rows with scores, by joins: for questions (wide: qid) whose tables are too large for a task."""
    ws = Workspace(rows.sparkSession, "options")
    cells, fitted = (df.join(wide, "qid", "left_semi") for df in tables(counts, folds))
    asked = rows.withColumn("_row", F.monotonically_increasing_id())
    asked = ws.save(asked, "asked")  # ids are drawn once and both uses see the same
    events = asked.select("_row", "fold", "qid", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("times").alias("t"))))
    met = events.join(ws.save(cells, "cells"), ["fold", "qid", "tok"]).select("_row", "t", F.posexplode("odds").alias("at", "odds"))
    sums = met.groupBy("_row", "at").agg(F.sum(F.col("t") * F.col("odds")).alias("score"))
    found = sums.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("found"))  # one an option
    out = asked.join(ws.save(fitted, "fitted"), ["fold", "qid"], "left").join(found, "_row", "left")
    place = lambda o: F.array_position("fitted", o).cast("int") - 1
    each = lambda o: F.when(place(o) >= 0, F.coalesce(F.element_at("found", place(o)), F.lit(0.0)))
    out = out.withColumn("scores", F.transform("options", each))
    return out.select(*carry, "qid", "options", "n", "scores")


class _Tables:
    """A question's counts in one task, and the odds of each fold as they are asked for."""

    def __init__(self, names: Sequence[str], option: np.ndarray, folds: np.ndarray, toks: np.ndarray, n: np.ndarray):
        """names: the options; then of each cell its option's place there, its fold, bucket and count."""
        self.names, self.toks, self.folds, self.n = names, np.unique(toks), folds, np.asarray(n, dtype=np.float64)
        self.at = np.searchsorted(self.toks, toks) * len(names) + option

    def odds(self, fold: int, alpha: float) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Places of the options that the other folds have, the question's buckets, and log2 odds (buckets by places)."""
        k, other = len(self.names), self.folds != fold
        n_in = np.bincount(self.at[other], weights=self.n[other], minlength=len(self.toks) * k).reshape(len(self.toks), k)
        live = np.flatnonzero(n_in.sum(axis=0) > 0)
        n_in = n_in[:, live]
        n_all, size, mass = n_in.sum(axis=1), n_in.sum(axis=0), alpha * BUCKETS
        odds = np.log2((n_in + alpha) / (size + mass)) - np.log2((n_all[:, None] - n_in + alpha) / (size.sum() - size + mass)) if len(live) else n_in
        odds[n_all == 0] = 0
        return {str(self.names[j]): i for i, j in enumerate(live)}, self.toks, odds


def _scored(batch: pa.RecordBatch | pa.Table, at: int, table: Callable) -> list[list[float | None] | None]:
    """The scores of each row, whose columns from `at` on are qid, options, n, fold, toks, times. table: of a fold and a qid."""
    qids, offered, folds = (batch.column(at + i).to_pylist() for i in (0, 1, 3))
    out: list[list[float | None] | None] = []
    toks, times = batch.column(at + 4), batch.column(at + 5)
    ends = np.asarray(toks.offsets) - np.asarray(toks.offsets)[0]
    toks, times = np.asarray(toks.flatten()), np.asarray(times.flatten())
    for i, (qid, names, fold) in enumerate(zip(qids, offered, folds)):
        known = table(fold, qid)
        if known is None or names is None:
            out.append(None if names is None else [None] * len(names))
            continue
        places, have, odds = known
        mine, often = toks[ends[i] : ends[i + 1]], times[ends[i] : ends[i + 1]]
        place = np.minimum(np.searchsorted(have, mine), len(have) - 1)
        hit = have[place] == mine
        score = often[hit].astype(np.float64) @ odds[place[hit]]
        out.append([float(score[places[o]]) if o in places else None for o in names])
    return out


def _shape(rows: DataFrame, carry: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in [*carry, "qid", "options", "n"]) + ", scores array<double>"


def _alphas(counts: DataFrame) -> dict[int, float]:
    """The share of buckets that rows outside a fold have, for each fold (-1: any other)."""
    seen = counts.select("fold", "tok").distinct().groupBy("tok").agg(F.count("*").alias("k"), F.min("fold").alias("f"))
    found = seen.groupBy(F.when(F.col("k") == 1, F.col("f")).alias("only")).agg(F.count("*").alias("n")).collect()  # a row a fold
    every = sum(r.n for r in found)
    return {-1: every / BUCKETS} | {r.only: (every - r.n) / BUCKETS for r in found if r.only is not None}


def _dealt(rows: DataFrame, counts: DataFrame, carry: list[str], folds: int, written: bool) -> DataFrame:
    """rows with scores, by parts of a question's rows that meet the question's tables in a task."""
    ws = Workspace(rows.sparkSession, "options")
    rows = rows if written else ws.save(rows, "rows")
    alphas = _alphas(counts)
    cells = F.sort_array(F.collect_list(F.struct("tok", "n_in"))).alias("cells")  # one a bucket
    packed = counts.groupBy("qid", "fold", "option").agg(cells).select("qid", "fold", "option", "cells.tok", "cells.n_in")
    packed = ws.save(packed, "tables")
    sizes = packed.groupBy("qid").agg(F.sum(F.size("tok")).alias("cells"))
    load = rows.groupBy("qid").agg(F.sum(F.size("toks") + 16).alias("events"))
    parts = F.ceil(F.col("events") / F.greatest(F.lit(PART_EVENTS), 4 * F.coalesce("cells", F.lit(0)))).cast("int").alias("parts")
    joint = F.col("cells").isNull() | (F.col("cells") <= MOST_OF_ONE)
    plan = load.join(sizes, "qid", "left").select("qid", parts, joint.alias("whole"))
    plan = ws.save(plan, "plan")  # a row a question
    wide = plan.where("not whole").select("qid")

    at = F.pmod(F.xxhash64(*carry, "toks"), F.col("parts")).cast("int").alias("part")
    key = F.col("qid").eqNullSafe(F.col("_qid"))
    asked = rows.join(plan.where("whole").withColumnRenamed("qid", "_qid"), key).select(*carry, "qid", "options", "n", "fold", "toks", "times", at)
    sent = packed.join(plan.where("whole"), "qid").select("qid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "fold", "option", "tok", "n_in")
    k, shape = len(carry), _shape(rows, carry)
    kinds = to_arrow_schema(StructType.fromDDL(shape))  # elements may be null there, which Arrow holds for another type

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        whole, held = None, {}
        if right.num_rows:
            sizes = np.asarray(pc.list_value_length(right["tok"]))
            names, option = np.unique(np.array(right["option"].to_pylist(), dtype=object), return_inverse=True)
            flat = [np.asarray(right[c].combine_chunks().flatten()) for c in ("tok", "n_in")]
            whole = _Tables(names, *(np.repeat(x, sizes) for x in (option, np.asarray(right["fold"]))), *flat)

        def table(fold: int, qid: str):
            if whole is not None and fold not in held:
                held[fold] = whole.odds(fold, alphas.get(fold, alphas[-1]))
            return held.get(fold)

        left = left.combine_chunks()
        found = [s for batch in left.to_batches() for s in _scored(batch, k, table)]
        columns = [*left.columns[: k + 3], pa.array(found, pa.list_(pa.float64()))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], names=kinds.names)

    out = asked.groupBy("qid", "part").cogroup(sent.groupBy("qid", "part")).applyInArrow(run, shape)
    if wide.isEmpty():
        return out
    return out.unionByName(_joined(rows.join(wide, "qid", "left_semi"), counts, wide, carry, folds))


def _sent(rows: DataFrame, counts: DataFrame, carry: list[str]) -> DataFrame:
    """rows with scores, by tables that are sent to the tasks (counts: MOST_CELLS rows at most)."""
    alphas, found = _alphas(counts), counts.toArrow().to_pandas()
    questions = {}
    for qid, part in found.groupby("qid"):
        names, option = np.unique(part["option"].to_numpy(dtype=object), return_inverse=True)
        questions[qid] = _Tables(names, option, *(part[c].to_numpy() for c in ("fold", "tok", "n_in")))
    sent = rows.sparkSession.sparkContext.broadcast((alphas, questions))  # MOST_CELLS cells at most
    held: dict = {}

    def table(fold: int, qid: str) -> tuple[dict[str, int], np.ndarray, np.ndarray] | None:
        alphas, questions = sent.value
        if qid not in questions:
            return None
        if (fold, qid) not in held:
            held[fold, qid] = questions[qid].odds(fold, alphas.get(fold, alphas[-1]))
        return held[fold, qid]

    k, names = len(carry), [*carry, "qid", "options", "n", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*batch.columns[: k + 3], pa.array(_scored(batch, k, table), pa.list_(pa.float64()))], names=names)

    return rows.select(*carry, "qid", "options", "n", "fold", "toks", "times").mapInArrow(run, _shape(rows, carry))


def scores(rows: DataFrame, counts: DataFrame, carry: list[str], folds: int, scale: float = 1.0, written: bool = False) -> DataFrame:
    """carry, qid, options, n, scores, terms of rows (carry, qid, fold, options, toks, times, n): each offered option's sum of log2
    odds of the text's events in buckets that the question's tables have, by the folds that the row isn't in (counts: fold_counts,
    written), and its term in a blend. An option that no training row answers has neither. A null question has no tables.
    written: rows are read from a written table, so reading them twice costs little.
    """
    rows = rows.select(*carry, "qid", "fold", "options", "toks", "times", "n")
    out = _sent(rows, counts, carry) if counts.count() <= MOST_CELLS else _dealt(rows, counts, carry, folds, written)
    return out.withColumn("terms", F.transform("scores", lambda s, i: term(s, F.col("scores"), i, F.col("n"), scale)))


def picks(scored: DataFrame) -> Column:
    """The first option with the largest term, null where no option has one."""
    best = F.array_max("terms")
    return F.when(best.isNotNull(), F.get("options", (F.array_position("terms", best) - 1).cast("int")))
