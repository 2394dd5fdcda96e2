"""Naive Bayes scores of hashed rows, by the count tables of the folds that a row isn't in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graywether.functions.text import BUCKETS
from graywether.operators import events
from graywether.sources.steps import Workspace

#: Bytes of all folds' tables that are sent to the tasks whole; larger ones are joined.
MOST_TABLE = 256 << 20


def fold_counts(rows: DataFrame) -> DataFrame:
    """fold, label, tok, n_in of rows (label, fold, toks, times); rows without a label count for none."""
    cells = rows.where("label is not null").select("fold", "label", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("times").alias("t"))))
    return cells.groupBy("fold", "label", "tok").agg(F.sum("t").alias("n_in"))


def _tables(counts: DataFrame, alpha: float | None) -> tuple[list, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The labels, and by fold (-1: any that has no counts): log-odds (buckets by labels), labels that its training rows
    have, buckets they have."""
    found = counts.toArrow().to_pandas()
    labels = sorted(found["label"].unique())
    place = {label: i for i, label in enumerate(labels)}
    folds = sorted(found["fold"].unique())
    own = {f: np.zeros((BUCKETS, len(labels))) for f in folds}
    for (f, label), part in found.groupby(["fold", "label"]):
        own[f][part["tok"].to_numpy(), place[label]] = part["n_in"].to_numpy()
    total = sum(own.values(), np.zeros((BUCKETS, len(labels))))
    out = {}
    for f in [*folds, -1]:
        n_in = total - own.get(f, 0)
        n_all, size = n_in.sum(axis=1), n_in.sum(axis=0)
        a = np.count_nonzero(n_all) / BUCKETS if alpha is None else alpha
        with np.errstate(divide="ignore", invalid="ignore"):  # a fold that leaves no training rows scores nothing
            inside = (n_in + a) / (size + a * BUCKETS)
            outside = (n_all[:, None] - n_in + a) / (size.sum() - size + a * BUCKETS)
            odds = np.log2(inside) - np.log2(outside)
        odds[n_all == 0] = 0
        out[int(f)] = (odds, size > 0, n_all > 0)
    return labels, out


def _joined(rows: DataFrame, counts: DataFrame, carry: list[str], folds: int, alpha: float | None) -> DataFrame:
    """The scores by joins: for tables that are too large to be sent whole."""
    odds = events.log_odds(events.other_folds(counts, "label", "fold", folds), "label", alpha, by=("fold",))
    # a bucket's scores in one row, so that an event meets one row and not one for each label
    packed = odds.groupBy("fold", "tok").agg(F.collect_list(F.struct("label", "score")).alias("odds"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    cells = keyed.select("_row", "fold", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("times").alias("t"))))
    met = cells.join(packed, ["fold", "tok"])
    seen = met.groupBy("_row").agg(F.sum("t").alias("seen"))
    sums = met.select("_row", "t", F.inline("odds")).groupBy("_row", "label").agg(F.sum(F.col("t") * F.col("score")).alias("score"))
    listed = sums.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("label", "score"))).alias("scores"))  # one a label
    return keyed.join(listed, "_row", "left").join(seen, "_row", "left").select(*carry, "n", F.coalesce("seen", F.lit(0)).alias("seen"), "scores")


def scores(rows: DataFrame, counts: DataFrame, carry: list[str], alpha: float | None = 1.0) -> DataFrame:
    """carry, n, seen, scores (label and score, by label) of rows (fold, toks, times, n): the sum of the log-odds of a row's
    events that the other folds have, `seen` of them; scores is null where there is none. counts: fold, label, tok, n_in
    (a written table). A row's fold needs no rows of its own in counts. alpha: the count that every bucket gets beforehand; None
    takes the share of buckets that the training rows have."""
    shape = counts.agg(F.count_distinct("fold", "label").alias("n"), F.max("fold").alias("f")).first()
    if shape.n * BUCKETS * 8 > MOST_TABLE:
        return _joined(rows, counts, carry, shape.f + 1, alpha)
    labels, tables = _tables(counts, alpha)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((labels, tables))  # MOST_TABLE bytes at most
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind = counts.schema["label"].dataType
    item = pa.struct([("label", to_arrow_type(kind)), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, tables = sent.value
        k = len(carry)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes = np.diff(np.asarray(batch.column(k + 2).offsets))
                toks, times = (np.asarray(batch.column(k + i).flatten()) for i in (2, 3))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                folds = np.asarray(batch.column(k + 1))
                score, seen = np.zeros((len(sizes), len(labels))), np.zeros(len(sizes), np.int64)
                live = np.zeros((len(sizes), len(labels)), bool)
                for f in np.unique(folds):
                    odds, known, have = tables.get(int(f)) or tables[-1]
                    mine = np.flatnonzero(folds[owner] == f)
                    t, w, o = toks[mine], times[mine], owner[mine]
                    seen += np.bincount(o, weights=w * have[t], minlength=len(sizes)).astype(np.int64)
                    for j in range(len(labels)):
                        score[:, j] += np.bincount(o, weights=w * odds[t, j], minlength=len(sizes))
                    live[folds == f] = known
                live &= (seen > 0)[:, None]
                offsets = pa.array(np.concatenate([[0], np.cumsum(live.sum(axis=1))]).astype(np.int32))
                flat = np.nonzero(live)
                values = pa.StructArray.from_arrays([pa.array([labels[j] for j in flat[1]], item[0].type), pa.array(score[flat])], fields=list(item))
                listed = pa.ListArray.from_arrays(offsets, values, mask=pa.array(seen == 0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], batch.column(k), pa.array(seen), listed], names=[*carry, "n", "seen", "scores"])

    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return rows.select(*carry, "n", "fold", "toks", "times").mapInArrow(run, f"{carried}, n long, seen long, scores array<struct<label: {kind.simpleString()}, score: double>>")


def transductive(rows: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, gold, fold, honest, pick of the rows (doc_id, gold, label, fold, known, toks, times, n) that aren't known: known ones (fold 2) are the
    labelled pool, the others are in fold 0 or 1. honest is decided by the pool's tables, pick by tables of the pool and of
    the other half's honest picks, so no row is scored by a table that it is in. decide: scored rows (doc_id, gold, n, seen,
    scores) to picks, with doc_id passed on. A row without evidence has no pick and joins no table.
    """
    ws = Workspace(rows.sparkSession, "transductive")
    pool, others = rows.where("known"), rows.where("not known")
    counts = ws.save(fold_counts(pool), "pool")
    # the whole row rides along as its id, so no join is needed to find it again
    keyed = others.select(F.struct("doc_id", "gold", "fold", "toks", "times", "n").alias("doc_id"), "gold", "fold", "toks", "times", "n")
    first = decide(scores(keyed, counts, ["doc_id", "gold"])).select(F.col("doc_id").alias("row"), F.col("pick").alias("honest"))
    first = ws.save(first.select("row.*", "honest"), "first")
    pseudo = first.select(F.col("honest").alias("label"), "fold", "toks", "times")
    both = ws.save(fold_counts(pool.select("label", "fold", "toks", "times").unionByName(pseudo)), "both")
    again = first.select(F.struct("doc_id", "fold", "honest").alias("doc_id"), "gold", "fold", "toks", "times", "n")
    second = decide(scores(again, both, ["doc_id", "gold"]))
    return second.select("doc_id.doc_id", "gold", "doc_id.fold", "doc_id.honest", "pick")
