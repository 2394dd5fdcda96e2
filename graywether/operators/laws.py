"""Small laws of the harness as DataFrame operators: tallies, censuses, digests, budgets, choices among arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def leak_tallies(scanned: DataFrame, twins: DataFrame) -> DataFrame:
    """One row: scanned, exact, same_label, conflict. scanned: id, label; twins: query_id, twin_id of the leaked ones."""
    labels = scanned.select(F.col("id").alias("twin_id"), F.col("label").alias("twin_label"))
    found = scanned.join(twins, scanned["id"] == twins["query_id"], "left").join(labels, "twin_id", "left")
    exact = F.col("twin_id").isNotNull()
    same = exact & F.col("label").eqNullSafe(F.col("twin_label"))
    return found.agg(
        F.count("*").alias("scanned"), F.count_if(exact).alias("exact"), F.count_if(same).alias("same_label"), F.count_if(exact & ~same).alias("conflict")
    )


def subset_accuracy(items: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: n and accuracy of the items (case_id, ok) that flagged (case_id) doesn't hold; null for none."""
    left = items.join(flagged, "case_id", "left_anti")
    return left.agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n and share of the cases of both (case_id, pick) with one pick."""
    both = a.select("case_id", F.col("pick").alias("x")).join(b.select("case_id", F.col("pick").alias("y")), "case_id")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agree"))


def is_permutation(order: Column) -> Column:
    """Whether an array holds 0 to n - 1, each once."""
    return F.array_sort(order) == F.when(F.size(order) == 0, order).otherwise(F.sequence(F.lit(0), F.size(order) - 1))


def isotropic_null(m: Column, d: Column) -> Column:
    """The largest cosine that m random directions in d dimensions are expected to reach."""
    return F.sqrt(2.0 * F.log(m.cast("double")) / d)


def margins(items: DataFrame) -> DataFrame:
    """case_id, margin: how far the largest of probs is above the second."""
    top = F.sort_array("probs", asc=False)
    return items.select("case_id", (F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))).alias("margin"))


def degenerate_arm(items: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: n_positions, degenerate: whether every position of probs is the same in all cases."""
    each = items.select(F.posexplode("probs").alias("pos", "p")).groupBy("pos").agg(F.stddev_pop("p").alias("s"))
    return each.agg(F.count("*").alias("n_positions"), F.bool_and(F.col("s") < eps).alias("degenerate"))


def load_statistics(picks: DataFrame) -> DataFrame:
    """One row: n_options, max_load (largest share) and effective (exp of the entropy) of picks (pick)."""
    counts = picks.groupBy("pick").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    share = counts.crossJoin(F.broadcast(total)).select((F.col("n") / F.col("t")).alias("p"))  # one row
    return share.agg(F.count("*").alias("n_options"), F.max("p").alias("max_load"), F.exp(-F.sum(F.col("p") * F.log("p"))).alias("effective"))


def select_cap(arms: DataFrame, default: int) -> DataFrame:
    """The one of arms (cap, accuracy) with the best accuracy; ties go to the default, then to the smaller."""
    return arms.orderBy(F.desc("accuracy"), F.desc(F.col("cap") == default), "cap").limit(1)


def budget(rooms: DataFrame, most: int) -> DataFrame:
    """label, room, weight, share of rooms (label, room, weight): floor(most * weight / all weights), at most the room;
    what is left goes round by label, one each, while there is room. Without any weight all goes round.

    A round is a row for a label that has room in it, `most` at most for each label.
    """
    total = rooms.agg(F.sum("weight").alias("all"))
    base = F.least("room", F.coalesce(F.floor(F.lit(most) * F.col("weight") / F.nullif(F.col("all"), F.lit(0))), F.lit(0)))
    based = rooms.crossJoin(F.broadcast(total)).withColumn("base", base).drop("all")  # one row
    left = based.agg(F.greatest(F.lit(most) - F.sum("base"), F.lit(0)).alias("left"))
    free = F.least(F.col("room") - F.col("base"), F.lit(most))
    rounds = based.where(free > 0).select("label", F.explode(F.sequence(F.lit(1).cast("long"), free)).alias("round"))
    place = F.row_number().over(W.orderBy("round", "label"))  # labels x most rows at most
    given = rounds.withColumn("place", place).crossJoin(F.broadcast(left)).where("place <= left")
    given = given.groupBy("label").agg(F.count("*").alias("more"))
    return based.join(given, "label", "left").select("label", "room", "weight", (F.col("base") + F.coalesce("more", F.lit(0))).alias("share"))


def digest(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """by, n, digest: a sum of 32 bits of each row's MD5, so neither order nor partitions matter."""
    part = F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


def log_blend(cases: DataFrame, weight: float) -> DataFrame:
    """case_id, pick: the option of the largest ln p + weight * (d - mean d); cases: case_id, opt, p, d."""
    mean = F.avg("d").over(W.partitionBy("case_id"))
    score = F.round(F.log(F.greatest("p", F.lit(1e-12))) + weight * (F.col("d") - mean), 9)
    scored = cases.select("case_id", "opt", score.alias("s"))
    return scored.groupBy("case_id").agg(F.min_by("opt", F.struct(-F.col("s"), F.col("opt"))).alias("pick"))
