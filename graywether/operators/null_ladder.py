"""Null stability: what decoy options do to an answer. Arms add decoys; every arm is compared with the arm without.

The oracle that answers is a function from questions (case_id, k, options, n_own) to answers (probs over the options shown,
pick, confidence, abstained, regime, p_yes, in columns beside them); everything else is joins on the case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywether.functions.maths import readout
from graywether.operators.ordered import running

Oracle = Callable[[DataFrame], DataFrame]


def arms(cases: DataFrame, ladder: list[int]) -> DataFrame:
    """The questions of cases (case_id, options, decoys): for each k of the ladder the options and the first k decoys, or all if
    there are fewer. A case is a row for each arm; other columns are carried."""
    k = F.explode(F.array(*map(F.lit, ladder))).alias("k")
    rows = cases.select("*", k)
    shown = F.concat("options", F.slice("decoys", 1, F.col("k")))
    return rows.withColumn("n_own", F.size("options")).withColumn("options", F.when(F.col("k") == 0, F.col("options")).otherwise(shown)).drop("decoys")


def records(answers: DataFrame) -> DataFrame:
    """case_id, k, n_shown, a, b, tie, p_a, p_b, decoy_won, abstained, confidence, inv_entropy, regime, p_yes and the same of arm 0
    (p_a0, p_b0, abstained0, confidence0, regime0, p_yes0): a and b are the two own options that arm 0 finds most likely."""
    own = F.slice("probs", 1, F.col("n_own"))
    order = F.array_sort(F.transform(own, lambda p, i: F.struct((-p).alias("o"), i.alias("i"))))
    first = answers.where("k = 0").select(
        "case_id",
        F.get(order, F.lit(0))["i"].alias("ia"),
        F.get(order, F.lit(1))["i"].alias("ib"),
        F.get("options", F.get(order, F.lit(0))["i"]).alias("a"),
        F.get("options", F.get(order, F.lit(1))["i"]).alias("b"),
        (-F.get(order, F.lit(0))["o"]).alias("p_a0"),
        (-F.get(order, F.lit(1))["o"]).alias("p_b0"),
        *(F.col(c).alias(f"{c}0") for c in ("abstained", "confidence", "regime", "p_yes")),
    )
    met = answers.join(first, "case_id")
    return met.select(
        "case_id", "k", F.size("options").alias("n_shown"), "a", "b", (F.col("p_a0") == F.col("p_b0")).cast("int").alias("tie"),
        F.get("probs", F.col("ia")).alias("p_a"), F.get("probs", F.col("ib")).alias("p_b"), (F.col("pick") >= F.col("n_own")).cast("int").alias("decoy_won"),
        "abstained", "confidence", readout(F.col("probs"), "inv_entropy").alias("inv_entropy"), "regime", "p_yes", "p_a0", "p_b0", "abstained0", "confidence0", "regime0", "p_yes0",
    )


def _middle(rows: DataFrame, x: str) -> DataFrame:
    """k, median: the element n // 2 of x (six decimals) in each arm."""
    each = running(rows.groupBy("k", F.round(x, 6).alias("x")).agg(F.count("*").alias("c")), "x", ["c"], ("k",))
    place = F.floor(F.col("c_all") / 2)
    return each.where((place < F.col("c_upto")) & (place >= F.col("c_upto") - F.col("c"))).select("k", F.col("x").alias("median"))


def drift(recs: DataFrame) -> DataFrame:
    """A1: k, abstain_rate, d_abstain_pt, median_d_conf_pt, decoy_win_rate of each arm."""
    rows = recs.withColumn("gap", F.abs(F.col("confidence") - F.col("confidence0")) * 100)
    sums = rows.groupBy("k").agg(F.avg("abstained").alias("abstain_rate"), F.avg("abstained0").alias("base"), F.avg("decoy_won").alias("decoy_win_rate"))
    return sums.join(_middle(rows, "gap"), "k").select(
        "k", "abstain_rate", ((F.col("abstain_rate") - F.col("base")) * 100).alias("d_abstain_pt"), F.col("median").alias("median_d_conf_pt"), "decoy_win_rate"
    )


def flips(recs: DataFrame) -> DataFrame:
    """A2: k, n_untied, flips, flip_rate, within, cross, verdict of each arm: cases whose preference between a and b turns round, those
    that tie without decoys left out. A flip within a regime is RED; one across regimes is only told."""
    before, after = F.col("p_a0") - F.col("p_b0"), F.col("p_a") - F.col("p_b")
    untied = F.col("tie") == 0
    turned = untied & (((before > 0) & (after < 0)) | ((before < 0) & (after > 0)))
    same = F.col("regime") == F.col("regime0")
    sums = recs.groupBy("k").agg(F.count_if(untied).alias("n_untied"), F.count_if(turned).alias("flips"), F.count_if(turned & same).alias("within"), F.count_if(turned & ~same).alias("cross"))
    rate = F.coalesce(F.col("flips") / F.nullif(F.col("n_untied"), F.lit(0)), F.lit(0.0))
    return sums.select("k", "n_untied", "flips", rate.alias("flip_rate"), "within", "cross", F.when(F.col("within") > 0, "RED").otherwise("PASS").alias("verdict"))


def shape(recs: DataFrame) -> DataFrame:
    """A3: one row, noul_identical (null where no arm answers yes or no), conf_shape (conditional if the last arm's confidences are those
    of arm 0, else joint) and median_d_conf_top_pt. No row without records."""
    top = F.broadcast(recs.agg(F.max("k").alias("top")))  # one row
    rows = recs.crossJoin(top)
    answered = rows.groupBy("case_id").agg(F.count("p_yes").alias("n"), (F.min("p_yes") == F.max("p_yes")).alias("same")).where("n > 0")
    noul = answered.agg(F.min(F.col("same").cast("int")).alias("noul_identical"))
    last = rows.where("k = top").withColumn("gap", F.abs(F.col("confidence") - F.col("confidence0")) * 100)
    bits = last.agg(F.min((F.col("confidence") == F.col("confidence0")).cast("int")).alias("same"))
    median = _middle(last, "gap").select(F.col("median").alias("median_d_conf_top_pt"))
    return median.crossJoin(F.broadcast(noul)).crossJoin(F.broadcast(bits)).select(  # one row each
        "noul_identical", F.when(F.col("same") == 1, "conditional").otherwise("joint").alias("conf_shape"), "median_d_conf_top_pt"
    )


def run(cases: DataFrame, ladder: list[int], oracle: Oracle) -> DataFrame:
    """The records of all cases under the ladder, which has to begin with 0."""
    if not ladder or ladder[0] != 0:
        raise ValueError("the ladder begins with 0 decoys")
    return records(oracle(arms(cases, ladder)))
