"""The decision core: every question of a state is answered by the sum of the terms that apply to it.

What depends on the state alone (cosines to the domains, count-table scores) is worked out once for a state and carried to its
questions; a decision is then a projection of its row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.operators import options

YES_NO = ("yes", "no")


@dataclass(frozen=True)
class Posture:
    """Scales of the terms, the readout and the gate. yes_domain: the domain whose table speaks for yes, where there is one."""

    route: float = 1.0
    nb: float = 1.0
    nb_pair: float = 0.0
    option: float = 1.0
    yes_domain: str | None = None
    readout: str = "dispatch"
    threshold: float = 0.0


def fold_centroids(rows: DataFrame) -> DataFrame:
    """fold, domains (label, dir): for each fold the labels' mean directions by the vectors of the other folds (fold, label, vector).

    One shuffle of partial sums by fold, label and place; a row a fold comes out, as long as the labels are many.
    """
    long = rows.where("label is not null").select("fold", "label", F.posexplode("vector").alias("dim", "x"))
    own = long.groupBy("fold", "label", "dim").agg(F.sum("x").alias("s"))
    folds = rows.select("fold").distinct()
    all_of = own.groupBy("label", "dim").agg(F.sum("s").alias("s_all"), F.map_from_entries(F.collect_list(F.struct("fold", "s"))).alias("by_fold"))  # one a fold
    others = all_of.join(F.broadcast(folds)).withColumn("s", F.col("s_all") - F.coalesce(F.element_at("by_fold", F.col("fold")), F.lit(0.0)))
    others = others.where(F.size("by_fold") > F.map_contains_key("by_fold", F.col("fold")).cast("int"))  # some other fold has the label
    packed = others.groupBy("fold", "label").agg(F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("p"))
    return packed.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("label", maths.unit(F.transform("p", lambda x: x["s"])).alias("dir")))).alias("domains"))


def cosines(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """rows (fold, vector) with cosines (label, score) to the domains that their fold has, by label; empty without any."""
    found = F.transform("domains", lambda d: F.struct(d["label"].alias("label"), maths.dot(F.col("vector"), d["dir"]).alias("score")))
    return rows.join(cents, "fold", "left").withColumn("cosines", F.coalesce(found, F.array().cast("array<struct<label: string, score: double>>"))).drop("domains")


def _of(scores: Column, label: Column) -> Column:
    """The score of a label in an array (label, score), 0 where it has none."""
    return F.coalesce(F.get(F.filter(scores, lambda s: s["label"] == label), F.lit(0))["score"], F.lit(0.0))


def blend(margin: Column, n: Column, scale: float) -> Column:
    return F.when(n == 0, scale * 0.5).otherwise(scale * maths.sigmoid(margin / n))


def _margin(label: Column, own: Column, among: Column, scores: Column) -> Column:
    """How far a label's own score is above the best of the others in `among` (labels, with their scores); the score itself without others."""
    others = F.zip_with(among, scores, lambda d, s: F.when(d != label, s))
    return own - F.coalesce(F.array_max(others), F.lit(0.0))


def decide(asked: DataFrame, carry: list[str], posture: Posture = Posture()) -> DataFrame:
    """carry, qid, kind, options, probs (six decimals), pick, conf, cause of rows (carry, qid, kind, options, n, cosines, nb, scores).

    kind is choice, score or noul (whose options are yes and no). cosines and nb hold (label, score) of the domains; scores holds
    the options' own tables' scores, null for an option without one. The terms of an option are added:

    * route: sigmoid of the scaled cosine, and nb: the margin over all other domains by event, where every option of a choice or a
      score is a domain's name; otherwise no option has them;
    * nb_pair: the margin over the other offered options;
    * for a noul the yes domain's nb term, and what the scale leaves for no;
    * option: the margin over the question's other options by event; nothing for an option without a table.

    Shares of the sums are the probabilities, even ones where all sums are 0; the first largest is picked. cause is score_gate
    below the threshold, no_option where there is nothing to pick from, else answered. Null options count as options that no table has.
    """
    p = posture
    n, nb = F.col("n"), F.coalesce("nb", F.array().cast("array<struct<label: string, score: double>>"))
    domains = F.transform("cosines", lambda d: d["label"])
    offered = F.when(F.col("kind") == "noul", F.array(*map(F.lit, YES_NO))).otherwise(F.coalesce("options", F.array().cast("array<string>")))
    rows = asked.withColumn("options", offered).withColumn("_nb", nb).withColumn("_domains", domains)
    # scores in the order of the domains and of the options, looked up once
    for names, scores in (("_domains", "_by_domain"), ("options", "_by_option")):
        rows = rows.withColumn(scores, F.transform(names, lambda d: _of(F.col("_nb"), d)))
    named = (F.col("kind") != "noul") & (F.size("options") > 0) & F.forall("options", lambda o: F.coalesce(F.array_contains("_domains", F.coalesce(o, F.lit("\0"))), F.lit(False)))
    rows = rows.withColumn("_named", F.coalesce(named, F.lit(False)))

    def score(option: Column, i: Column) -> Column:
        routed = maths.sigmoid(p.route * _of(F.col("cosines"), option)) + blend(_margin(option, F.get("_by_option", i), F.col("_domains"), F.col("_by_domain")), n, p.nb)
        if p.nb_pair:
            routed = routed + F.when(F.size("options") > 1, p.nb_pair * maths.sigmoid(_margin(option, F.get("_by_option", i), F.col("options"), F.col("_by_option")))).otherwise(0.0)
        s = F.when(F.col("_named"), routed).otherwise(0.0)
        if p.yes_domain is not None:
            speaks = F.lit(p.yes_domain)
            yes = blend(_margin(speaks, _of(F.col("_nb"), speaks), F.col("_domains"), F.col("_by_domain")), n, p.nb)
            s = s + F.when(F.col("kind") == "noul", F.when(option == "yes", yes).otherwise(p.nb - yes)).otherwise(0.0)
        own = options.term(F.get("scores", i), F.col("scores"), i, n, p.option)
        return s + F.coalesce(own, F.lit(0.0))

    rows = rows.withColumn("probs", F.transform(maths.shares(F.transform("options", score)), lambda x: F.round(x, 6)))
    some = F.size("options") > 0
    rows = rows.withColumn("pick", F.when(some, F.get("options", maths.argmax_first(F.col("probs")))))
    rows = rows.withColumn("conf", F.when(some, F.round(maths.readout(F.col("probs"), p.readout), 6)))
    cause = F.when(~some, "no_option").when(F.col("conf") < p.threshold, "score_gate").otherwise("answered")
    return rows.select(*carry, "qid", "kind", "options", "probs", "pick", "conf", cause.alias("cause"))
