"""Queries of the small laws: tallies, censuses, digests, budgets, choices among arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from graywether.functions import text as T
from graywether.operators import laws, leaks, ranking
from graywether.plans.lanes import AB, A, items, lane_sql, r6, routed
from graywether.plans.registry import query
from graywether.plans.texts import NORMAL, RUNS, TURNS, docs, turns
from graywether.sources.tables import table

TWINS = f"r AS (SELECT doc_id, lang, {NORMAL.format('text')} AS normal FROM documents), m AS (SELECT normal, min(doc_id) AS twin_id FROM r GROUP BY normal), tw AS (SELECT doc_id AS query_id, twin_id, lang FROM r JOIN m USING (normal) WHERE doc_id > twin_id)"


def _twins(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return leaks.exact_twins(rows, rows).where("query_id > twin_id")


@query(f"WITH {TWINS} SELECT (SELECT count(*) FROM documents) AS scanned, count(*) AS exact, count(*) FILTER (tw.lang IS NOT DISTINCT FROM d.lang) AS same_label, count(*) FILTER (tw.lang IS DISTINCT FROM d.lang) AS conflict FROM tw JOIN documents d ON d.doc_id = twin_id")
def leak_tallies(spark, sf_dir):
    return laws.leak_tallies(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), _twins(spark, sf_dir))


@query(A + f", {TWINS} SELECT count(*) AS n, round(avg(ok), 6) AS accuracy FROM items_a WHERE case_id NOT IN (SELECT query_id FROM tw)")
def deleaked_accuracy(spark, sf_dir):
    """Accuracy over the vectors whose number is no leaked document's."""
    return r6(laws.subset_accuracy(items(spark, sf_dir), _twins(spark, sf_dir).select(F.col("query_id").alias("case_id"))))


@query(AB + " SELECT count(*) AS n, round(avg((a.pick = b.pick)::INT), 6) AS agree FROM items_a a JOIN items_b b USING (case_id)")
def route_agreement(spark, sf_dir):
    return r6(laws.agreement(items(spark, sf_dir), items(spark, sf_dir, 32)))


@query(A + " SELECT pick AS label, count(*) AS n FROM items_a GROUP BY pick")
def routing_census(spark, sf_dir):
    return items(spark, sf_dir).groupBy(F.col("pick").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, list_sort(list((turn - low)::INT)) = range(0, count(*)) AS valid FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS low FROM conversations) GROUP BY conv_id")
def permutation_validity(spark, sf_dir):
    """Whether a conversation's turns number it without gaps and repeats."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    order = F.transform("turns", lambda t: (t - F.array_min("turns")).cast("int"))
    return rows.select("conv_id", laws.is_permutation(order).alias("valid"))


@query(A + " SELECT q AS rate, round(v, 6) AS value FROM (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q, unnest(quantile_cont(conf, [0.1, 0.5, 0.9])) AS v FROM items_a)")
def interpolated_quantiles(spark, sf_dir):
    rates = F.array(*[F.lit(r) for r in (0.1, 0.5, 0.9)])
    found = items(spark, sf_dir).agg(F.percentile("conf", rates).alias("v"))
    return r6(found.select(F.inline(F.arrays_zip(rates.alias("rate"), F.col("v").alias("value")))))


MARGINS = A + """, s AS (SELECT case_id, p, row_number() OVER (PARTITION BY case_id ORDER BY p DESC) AS k FROM pr_a),
    g AS (SELECT case_id, round(max(CASE WHEN k = 1 THEN p END) - coalesce(max(CASE WHEN k = 2 THEN p END), 0), 6) AS margin FROM s GROUP BY case_id)"""


@query(MARGINS + """, o AS (SELECT margin, row_number() OVER (ORDER BY margin) - 1 AS i, count(*) OVER () AS n FROM g), q AS (SELECT unnest([0.05, 0.25, 0.5])::DOUBLE AS rate)
    SELECT rate, margin AS threshold FROM q JOIN o ON i = least(floor(n * rate), n - 1)""")
def margin_quantiles(spark, sf_dir):
    rows = laws.margins(items(spark, sf_dir)).select(F.round("margin", 6).alias("x"))
    return ranking.percentiles(rows, [0.05, 0.25, 0.5]).select("rate", "threshold")


@query("SELECT label, count(*) AS n, round(sqrt(2 * ln(count(*)) / 64), 6) AS reference FROM embeddings GROUP BY label")
def isotropic_null_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return r6(rows.select("label", "n", laws.isotropic_null(F.col("n"), F.lit(64.0)).alias("reference")))


@query(A + " SELECT count(*) AS n_positions, bool_and(s < 1e-6) AS degenerate FROM (SELECT opt, stddev_pop(p) AS s FROM pr_a GROUP BY opt)")
def degenerate_arm(spark, sf_dir):
    return laws.degenerate_arm(items(spark, sf_dir))


@query(A + ", c AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM items_a GROUP BY pick) SELECT count(*) AS n_options, round(max(p), 6)::DOUBLE AS max_load, round(exp(-sum(p * ln(p))), 6) AS effective FROM c")
def router_load(spark, sf_dir):
    return r6(laws.load_statistics(items(spark, sf_dir)))


@query(AB + "," + lane_sql("c", 16) + """, arms AS (SELECT 64 AS cap, avg(ok) AS accuracy FROM items_a UNION ALL SELECT 32, avg(ok) FROM items_b UNION ALL SELECT 16, avg(ok) FROM items_c)
    SELECT cap::INT AS cap, round(accuracy, 6) AS accuracy FROM arms ORDER BY accuracy DESC, cap = 64 DESC, cap LIMIT 1""")
def cap_selection(spark, sf_dir):
    """Of 16, 32 and 64 dimensions those that answer best."""
    arms = [items(spark, sf_dir, d).agg(F.avg("ok").alias("accuracy")).select(F.lit(d).alias("cap"), "accuracy") for d in (16, 32, 64)]
    return r6(laws.select_cap(reduce(lambda a, b: a.union(b), arms), 64))


@query("""WITH l AS (SELECT lang AS label, count(*) AS room, count(DISTINCT source) AS weight FROM documents GROUP BY lang),
    b AS (SELECT *, least(room, floor(150 * weight / sum(weight) OVER ()))::BIGINT AS base FROM l),
    r AS (SELECT label, unnest(range(1, least(room - base, 150) + 1)) AS round FROM b WHERE room > base),
    g AS (SELECT label, row_number() OVER (ORDER BY round, label) AS place FROM r),
    m AS (SELECT label, count(*) AS more FROM g WHERE place <= 150 - (SELECT sum(base) FROM b) GROUP BY label)
    SELECT label, room, weight, base + coalesce(more, 0) AS share FROM b LEFT JOIN m USING (label)""")
def weighted_budget(spark, sf_dir):
    rooms = docs(spark, sf_dir).groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("room"), F.countDistinct("source").alias("weight"))
    return laws.budget(rooms, 150)


@query("SELECT lang, count(*) AS n, sum(('0x' || substr(md5(doc_id || ':' || text), 1, 8))::BIGINT)::BIGINT AS digest FROM documents GROUP BY lang")
def corpus_digest(spark, sf_dir):
    return laws.digest(docs(spark, sf_dir), "lang", F.concat_ws(":", F.col("doc_id").cast("string"), "text"))


@query(AB + """, m AS (SELECT a.case_id, a.opt, a.p, b.dot AS d, avg(b.dot) OVER (PARTITION BY a.case_id) AS mean FROM pr_a a JOIN pr_b b USING (case_id, opt)),
    s AS (SELECT case_id, opt, round(ln(greatest(p, 1e-12)) + 0.5 * (d - mean), 9) AS s FROM m)
    SELECT case_id, first(opt ORDER BY s DESC, opt) AS pick FROM s GROUP BY case_id""")
def log_blend_pick(spark, sf_dir):
    """Lane A's probabilities, moved by lane B's similarities."""
    a = items(spark, sf_dir).select("case_id", F.inline(F.arrays_zip("labels", "probs")))
    b = routed(spark, sf_dir, 32).select("case_id", F.inline(F.arrays_zip("labels", "dots")))
    cases = a.withColumnRenamed("probs", "p").join(b.withColumnRenamed("dots", "d"), ["case_id", "labels"]).withColumnRenamed("labels", "opt")
    return laws.log_blend(cases, 0.5)


@query(f"WITH {TURNS} SELECT conv_id, turn, len(list_intersect(list_distinct({RUNS.format('premise')}), list_distinct({RUNS.format('hypothesis')})))::INT AS shared FROM t WHERE premise IS NOT NULL")
def shared_set_sizes(spark, sf_dir):
    shared = F.size(F.array_intersect(T.runs(F.col("premise")), T.runs(F.col("hypothesis"))))
    return turns(spark, sf_dir).select("conv_id", "turn", shared.alias("shared"))


@query("SELECT doc_id, instr(lower(text), 'the')::INT AS place FROM documents")
def substring_positions(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.instr(F.lower("text"), "the").alias("place"))


@query(f"SELECT doc_id, len(ws)::INT AS n_runs, len(list_distinct(ws))::INT AS n_distinct FROM (SELECT doc_id, {RUNS.format('text')} AS ws FROM documents)")
def learnability_tokens(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.array(T.runs(F.col("text")))).alias("ws"))
    return rows.select("doc_id", F.size("ws").alias("n_runs"), F.size(F.array_distinct("ws")).alias("n_distinct"))


@query(A + " SELECT gold, count(*) FILTER (ok = 1 AND conf >= 0.5) AS sure_right, count(*) FILTER (ok = 0 AND conf >= 0.5) AS sure_wrong, count(*) FILTER (ok = 1 AND conf < 0.5) AS unsure_right, count(*) FILTER (ok = 0 AND conf < 0.5) AS unsure_wrong FROM items_a GROUP BY gold")
def fate_census(spark, sf_dir):
    sure, right = F.col("conf") >= 0.5, F.col("ok") == 1
    fates = {"sure_right": sure & right, "sure_wrong": sure & ~right, "unsure_right": ~sure & right, "unsure_wrong": ~sure & ~right}
    return items(spark, sf_dir).groupBy("gold").agg(*[F.count_if(c).alias(n) for n, c in fates.items()])


@query(A + " SELECT case_id, gold, conf FROM (SELECT case_id, gold, round(conf, 6) AS conf, ok FROM items_a) WHERE ok = 1")
def veto_accepted(spark, sf_dir):
    """The cases whose lane picks the gold label: what a veto lets through."""
    return r6(items(spark, sf_dir).where("ok = 1").select("case_id", "gold", "conf"))


@query(A + " SELECT case_id, ok, round(conf, 6) AS conf FROM items_a")
def readout_pairs(spark, sf_dir):
    return r6(items(spark, sf_dir).select("case_id", "ok", "conf"))
