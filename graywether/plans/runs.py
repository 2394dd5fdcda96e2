"""Queries of repeated answers: ensembles, resampled thresholds, posture search, decoy ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.operators import descent, ensemble, metrics, null_ladder, stability, vectors
from graywether.plans.fits import HEADS, head_rows
from graywether.plans.lanes import A, OBSERVED, items, lane_sql, r6, routed
from graywether.plans.registry import query
from graywether.plans.verdicts import DRAW
from graywether.sources.steps import Workspace
from graywether.sources.tables import table

SAMPLES, RATE = 8, 0.2


def mc_sql(rate: float, tag: str = "") -> str:
    return f"""
    mk{tag} AS (SELECT vec_id, label, k, dim, CASE WHEN k > 0 AND ('0x' || substr(md5(vec_id::VARCHAR || ':' || k::VARCHAR || ':' || (dim // 16)::VARCHAR), (2 * (dim % 16) + 1)::INT, 2))::INT < {int(rate * 256)} THEN 0 ELSE x END AS x FROM u_a, (SELECT unnest(range({SAMPLES})) AS k)),
    ml{tag} AS (SELECT vec_id, k, sqrt(sum(x * x)) AS l FROM mk{tag} GROUP BY ALL),
    md{tag} AS (SELECT m.vec_id AS case_id, m.label AS gold, k, c.label AS opt, sum(m.x / CASE WHEN l = 0 THEN 1 ELSE l END * c.x) AS dot FROM mk{tag} m JOIN ml{tag} USING (vec_id, k) JOIN cent_a c USING (dim) GROUP BY ALL),
    mp{tag} AS (SELECT *, round(s / sum(s) OVER (PARTITION BY case_id, k), 6) AS p FROM (SELECT *, 1 / (1 + exp(-8 * (dot - 0.35))) AS s FROM md{tag})),
    mw{tag} AS (SELECT *, opt = first(opt) OVER (PARTITION BY case_id, k ORDER BY p DESC, opt) AS picked FROM mp{tag}),
    mh{tag} AS (SELECT case_id, gold, opt, count(*) AS n, sum(picked::INT)::BIGINT AS picks, avg(p) AS mean, stddev_pop(p) AS sigma FROM mw{tag} GROUP BY ALL),
    mr{tag} AS (SELECT case_id, gold, first(opt ORDER BY picks DESC, opt) AS majority, first(opt ORDER BY round(mean, 9) DESC, opt) AS by_mean, first(opt ORDER BY round(mean - sigma, 9) DESC, opt) AS by_bound,
        1 - sum(picks * (picks - 1)) / (max(n) * (max(n) - 1)) AS u_pair, 1 - max(picks) / max(n) AS u_bon FROM mh{tag} GROUP BY ALL)"""


MC = A + "," + mc_sql(RATE)


def folded(spark: SparkSession, sf_dir: str, rate: float = RATE) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ensemble.fold(ensemble.samples(rows, vectors.centroids(rows), SAMPLES, rate))


@query(MC + " SELECT case_id, opt, n, picks, round(mean * n, 6) AS mass, round(sigma, 6) AS sigma FROM mh")
def mc_histograms(spark, sf_dir):
    """Picks and moments of every option over eight samples, one of them whole, that drop a fifth of the dimensions."""
    return r6(folded(spark, sf_dir).withColumn("mass", F.col("mean") * F.col("n")).drop("gold", "mean"))


@query(MC + " SELECT case_id, majority, by_mean, by_bound, round(u_pair, 6) AS u_pair, round(u_bon, 6) AS u_bon FROM mr")
def mc_readouts(spark, sf_dir):
    return r6(ensemble.readouts(folded(spark, sf_dir)).drop("gold"))


@query(MC + " SELECT count(*) AS n, round(avg((majority = gold)::INT), 6) AS majority, round(avg((by_mean = gold)::INT), 6) AS by_mean, round(avg((by_bound = gold)::INT), 6) AS by_bound, count(*) FILTER (by_bound <> by_mean) AS bound_flips FROM mr")
def mc_rules(spark, sf_dir):
    return r6(ensemble.rules(ensemble.readouts(folded(spark, sf_dir))))


@query(MC + """, ky AS (SELECT 'confidence' AS key, i.case_id, conf, ok FROM items_a i UNION ALL SELECT 'pair', case_id, round(1 - u_pair, 6), ok FROM mr JOIN items_a USING (case_id) UNION ALL SELECT 'majority', case_id, round(1 - u_bon, 6), ok FROM mr JOIN items_a USING (case_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conf DESC, case_id) AS r, count(*) OVER (PARTITION BY key) AS n FROM ky)
    SELECT key, share, round(avg(ok) FILTER (r <= greatest(1, floor(n * share))), 6) AS acc FROM rk, (SELECT unnest([0.5, 0.8, 1.0])::DOUBLE AS share) GROUP BY key, share""")
def mc_coverage(spark, sf_dir):
    """Accuracy of the plain answers that each key of rejection keeps at three coverages."""
    read = Workspace(spark, "mc").save(ensemble.readouts(folded(spark, sf_dir)), "read").join(items(spark, sf_dir).select("case_id", "conf", "ok"), "case_id")
    found = None
    for name, key in (("confidence", F.col("conf")), ("pair", F.round(1 - F.col("u_pair"), 6)), ("majority", F.round(1 - F.col("u_bon"), 6))):
        part = metrics.accuracy_at(read.select("case_id", key.alias("conf"), "ok"), 0.5, 0.8, 1.0).select(F.lit(name).alias("key"), "share", "acc")
        found = part if found is None else found.unionByName(part)
    return r6(found)


DOSES = [0.05, 0.1, 0.2, 0.3]


@query(A + "," + ",".join(mc_sql(p, f"_{i}") for i, p in enumerate(DOSES)) + ", al AS (" + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS rate, case_id, majority = gold AS ok, u_pair FROM mr_{i}" for i, p in enumerate(DOSES)) + """),
    ag AS (SELECT rate, avg(ok::INT) FILTER (case_id % 2 = 0) AS cal, avg(ok::INT) FILTER (case_id % 2 = 1) AS held, avg(u_pair) AS mean_u_pair FROM al GROUP BY rate)
    SELECT rate, round(cal, 6) AS cal_accuracy, round(held, 6) AS held_accuracy, round(mean_u_pair, 6) AS mean_u_pair, (rate = (SELECT rate FROM ag ORDER BY cal DESC, rate LIMIT 1))::INT AS selected FROM ag""")
def mc_doses(spark, sf_dir):
    """A rate of dropping, selected on the vectors of even number by the majority's accuracy, the least of equals."""
    found = None
    for rate in DOSES:
        part = ensemble.readouts(folded(spark, sf_dir, rate)).select(F.lit(rate).alias("rate"), "case_id", (F.col("majority") == F.col("gold")).cast("int").alias("ok"), "u_pair")
        found = part if found is None else found.unionByName(part)
    even = F.col("case_id") % 2 == 0
    rungs = found.groupBy("rate").agg(F.avg(F.when(even, F.col("ok"))).alias("cal_accuracy"), F.avg(F.when(~even, F.col("ok"))).alias("held_accuracy"), F.avg("u_pair").alias("mean_u_pair"))
    rungs = Workspace(spark, "mc_doses").save(rungs, "rungs")
    best = F.broadcast(rungs.agg(F.min(F.struct((-F.col("cal_accuracy")).alias("o"), "rate"))["rate"].alias("best")))  # one row
    return r6(rungs.crossJoin(best).withColumn("selected", (F.col("rate") == F.col("best")).cast("int")).drop("best"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axis, key, score, ok of every vector's answer on both gates."""
    routes = routed(spark, sf_dir)
    gate = routes.select("case_id", F.round(maths.gate_confidence(F.array_max("dots")), 6).alias("gate"))
    joined = vectors.answer(routes).select("case_id", "conf", "ok").join(gate, "case_id")
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).alias("score")) for a, c in (("score", "conf"), ("distance", "gate"))))
    return joined.select(F.col("case_id").alias("key"), "ok", F.inline(axes))


GATES = OBSERVED.split(",\n    pt AS")[0].replace("SELECT 'score' AS axis, conf AS score, ok FROM", "SELECT 'score' AS axis, case_id AS key, conf AS score, ok FROM").replace("SELECT 'distance', round", "SELECT 'distance', case_id, round") + f""",
    dr AS (SELECT axis, draw, score, sum(w)::BIGINT AS w FROM (SELECT axis, draw, score, {DRAW} AS w FROM (SELECT ob.*, draw, ('0x' || substr(md5(key::VARCHAR || ':' || draw::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ob, (SELECT unnest(range(200)) AS draw)) WHERE key % 2 = 0) GROUP BY ALL HAVING sum(w) > 0),
    rn AS (SELECT *, sum(w) OVER (PARTITION BY axis, draw ORDER BY score) AS upto, sum(w) OVER (PARTITION BY axis, draw) AS m FROM dr),
    th AS (SELECT axis, draw, score AS threshold, m::BIGINT AS m, (m - upto + w)::BIGINT AS n_pass FROM rn WHERE least(floor(m * 0.3), m - 1) < upto AND least(floor(m * 0.3), m - 1) >= upto - w)"""


@query(GATES + " SELECT axis, draw::INT AS draw, threshold, m, n_pass FROM th")
def gate_resamples(spark, sf_dir):
    """The thirtieth percentile of both gates' scores in 200 weighted resamples of the vectors of even number."""
    return stability.resampled(keyed(spark, sf_dir).where("key % 2 = 0"), 0.3)


@query(GATES + """, ds AS (SELECT axis, 200 - count(*) AS n_none, avg(threshold) AS mean, coalesce(stddev_samp(threshold), 0) AS sd, list(threshold ORDER BY threshold) AS t, count(*) FILTER (n_pass < greatest(10, floor(m * 0.05))) AS vacuous FROM th GROUP BY axis),
    ft AS (SELECT axis, list(score ORDER BY score) AS s, count(*) AS n FROM ob WHERE key % 2 = 0 GROUP BY axis), fi AS (SELECT axis, n, s[least(floor(n * 0.3), n - 1)::INT + 1] AS threshold FROM ft),
    pt AS (SELECT axis, place, round(threshold + off, 9) AS t FROM fi, (SELECT unnest([-1, 0, 1]) AS place, unnest([-0.02, 0, 0.02])::DOUBLE AS off)),
    cv AS (SELECT axis, place, avg(ok) FILTER (score >= t) AS acc, avg((score >= t)::INT) AS pr FROM ob JOIN pt USING (axis) WHERE key % 2 = 1 GROUP BY ALL),
    ed AS (SELECT n.axis, max((n.pr > 0 AND s.pr / n.pr >= 2)::INT) AS ep, max((n.acc > 0 AND s.acc / n.acc >= 2)::INT) AS ea FROM cv n JOIN cv s ON s.axis = n.axis AND s.place = 0 WHERE n.place <> 0 GROUP BY n.axis),
    jn AS (SELECT *, CASE WHEN ep = 1 THEN 'pass_rate' WHEN ea = 1 THEN 'accuracy' ELSE 'none' END AS edge FROM fi JOIN ds USING (axis) JOIN ed USING (axis))
    SELECT axis, n, threshold, n_none, round(mean, 6) AS mean, round(sd, 6) AS sd, t[least(floor(len(t) * 0.05), len(t) - 1)::INT + 1] AS p05, t[least(floor(len(t) * 0.95), len(t) - 1)::INT + 1] AS p95, t[1] AS least, t[len(t)] AS most, vacuous, edge,
    (sd <= 0.05 AND vacuous = 0 AND edge = 'none')::INT AS stable FROM jn""")
def gate_stability(spark, sf_dir):
    """The verdict on both gates: fitted on the vectors of even number, the curve from the others."""
    rows = Workspace(spark, "gate_stability").save(keyed(spark, sf_dir), "rows")
    return r6(stability.cells(rows.where("key % 2 = 0"), rows.where("key % 2 = 1"), 0.3))


LADDERS = {"half": [0.0, 0.5, 1.0, 2.0], "head": [0.0, 0.25, 0.5, 1.0], "whole": [0.0, 0.5, 1.0]}
START = {"half": 1.0, "head": 0.0, "whole": 0.0}
# every point's accuracy, then the walk: a step is a coordinate, 2 passes of 3
SEARCH = HEADS + "," + lane_sql("a", 64) + "," + lane_sql("b", 32) + f""", tm AS (SELECT lg.case_id, lg.gold, lg.opt, pr_b.p AS half, 1 / (1 + exp(-logit)) - 0.5 AS head, pr_a.p AS whole FROM lg JOIN pr_b ON pr_b.case_id = lg.case_id AND pr_b.opt = lg.opt JOIN pr_a ON pr_a.case_id = lg.case_id AND pr_a.opt = lg.opt),
    gd AS (SELECT a AS w_half, b AS w_head, c AS w_whole FROM (SELECT unnest({LADDERS["half"]})::DOUBLE AS a), (SELECT unnest({LADDERS["head"]})::DOUBLE AS b), (SELECT unnest({LADDERS["whole"]})::DOUBLE AS c)),
    ac AS (SELECT w_half, w_head, w_whole, avg((pick = gold)::INT) AS acc FROM (SELECT w_half, w_head, w_whole, case_id, any_value(gold) AS gold, first(opt ORDER BY round(w_half * half + w_head * head + w_whole * whole, 9) DESC, opt) AS pick FROM tm, gd GROUP BY ALL) GROUP BY ALL),
    wk AS (SELECT 0 AS step, w_half, w_head, w_whole, acc FROM ac WHERE w_half = 1 AND w_head = 0 AND w_whole = 0 UNION ALL
        SELECT step, w_half, w_head, w_whole, acc FROM (SELECT w.step + 1 AS step, t.w_half, t.w_head, t.w_whole, t.acc, row_number() OVER (ORDER BY round(t.acc - w.acc - 0.01, 9) >= 0 DESC, CASE WHEN round(t.acc - w.acc - 0.01, 9) >= 0 THEN -t.acc ELSE 0 END,
                (t.w_half = w.w_half AND t.w_head = w.w_head AND t.w_whole = w.w_whole) DESC, t.w_half, t.w_head, t.w_whole) AS r
            FROM wk w JOIN ac t ON (w.step % 3 = 0 OR t.w_half = w.w_half) AND (w.step % 3 = 1 OR t.w_head = w.w_head) AND (w.step % 3 = 2 OR t.w_whole = w.w_whole) WHERE w.step < 6) WHERE r = 1)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blended terms of every option, written once: both lanes' probabilities and the heads' deviation from neutral."""
    lane = lambda dims, name: items(spark, sf_dir, dims).select("case_id", F.inline(F.arrays_zip("labels", "probs"))).select("case_id", F.col("labels").alias("opt"), F.col("probs").alias(name))
    rows = head_rows(spark, sf_dir).withColumn("head", maths.sigmoid(F.col("logit")) - 0.5).drop("logit")
    return Workspace(spark, "terms").save(rows.join(lane(32, "half"), ["case_id", "opt"]).join(lane(64, "whole"), ["case_id", "opt"]), "terms")


@query(SEARCH + " SELECT 'half' AS term, w_half AS weight, round(acc, 6) AS accuracy FROM wk WHERE step = 6 UNION ALL SELECT 'head', w_head, round(acc, 6) FROM wk WHERE step = 6 UNION ALL SELECT 'whole', w_whole, round(acc, 6) FROM wk WHERE step = 6")
def posture_descent(spark, sf_dir):
    """The posture that coordinate descent ends in, a row a term, with its accuracy."""
    walk = descent.descend(terms(spark, sf_dir), START, LADDERS)
    return r6(spark.createDataFrame([(name, weight, walk.accuracy) for name, weight in sorted(walk.point.items())], "term string, weight double, accuracy double"))


@query(SEARCH + """, ld AS (SELECT w_whole AS weight, acc FROM ac WHERE w_half = 1 AND w_head = 0), b0 AS (SELECT acc AS base FROM ld WHERE weight = 0), bt AS (SELECT weight FROM ld, b0 WHERE round(acc - base - 0.05, 9) >= 0 AND weight > 0 ORDER BY acc DESC, weight LIMIT 1)
    SELECT weight, round(acc, 6) AS accuracy, (weight = coalesce((SELECT weight FROM bt), 0))::INT AS selected FROM ld""")
def scale_selection(spark, sf_dir):
    """The ladder of one term's weight under the promotion bar of five points."""
    picked, found = descent.select(terms(spark, sf_dir), START, "whole", LADDERS["whole"])
    return r6(spark.createDataFrame([(w, a, int(w == picked)) for w, a in found], "weight double, accuracy double, selected int"))


DECOYS = [0, 2, 4, 6]
# own options: the gold label and three further on; decoys: the other labels. Up to 8 options shown count as routed
NULLS = A + f""", cs AS (SELECT DISTINCT case_id, gold FROM dots_a), op AS (SELECT case_id, i, (gold + CASE WHEN i < 4 THEN 3 * i ELSE [1, 2, 4, 5, 7, 8][i - 3] END) % 10 AS opt FROM cs, (SELECT unnest(range(10)) AS i)),
    ar AS (SELECT k, o.case_id, i, d.dot FROM op o JOIN dots_a d ON d.case_id = o.case_id AND d.opt = o.opt, (SELECT unnest({DECOYS}) AS k) WHERE i < 4 + k),
    ap AS (SELECT *, round(s / sum(s) OVER (PARTITION BY case_id, k), 6) AS p FROM (SELECT *, 1 / (1 + exp(-8 * (dot - 0.35))) AS s FROM ar)),
    an AS (SELECT case_id, k, count(*) AS n, list(p ORDER BY i) AS probs, first(i ORDER BY p DESC, i) AS pick, max(p) AS conf, round(1 - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)), 6) AS inv FROM ap GROUP BY ALL),
    yes AS (SELECT case_id, round(1 / (1 + exp(-8 * (max(dot) - 0.35))), 6) AS p_yes FROM dots_a GROUP BY case_id),
    f0 AS (SELECT case_id, list(i ORDER BY p DESC, i) AS o FROM ap WHERE k = 0 GROUP BY case_id),
    rc AS (SELECT n.case_id, n.k, n.n, n.probs[o[1] + 1] AS p_a, n.probs[o[2] + 1] AS p_b, z.probs[o[1] + 1] AS p_a0, z.probs[o[2] + 1] AS p_b0, (n.pick >= 4)::INT AS decoy_won, (n.conf < 0.2)::INT AS abstained, (z.conf < 0.2)::INT AS abstained0, n.conf AS confidence, z.conf AS confidence0, n.inv,
        CASE WHEN n.n <= 8 THEN 'routed' ELSE 'drafter-only' END AS regime, p_yes FROM an n JOIN an z ON z.case_id = n.case_id AND z.k = 0 JOIN f0 ON f0.case_id = n.case_id JOIN yes ON yes.case_id = n.case_id)"""


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the decoy ladder, answered by the routes' dots, restricted to the options shown."""
    routes = routed(spark, sf_dir).select("case_id", "gold", F.map_from_arrays("labels", "dots").alias("dots"))
    ring = lambda *steps: F.array(*((F.col("gold") + s) % 10 for s in steps))
    cases = routes.select("case_id", "dots", ring(0, 3, 6, 9).alias("options"), ring(1, 2, 4, 5, 7, 8).alias("decoys"))

    def oracle(asked: DataFrame) -> DataFrame:
        shown = F.transform("options", lambda o: maths.sigmoid(8.0 * (F.element_at("dots", o) - 0.35)))
        rows = asked.withColumn("probs", F.transform(maths.shares(shown), lambda p: F.round(p, 6))).withColumn("confidence", F.array_max("probs"))
        return rows.select(
            "case_id", "k", "options", "n_own", "probs", maths.argmax_first(F.col("probs")).alias("pick"), "confidence", (F.col("confidence") < 0.2).cast("int").alias("abstained"),
            F.when(F.size("options") <= 8, "routed").otherwise("drafter-only").alias("regime"), F.round(maths.gate_confidence(F.array_max(F.map_values("dots"))), 6).alias("p_yes"),
        )

    return Workspace(spark, "null_ladder").save(null_ladder.run(cases, DECOYS, oracle), "records")


@query(NULLS + " SELECT case_id, k, n::INT AS n_shown, p_a, p_b, decoy_won, abstained, confidence, inv AS inv_entropy, regime FROM rc")
def null_records(spark, sf_dir):
    rows = ladder(spark, sf_dir).select("case_id", "k", "n_shown", "p_a", "p_b", "decoy_won", "abstained", "confidence", "inv_entropy", "regime")
    return r6(rows)


@query(NULLS + """, md AS (SELECT k, max(CASE WHEN i = n // 2 THEN g END) AS median FROM (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM (SELECT k, round(abs(confidence - confidence0) * 100, 6) AS g FROM rc)) GROUP BY k)
    SELECT k, round(avg(abstained), 6) AS abstain_rate, round((avg(abstained) - avg(abstained0)) * 100, 6) AS d_abstain_pt, any_value(median) AS median_d_conf_pt, round(avg(decoy_won), 6) AS decoy_win_rate FROM rc JOIN md USING (k) GROUP BY k""")
def null_drift(spark, sf_dir):
    return r6(null_ladder.drift(ladder(spark, sf_dir)))


@query(NULLS + """, t AS (SELECT *, p_a0 <> p_b0 AS untied, (p_a0 - p_b0) * (p_a - p_b) < 0 AS turned, regime = first(regime) OVER (PARTITION BY case_id ORDER BY k) AS same FROM rc)
    SELECT k, count(*) FILTER (untied) AS n_untied, count(*) FILTER (untied AND turned) AS flips, round(count(*) FILTER (untied AND turned) / greatest(count(*) FILTER (untied), 1), 6) AS flip_rate, count(*) FILTER (untied AND turned AND same) AS within,
    count(*) FILTER (untied AND turned AND NOT same) AS "cross", CASE WHEN count(*) FILTER (untied AND turned AND same) > 0 THEN 'RED' ELSE 'PASS' END AS verdict FROM t GROUP BY k""")
def null_flips(spark, sf_dir):
    return r6(null_ladder.flips(ladder(spark, sf_dir)))


@query(NULLS + """, l AS (SELECT *, round(abs(confidence - confidence0) * 100, 6) AS g, row_number() OVER (ORDER BY round(abs(confidence - confidence0) * 100, 6)) - 1 AS i, count(*) OVER () AS m FROM rc WHERE k = 6), y AS (SELECT case_id, count(DISTINCT p_yes) = 1 AS same FROM rc GROUP BY case_id)
    SELECT (SELECT min(same::INT) FROM y) AS noul_identical, CASE WHEN min((confidence = confidence0)::INT) = 1 THEN 'conditional' ELSE 'joint' END AS conf_shape, max(CASE WHEN i = m // 2 THEN g END) AS median_d_conf_top_pt FROM l""")
def null_shape(spark, sf_dir):
    return r6(null_ladder.shape(ladder(spark, sf_dir)))
