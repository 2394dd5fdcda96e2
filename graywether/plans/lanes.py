"""Two lanes of answers over the test vectors: which label is a vector's? Lane A sees all dimensions, lane B half.

Queries of routing, measures, thresholds and lane comparison are registered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.operators import compare, metrics, ranking, vectors
from graywether.plans.registry import query
from graywether.sources.tables import table


def lane_sql(lane: str, dims: int) -> str:
    """CTEs ending in items_<lane> (case_id, gold, pick, conf, ok, probs) and pr_<lane> (case_id, gold, opt, dot, p)."""
    a = lane
    return f"""
    vec_{a} AS (SELECT * FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) WHERE dim < {dims}),
    nrm_{a} AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM vec_{a} GROUP BY vec_id),
    u_{a} AS (SELECT vec_id, label, dim, x / l AS x FROM vec_{a} JOIN nrm_{a} USING (vec_id)),
    mean_{a} AS (SELECT label, dim, avg(x) AS x FROM u_{a} GROUP BY label, dim),
    cn_{a} AS (SELECT label, sqrt(sum(x * x)) AS l FROM mean_{a} GROUP BY label),
    cent_{a} AS (SELECT label, dim, x / l AS x FROM mean_{a} JOIN cn_{a} USING (label)),
    dots_{a} AS (SELECT u.vec_id AS case_id, u.label AS gold, c.label AS opt, sum(u.x * c.x) AS dot FROM u_{a} u JOIN cent_{a} c USING (dim) GROUP BY u.vec_id, u.label, c.label),
    sig_{a} AS (SELECT *, 1 / (1 + exp(-8 * (dot - 0.35))) AS s FROM dots_{a}),
    pr_{a} AS (SELECT case_id, gold, opt, dot, round(s / sum(s) OVER (PARTITION BY case_id), 6) AS p FROM sig_{a}),
    items_{a} AS (SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY p DESC, opt) AS pick, max(p) AS conf,
        (first(opt ORDER BY p DESC, opt) = any_value(gold))::INT AS ok, list(p ORDER BY opt) AS probs FROM pr_{a} GROUP BY case_id)"""


A = "WITH " + lane_sql("a", 64)
AB = A + "," + lane_sql("b", 32)


def routed(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.slice("embedding", 1, dims))
    return vectors.route(rows, vectors.centroids(rows))


def items(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    return vectors.answer(routed(spark, sf_dir, dims))


def r6(df: DataFrame) -> DataFrame:
    """Doubles with six decimals."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(A + " SELECT label, dim::INT AS dim, round(x, 6) AS value FROM cent_a")
def centroid_by_label(spark, sf_dir):
    cents = vectors.centroids(table(spark, sf_dir, "embeddings"))
    return r6(cents.select("label", F.posexplode("dir").alias("dim", "value")))


@query(A + ", r AS (SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY round(dot, 9) DESC, opt) AS pick FROM dots_a GROUP BY case_id) SELECT case_id, gold, pick, (gold = pick)::INT AS ok FROM r")
def nearest_domain(spark, sf_dir):
    return routed(spark, sf_dir).select("case_id", "gold", "pick", (F.col("gold") == F.col("pick")).cast("int").alias("ok"))


@query(A + " SELECT case_id, opt AS label, round(dot, 6) AS dot FROM dots_a")
def route_scores(spark, sf_dir):
    long = routed(spark, sf_dir).select("case_id", F.inline(F.arrays_zip("labels", "dots")))
    return r6(long.select("case_id", F.col("labels").alias("label"), F.col("dots").alias("dot")))


@query(A + """, h AS (SELECT case_id, max(p) AS m, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) AS h, count(*) AS k FROM pr_a GROUP BY case_id)
    SELECT case_id, round(CASE WHEN k <= 8 THEN 1 - h ELSE m END, 6) AS dispatch, round(m, 6) AS max_prob, round(1 - h, 6) AS inv_entropy FROM h""")
def route_probs_confidence(spark, sf_dir):
    return vectors.confidences(items(spark, sf_dir))


@query(A + """, r AS (SELECT case_id, first(opt ORDER BY round(dot, 9) DESC, opt) AS pick FROM dots_a GROUP BY case_id),
    s AS (SELECT r.case_id, r.pick, v.vec_id, sum(q.x * v.x) AS c FROM r JOIN u_a q ON q.vec_id = r.case_id JOIN u_a v ON v.label = r.pick AND v.dim = q.dim AND v.vec_id <> r.case_id GROUP BY r.case_id, r.pick, v.vec_id),
    m AS (SELECT case_id, pick, max(c) AS m FROM s GROUP BY case_id, pick)
    SELECT case_id, pick, round(m, 6) AS max_sim, round(1 / (1 + exp(-8 * (round(m, 6) - 0.35))), 6) AS gate FROM m""")
def max_similarity_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.max_similarity(vectors.route(rows, vectors.centroids(rows)), rows)
    return found.select("case_id", "pick", "max_sim", F.round(maths.gate_confidence(F.col("max_sim")), 6).alias("gate"))


@query(A + """, c AS (SELECT gold, pick, count(*) AS n FROM items_a WHERE ok = 0 GROUP BY gold, pick)
    SELECT gold, pick, n, round(n / sum(n) OVER (), 6) AS share FROM c ORDER BY n DESC, gold, pick LIMIT 10""")
def route_confusion_topk(spark, sf_dir):
    return r6(metrics.confusion(items(spark, sf_dir), 10))


@query(A + """, c AS (SELECT least(gold, pick) AS a, greatest(gold, pick) AS b, count(*) AS n FROM items_a WHERE ok = 0 GROUP BY 1, 2)
    SELECT a, b, n FROM c WHERE n >= 8 ORDER BY n DESC, a, b LIMIT 4""")
def confusable_pairs(spark, sf_dir):
    return compare.confusable_pairs(items(spark, sf_dir), least=8, k=4)


BINS_SQL = A + """, b AS (SELECT least(14, ceil(conf * 15)::INT - 1) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(ok) AS acc FROM items_a WHERE conf > 0 AND conf <= 1 GROUP BY 1)"""


@query(BINS_SQL + " SELECT bin::INT AS bin, n, round(mean_conf, 6) AS mean_conf, round(acc, 6) AS acc FROM b")
def ece15_bins(spark, sf_dir):
    return r6(metrics.bins(items(spark, sf_dir)))


@query(BINS_SQL + " SELECT round(sum(n * abs(mean_conf - acc)) / sum(n), 6) AS ece FROM b")
def ece15(spark, sf_dir):
    return r6(metrics.ece(items(spark, sf_dir)))


@query(BINS_SQL + """, t AS (SELECT sum(n) AS t, sum(n * acc) / sum(n) AS base FROM b)
    SELECT round(sum(n / t * (mean_conf - acc) ** 2), 6) AS reliability, round(sum(n / t * (acc - base) ** 2), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM b, t""")
def brier_decomposition(spark, sf_dir):
    return r6(metrics.brier_parts(items(spark, sf_dir)))


RANK_SQL = """r AS (SELECT y, {by} rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by} score) - 1) / 2.0 AS r FROM s)"""


@query(A + ", s AS (SELECT conf AS score, ok AS y FROM items_a), " + RANK_SQL.format(by="", part="") + """
    SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6)::DOUBLE AS auroc FROM r""")
def auroc_midrank(spark, sf_dir):
    return r6(metrics.auroc(items(spark, sf_dir).select(F.col("conf").alias("score"), F.col("ok").alias("y"))))


@query(A + ", s AS (SELECT opt, p AS score, (gold = opt)::INT AS y FROM pr_a), " + RANK_SQL.format(by="opt,", part="PARTITION BY opt") + """,
    o AS (SELECT opt, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auroc FROM r GROUP BY opt HAVING sum(y) >= 10 AND sum(1 - y) >= 10)
    SELECT round(avg(auroc), 6)::DOUBLE AS macro_auroc, count(*) AS n_classes FROM o""")
def ovr_auroc_macro(spark, sf_dir):
    return r6(compare.ovr_auroc(items(spark, sf_dir), least=10))


@query(A + """, c AS (SELECT gold AS c, 0 AS fp, 1 - ok AS fn, ok AS tp FROM items_a UNION ALL SELECT pick, 1 - ok, 0, 0 FROM items_a)
    SELECT round(avg(f), 6) AS macro_f1 FROM (SELECT 2.0 * sum(tp) / greatest(1, 2 * sum(tp) + sum(fp) + sum(fn)) AS f FROM c GROUP BY c)""")
def macro_f1(spark, sf_dir):
    return r6(metrics.macro_f1(items(spark, sf_dir)))


CURVE_SQL = A + """, curve AS (SELECT case_id, row_number() OVER w AS rank, row_number() OVER w / count(*) OVER () AS coverage, sum(ok) OVER w / row_number() OVER w AS acc
    FROM items_a WINDOW w AS (ORDER BY conf DESC, case_id ROWS UNBOUNDED PRECEDING))"""


@query(CURVE_SQL + " SELECT case_id, rank, round(coverage, 6) AS coverage, round(acc, 6) AS acc FROM curve")
def risk_coverage_curve(spark, sf_dir):
    return r6(metrics.risk_coverage(items(spark, sf_dir)))


@query(CURVE_SQL + " SELECT round(1 - avg(acc), 6) AS aurc FROM curve")
def risk_coverage_auc(spark, sf_dir):
    return r6(metrics.risk_coverage(items(spark, sf_dir)).agg((1 - F.avg("acc")).alias("aurc")))


@query(CURVE_SQL + """ SELECT s.share::DOUBLE AS share, round(acc, 6) AS acc FROM curve JOIN (SELECT share, greatest(1, floor(share * (SELECT max(rank) FROM curve))) AS rank FROM (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) v(share)) s USING (rank)""")
def acc_at_coverage(spark, sf_dir):
    return r6(metrics.accuracy_at(items(spark, sf_dir), 0.5, 0.8))


@query(A + """ SELECT count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(conf), 6) AS mean_conf, round(avg((conf - ok) ** 2), 6) AS brier,
    round(avg(CASE WHEN ok = 1 THEN -ln(greatest(1e-12, least(1 - 1e-12, conf))) ELSE -ln(1 - greatest(1e-12, least(1 - 1e-12, conf))) END), 6) AS nll FROM items_a""")
def hard_metrics(spark, sf_dir):
    return r6(metrics.hard_metrics(items(spark, sf_dir)))


@query(A + """, c AS (SELECT conf AS score FROM items_a WHERE case_id % 2 = 0), t AS (SELECT case_id, conf AS score FROM items_a WHERE case_id % 2 = 1)
    SELECT case_id, round((1 + (SELECT count(*) FROM c WHERE c.score <= t.score)) / ((SELECT count(*) FROM c) + 1.0), 6)::DOUBLE AS floor FROM t""")
def conformal_floor(spark, sf_dir):
    both = items(spark, sf_dir).select("case_id", F.col("conf").alias("score"))
    even = F.col("case_id") % 2 == 0
    return r6(metrics.conformal_floor(both.where(even).select("score"), both.where(~even)))


@query(A + """, o AS (SELECT conf, row_number() OVER (ORDER BY conf, case_id) - 1 AS i, count(*) OVER () AS n FROM items_a),
    q AS (SELECT v.q FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(q))
    SELECT q.q AS rate, o.conf AS threshold FROM o JOIN q ON o.i = least(floor(o.n * q.q)::BIGINT, o.n - 1)""")
def threshold_percentile(spark, sf_dir):
    return ranking.percentiles(items(spark, sf_dir).select(F.col("conf").alias("x"), "case_id"), [0.05, 0.1, 0.5, 0.9])


TARGET_SQL = A + """, g AS (SELECT conf AS t, count(*) AS n, sum(ok) AS k FROM items_a GROUP BY conf),
    s AS (SELECT t, sum(n) OVER w AS n, sum(k) OVER w AS k FROM g WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT t, n::BIGINT AS support, k / n AS acc FROM s)"""


@query(TARGET_SQL + """ SELECT threshold, support, round(acc, 6) AS accuracy, met FROM (
    (SELECT t AS threshold, support, acc, true AS met, 0 AS o FROM a WHERE acc >= 0.5 ORDER BY t LIMIT 1)
    UNION ALL (SELECT t, support, acc, false, 1 FROM a ORDER BY round(acc, 12) DESC, support DESC LIMIT 1)) ORDER BY o LIMIT 1""")
def threshold_target_accuracy(spark, sf_dir):
    return r6(ranking.target_threshold(items(spark, sf_dir), 0.5))


@query(TARGET_SQL + " SELECT t AS threshold, support, round(acc, 6) AS accuracy, round(support / (SELECT count(*) FROM items_a), 6) AS pass_rate FROM a")
def threshold_curve_points(spark, sf_dir):
    return r6(ranking.curve_points(items(spark, sf_dir)))


OBSERVED = A + """, ob AS (SELECT 'score' AS axis, conf AS score, ok FROM items_a UNION ALL
        SELECT 'distance', round(1 / (1 + exp(-8 * (d - 0.35))), 6), ok FROM items_a JOIN (SELECT case_id, max(dot) AS d FROM dots_a GROUP BY case_id) USING (case_id)),
    pt AS (SELECT axis, score, sum(count(*)) OVER w AS np, sum(sum(ok)) OVER w / sum(count(*)) OVER w AS acc, sum(count(*)) OVER (PARTITION BY axis) AS n FROM ob GROUP BY axis, score WINDOW w AS (PARTITION BY axis ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ch AS ({0}) SELECT axis, score AS threshold, status, round(acc, 6) AS accuracy, n::BIGINT AS n, np::BIGINT AS n_pass, (n - np)::BIGINT AS n_abstain FROM ch"""
BY_RATE = """SELECT *, 'fitted' AS status FROM pt WHERE (axis, score) IN (SELECT (axis, score) FROM (SELECT axis, score, row_number() OVER (PARTITION BY axis ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY axis) AS m FROM ob)
        WHERE i = least(floor(m * 0.3), m - 1))"""
BY_TARGET = """SELECT * FROM (SELECT *, CASE WHEN acc >= {0} THEN 'fitted' ELSE 'target_unmet' END AS status, row_number() OVER (PARTITION BY axis ORDER BY acc >= {0} DESC, CASE WHEN acc >= {0} THEN score END, round(acc, 12) DESC, score) AS r FROM pt) WHERE r = 1"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axis, score, ok: each answer's confidence, and its gate confidence from the nearest domain."""
    rows = vectors.answer(routed(spark, sf_dir)).select("case_id", "conf", "ok")
    gate = routed(spark, sf_dir).select("case_id", F.round(maths.gate_confidence(F.array_max("dots")), 6).alias("gate"))
    joined = rows.join(gate, "case_id")
    return joined.select("ok", F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).alias("score")) for a, c in (("score", "conf"), ("distance", "gate"))))))


@query(OBSERVED.replace("{0}", BY_RATE))
def fused_gate_percentile(spark, sf_dir):
    """Both axes' cutoffs at the thirtieth percentile of their scores."""
    return r6(ranking.recommend(observations(spark, sf_dir), rho=0.3))


@query(OBSERVED.replace("{0}", BY_TARGET.format(0.5)))
def fused_gate_target(spark, sf_dir):
    """Both axes' lowest cutoffs that keep half of the answers right."""
    return r6(ranking.recommend(observations(spark, sf_dir), target=0.5))


@query(OBSERVED.replace("{0}", BY_TARGET.format(0.999)))
def fused_gate_unmet(spark, sf_dir):
    """Both axes' best cutoffs under a target that may be out of reach."""
    return r6(ranking.recommend(observations(spark, sf_dir), target=0.999))


CAUSES_SQL = A + """, r AS (SELECT case_id, max(dot) AS d FROM dots_a GROUP BY case_id),
    f AS (SELECT i.*, CASE WHEN conf < 0.15 THEN 'score_gate' WHEN round(1 / (1 + exp(-8 * (d - 0.35))), 6) < 0.35 THEN 'distance_gate' ELSE 'answered' END AS cause FROM items_a i JOIN r USING (case_id))"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routed(spark, sf_dir)
    sims = rows.select("case_id", F.round(maths.gate_confidence(F.array_max("dots")), 6).alias("gate"))
    return ranking.abstain(vectors.answer(rows).join(sims, "case_id"), score_at=0.15, gate_at=0.35)


@query(CAUSES_SQL + " SELECT cause, count(*) AS n FROM f GROUP BY cause")
def abstain_causes(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("cause").agg(F.count("*").alias("n"))


@query(CAUSES_SQL + " SELECT round(avg((cause <> 'answered')::INT), 6) AS abstain_rate, round(avg(CASE WHEN cause = 'answered' THEN ok END), 6) AS answered_accuracy, count(*) AS n FROM f")
def selective_metrics(spark, sf_dir):
    return r6(ranking.selective(gated(spark, sf_dir)))


@query(A + """, l AS (SELECT gold, count(*) AS n, sum(ok) AS k FROM items_a GROUP BY gold), w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM l)
    SELECT gold, n, k::BIGINT AS k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6)::DOUBLE AS low,
    round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6)::DOUBLE AS high FROM w""")
def wilson_by_label(spark, sf_dir):
    per = items(spark, sf_dir).groupBy("gold").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("k"))
    low, high = maths.wilson(F.col("k"), F.col("n").cast("double"))
    return r6(per.select("gold", "n", "k", low.alias("low"), high.alias("high")))


@query(A + """, l AS (SELECT count(*) / sum(count(*)) OVER () AS s FROM items_a GROUP BY gold) SELECT round(1 + var_pop(s) / (avg(s) * avg(s)), 6) AS deff, round(max(s), 6) AS majority FROM l""")
def kish_and_majority(spark, sf_dir):
    return r6(compare.strata(items(spark, sf_dir), "gold"))


@query(A + """, j AS (SELECT gold AS a, pick AS b, count(*) AS n FROM items_a GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j),
    x AS (SELECT n / t AS p, n * t / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b)) AS q FROM j, t),
    g AS (SELECT sum(n) / any_value(t) AS p FROM j, t GROUP BY a)
    SELECT round((SELECT sum(p * log2(q)) FROM x), 6) AS mi, round((SELECT sum(-p * log2(p)) FROM g), 6) AS h""")
def mutual_information(spark, sf_dir):
    return r6(metrics.mutual_information(items(spark, sf_dir), "gold", "pick"))


@query(A + """, h AS (SELECT sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) AS h FROM pr_a GROUP BY case_id)
    SELECT b.b::INT AS bin, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER () + 10.0), 6)::DOUBLE AS share FROM (SELECT unnest(range(10)) AS b) b LEFT JOIN (SELECT least(9, floor(h * 10)) AS b, count(*) AS n FROM h GROUP BY 1) c ON b.b = c.b""")
def entropy_histogram(spark, sf_dir):
    h = items(spark, sf_dir).select(maths.normalised_entropy(F.col("probs")).alias("x"))
    return r6(ranking.histogram(h, 10, smooth=1.0))


PAIR_SQL = AB + """, pair AS (SELECT a.case_id, a.gold, a.pick AS pick_a, b.pick AS pick_b, a.conf AS conf_a, b.conf AS conf_b, a.ok AS ok_a, b.ok AS ok_b FROM items_a a JOIN items_b b USING (case_id))"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pair_items(items(spark, sf_dir, 64), items(spark, sf_dir, 32))


@query(PAIR_SQL + " SELECT * FROM pair")
def item_pairing(spark, sf_dir):
    return paired(spark, sf_dir)


@query(PAIR_SQL + """ SELECT sum((ok_b > ok_a)::INT)::BIGINT AS gained, sum((ok_b < ok_a)::INT)::BIGINT AS lost, sum((ok_a = ok_b)::INT)::BIGINT AS ties, count(*) AS n FROM pair""")
def lane_flip_counts(spark, sf_dir):
    return compare.flips(paired(spark, sf_dir))


@query(PAIR_SQL + """, d AS (SELECT ok_a - ok_b AS d FROM pair) SELECT round(avg(d), 6) AS mean, round(1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS half, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS lb95, count(*) AS n FROM d""")
def lane_paired_delta_ci(spark, sf_dir):
    return r6(compare.mean_ci(paired(spark, sf_dir).select((F.col("ok_a") - F.col("ok_b")).alias("d")), "d"))


@query(PAIR_SQL + """, m AS (SELECT avg(ok_a) AS a, avg(ok_b) AS b, count(*) AS n FROM pair)
    SELECT round(a - b, 6) AS delta, round(a - b - 1.644934 * sqrt(a * (1 - a) / n + b * (1 - b) / n), 6) AS lcb95 FROM m""")
def lane_probe_delta(spark, sf_dir):
    return r6(compare.unpaired_delta(paired(spark, sf_dir)))


@query()
def lane_mcnemar(spark, sf_dir):
    return compare.mcnemar(paired(spark, sf_dir))


@query(PAIR_SQL + """ SELECT case_id, gold, CASE WHEN conf_a >= 0.15 THEN pick_a ELSE pick_b END AS pick, CASE WHEN conf_a >= 0.15 THEN 'a' ELSE 'b' END AS lane,
    CASE WHEN conf_a >= 0.15 THEN ok_a ELSE ok_b END AS ok FROM pair""")
def cascade_compose(spark, sf_dir):
    return compare.cascade(items(spark, sf_dir, 64), items(spark, sf_dir, 32), at=0.15)


@query(AB + """, l AS (SELECT a.case_id, a.gold, a.opt, round((ln(greatest(a.p, 1e-6)) + ln(greatest(b.p, 1e-6))) / 2, 9) AS s FROM pr_a a JOIN pr_b b ON a.case_id = b.case_id AND a.opt = b.opt)
    SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY s DESC, opt) AS pick FROM l GROUP BY case_id""")
def logit_mean_fusion(spark, sf_dir):
    return compare.fuse_logs(items(spark, sf_dir, 64), items(spark, sf_dir, 32))


@query(AB + """, ra AS (SELECT case_id, gold, opt, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, opt) AS r FROM pr_a), rb AS (SELECT case_id, opt, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, opt) AS r FROM pr_b)
    SELECT ra.case_id, any_value(gold) AS gold, first(ra.opt ORDER BY ra.r + rb.r, ra.opt) AS pick FROM ra JOIN rb ON ra.case_id = rb.case_id AND ra.opt = rb.opt GROUP BY ra.case_id""")
def rank_fusion(spark, sf_dir):
    return compare.fuse_ranks(items(spark, sf_dir, 64), items(spark, sf_dir, 32))


@query(AB + """, acc AS (SELECT 1 / (1 + exp(-((SELECT avg(ok) FROM items_a) - (SELECT avg(ok) FROM items_b)) / 0.01)) AS g),
    q AS (SELECT a.case_id, a.gold, a.opt, round(g * a.p + (1 - g) * b.p, 9) AS q FROM pr_a a JOIN pr_b b ON a.case_id = b.case_id AND a.opt = b.opt, acc)
    SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY q DESC, opt) AS pick, max(q) AS conf FROM q GROUP BY case_id""")
def sigmoid_teacher_gate(spark, sf_dir):
    return compare.teacher_gate(items(spark, sf_dir, 64), items(spark, sf_dir, 32))


@query(AB + """, q AS (SELECT a.case_id, a.gold, a.opt, round(0.75 * a.p + 0.25 * b.p, 9) AS q FROM pr_a a JOIN pr_b b ON a.case_id = b.case_id AND a.opt = b.opt)
    SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY q DESC, opt) AS pick, max(q) AS conf FROM q GROUP BY case_id""")
def blend_pick(spark, sf_dir):
    return compare.blend(items(spark, sf_dir, 64), items(spark, sf_dir, 32), weight=0.75)


@query(A + """ SELECT case_id, list_transform(probs, lambda p: round(greatest(p, 0) * 1e6) / 1e6) AS wire, round(list_sum(probs), 6) AS mass FROM items_a""")
def wire_distribution(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.select("case_id", F.transform("probs", maths.wire).alias("wire"), F.round(maths.total(F.col("probs")), 6).alias("mass"))


@query(A + """, soft AS (SELECT case_id, opt, p, CASE WHEN opt = gold THEN 0.9::DOUBLE ELSE 0.1::DOUBLE / 9 END AS q, opt = gold AS g FROM pr_a),
    c AS (SELECT case_id, sum(CASE WHEN g THEN p END) AS soft_acc, sum((p - q) ** 2) AS soft_brier, sum(abs(p - q)) / 2 AS tv, sum(q * ln(q / greatest(p, 1e-12))) AS kl FROM soft GROUP BY case_id)
    SELECT round(avg(soft_acc), 6) AS soft_acc, round(avg(soft_brier), 6) AS soft_brier, round(avg(tv), 6) AS tv, round(avg(kl), 6) AS kl FROM c""")
def soft_metrics(spark, sf_dir):
    return r6(compare.soft_metrics(items(spark, sf_dir), weight=0.9))


@query(A + """, e AS (SELECT case_id, any_value(gold) AS gold, any_value(gold) AS g, sum(opt * p) / sum(p) AS level FROM pr_a GROUP BY case_id)
    SELECT round(avg(level), 6) AS mean_level, round(avg(abs(level - gold)), 6) AS mae, round(avg((abs(level - gold) <= 1)::INT), 6) AS within_1 FROM e""")
def score_metrics(spark, sf_dir):
    return r6(compare.score_metrics(items(spark, sf_dir)))
