"""Queries of fitted readouts: ridge, label heads, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions import maths
from graywether.operators import density, heads, kernels, ranking, ridge
from graywether.plans.lanes import items, lane_sql, r6
from graywether.plans.registry import query
from graywether.plans.texts import FOLDS, HASHES, counted
from graywether.sources.steps import Workspace
from graywether.sources.tables import table

FEW = 48

# the systems of all folds and labels are solved side by side, one pivot a step
RIDGE = f"WITH RECURSIVE {HASHES}" + f""",
    st AS (SELECT doc_id, tok, coalesce(tok <> lag(tok) OVER (PARTITION BY doc_id ORDER BY pos, is_bigram), true) AS fresh FROM (SELECT doc_id, pos, is_bigram, (h % 131072)::INT AS tok FROM ev)),
    cell AS (SELECT doc_id, tok, count(*) AS times, sum(fresh::INT) AS runs FROM st GROUP BY ALL),
    d AS (SELECT doc_id, lang AS label, coalesce(doc_id % {FOLDS}, 0)::INT AS fold FROM documents), folds AS (SELECT DISTINCT fold FROM d), labels AS (SELECT DISTINCT label FROM d),
    feat AS (SELECT tok, row_number() OVER (ORDER BY tok) AS i FROM (SELECT tok FROM cell GROUP BY tok ORDER BY count(*) DESC, tok LIMIT {FEW})), k AS (SELECT count(*) AS k FROM feat),
    x AS (SELECT doc_id, i, times, runs, label, fold FROM cell JOIN feat USING (tok) JOIN d USING (doc_id)),
    xb AS (SELECT doc_id, i, fold FROM x UNION ALL SELECT doc_id, k + 1, fold FROM d, k),
    g AS (SELECT f.fold, a.i, b.i AS j, count(*) AS n FROM xb a JOIN xb b USING (doc_id) JOIN folds f ON f.fold <> a.fold GROUP BY ALL),
    cl AS (SELECT f.fold, label, count(*) FILTER (d.fold <> f.fold) AS n_class FROM d, folds f GROUP BY ALL), nr AS (SELECT fold, sum(n_class) AS n_rows FROM cl GROUP BY fold),
    ct AS (SELECT f.fold, label, i, sum(times) AS n_in, count(*) AS df FROM x JOIN folds f ON f.fold <> x.fold GROUP BY ALL), al AS (SELECT fold, i, sum(n_in) AS n_all FROM ct GROUP BY ALL),
    r AS (SELECT c.fold, c.label, f.i, ln((coalesce(n_in, 0) + 1) / 131072::DOUBLE) - ln((coalesce(n_all, 0) - coalesce(n_in, 0) + 1) / (n_rows + 131072)::DOUBLE) AS r, coalesce(df, 0)::DOUBLE AS y
        FROM cl c JOIN nr USING (fold) CROSS JOIN feat f LEFT JOIN ct ON ct.fold = c.fold AND ct.label = c.label AND ct.i = f.i LEFT JOIN al ON al.fold = c.fold AND al.i = f.i
        UNION ALL SELECT fold, label, k + 1, 1.0, n_class FROM cl, k),
    sys AS (SELECT a.fold, a.label, a.i, list(coalesce(n, 0) * a.r * b.r + CASE WHEN a.i = b.i THEN {ridge.LAMBDA} ELSE 0 END ORDER BY b.i) || [a.r * any_value(a.y)] AS line
        FROM r a JOIN r b ON a.fold = b.fold AND a.label = b.label LEFT JOIN g ON g.fold = a.fold AND g.i = a.i AND g.j = b.i GROUP BY a.fold, a.label, a.i, a.r),
    gj AS (SELECT 1::BIGINT AS step, fold, label, i, line FROM sys UNION ALL
        SELECT step + 1, fold, label, i, CASE WHEN i = step THEN list_transform(line, lambda v: v / piv[step])
            ELSE list_transform(list_zip(line, piv), lambda z: z[1] - z[2] * line[step] / piv[step]) END
        FROM (SELECT *, any_value(line) FILTER (i = step) OVER (PARTITION BY fold, label) AS piv FROM gj) WHERE step <= (SELECT k + 1 FROM k)),
    w AS (SELECT g.fold, g.label, g.i, line[-1] * r.r AS v FROM gj g JOIN r ON r.fold = g.fold AND r.label = g.label AND r.i = g.i WHERE step = (SELECT k + 2 FROM k)),
    score AS (SELECT d.doc_id, w.label, sum(w.v * CASE WHEN w.i = (SELECT k + 1 FROM k) THEN 1 ELSE coalesce(x.runs, 0) END) AS score
        FROM d JOIN w USING (fold) LEFT JOIN x ON x.doc_id = d.doc_id AND x.i = w.i GROUP BY ALL)"""


@query(RIDGE + " SELECT doc_id, label AS lang, round(score, 6) AS score FROM score")
def ridge_scores(spark, sf_dir):
    """Every document's score for every language, by weights of the folds it isn't in, over the 48 most common buckets."""
    rows = counted(spark, sf_dir)
    scored = ridge.scores(rows, ridge.fit(rows, FEW), ["doc_id"])
    return r6(scored.select("doc_id", F.col("label").alias("lang"), "score"))


@query(RIDGE + """, t AS (SELECT greatest(avg(s), 1e-6) AS temp FROM (SELECT max(score) - min(score) AS s FROM score GROUP BY doc_id)),
    m AS (SELECT a.doc_id, a.label, a.score - (SELECT max(b.score) FROM score b WHERE b.doc_id = a.doc_id AND b.label <> a.label) AS m FROM score a)
    SELECT doc_id, label AS lang, round(1 / (1 + exp(-m / temp)), 6) AS term FROM m, t""")
def ridge_blend_terms(spark, sf_dir):
    """The blend term of each language: the margin over the best other, at the rows' mean spread as temperature."""
    rows = counted(spark, sf_dir)
    scored = Workspace(spark, "ridge_terms").save(ridge.scores(rows, ridge.fit(rows, FEW), ["doc_id"]), "scores")
    terms = ridge.blend_terms(scored, "doc_id", ridge.temperature(scored, "doc_id"))
    return r6(terms.select("doc_id", F.col("label").alias("lang"), "term"))


@query()
def ridge_picks(spark, sf_dir):
    """doc_id, gold, pick, ok by the full readout of 2,048 buckets; tests/test_fits.py holds its weights against NumPy."""
    rows = counted(spark, sf_dir)
    scored = ridge.scores(rows, ridge.fit(rows), ["doc_id", "fold"]).withColumn("score", F.round("score", 9))
    best = F.max_by("label", F.struct("score", F.col("label"))).alias("pick")
    picks = scored.groupBy("doc_id").agg(best)
    gold = rows.select("doc_id", F.col("label").alias("gold"))
    joined = gold.join(picks.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    return joined.select("doc_id", "gold", "pick", (F.col("pick") == F.col("gold")).cast("int").alias("ok"))


SHARD_ROWS = 128


def vectors_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test vectors in two folds; shards are dealt by the id's other digits."""
    unit = maths.unit(F.col("embedding")).alias("vector")
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("key"), "label", (F.col("vec_id") % 2).cast("int").alias("fold"), F.floor(F.col("vec_id") / 2).alias("shard_by"), unit)


# rows of a shard are numbered by label and id; step t of the recursion is one row of every shard of both models
HEADS = f"""WITH RECURSIVE e AS (SELECT vec_id, label, (vec_id % 2)::INT AS fold, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda u: u::DOUBLE * u)))) || [1.0::DOUBLE] AS x FROM embeddings),
    sn AS (SELECT greatest(1, ceil(count(*) / {SHARD_ROWS}))::INT AS s FROM e),
    rw AS (SELECT 1 - fold AS model, (vec_id // 2 % s)::INT AS shard, label, x, row_number() OVER (PARTITION BY fold, vec_id // 2 % s ORDER BY label, vec_id) AS i FROM e, sn),
    sz AS (SELECT model, shard, count(*) AS n FROM rw GROUP BY ALL), mx AS (SELECT max(n) AS steps FROM sz),
    w AS (SELECT 0::BIGINT AS t, model, shard, n, o.label AS opt, list_transform(range(65), lambda v: 0::DOUBLE) AS w FROM sz, (SELECT DISTINCT label FROM e) o UNION ALL
        SELECT t + 1, model, shard, n, opt, CASE WHEN (t + 1) % (steps + 1) <> 0 THEN w ELSE
            list_transform(list_reduce(list(list_transform(w, lambda v: v * n)) OVER (PARTITION BY model, opt ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
                lambda a, b: list_transform(list_zip(a, b), lambda z: z[1] + z[2])), lambda v: v / (sum(n) OVER (PARTITION BY model, opt))) END
        FROM (SELECT t, model, shard, n, opt, steps, CASE WHEN label IS NULL THEN w ELSE
                list_transform(list_zip(w, x, range(65)), lambda z: z[1] * CASE WHEN z[3] = 64 THEN 1 ELSE 1 - rate * {heads.DECAY} END - rate * g * z[2]) END AS w
            FROM (SELECT w.*, steps, label, x, {heads.RATE} * (1 - ((t // (steps + 1)) * w.n + t % (steps + 1))::DOUBLE / ({heads.EPOCHS} * w.n)) AS rate,
                    1 / (1 + exp(-list_dot_product(w.w, x))) - (label = opt)::INT AS g
                FROM w CROSS JOIN mx LEFT JOIN rw ON rw.model = w.model AND rw.shard = w.shard AND rw.i = t % (steps + 1) + 1))
        WHERE t < {heads.EPOCHS} * (steps + 1)),
    fin AS (SELECT model, opt, any_value(w) AS w FROM w, mx WHERE t = {heads.EPOCHS} * (steps + 1) GROUP BY ALL),
    lg AS (SELECT vec_id AS case_id, label AS gold, opt, list_dot_product(w, x) AS logit FROM e JOIN fin ON model = fold)"""


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors_folded(spark, sf_dir)
    found = heads.logits(rows.withColumn("gold", F.col("label")), heads.fit(rows, shard_rows=SHARD_ROWS), ["key", "gold"])
    return found.select(F.col("key").alias("case_id"), "gold", F.col("label").alias("opt"), "logit")


@query(HEADS + " SELECT case_id, opt, round(logit, 6) AS logit FROM lg")
def head_logits(spark, sf_dir):
    """Every vector's raw logit of every label, by heads fitted on the other fold."""
    return r6(head_rows(spark, sf_dir).drop("gold"))


@query(HEADS + """, best AS (SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY round(logit, 9) DESC, opt) AS pick FROM lg GROUP BY case_id)
    SELECT case_id, gold, pick, (gold = pick)::INT AS ok FROM best""")
def head_picks(spark, sf_dir):
    best = F.min(F.struct((-F.round("logit", 9)).alias("o"), "opt")).alias("b")
    picks = head_rows(spark, sf_dir).groupBy("case_id", "gold").agg(best)
    return picks.select("case_id", "gold", F.col("b.opt").alias("pick"), (F.col("b.opt") == F.col("gold")).cast("int").alias("ok"))


HEAD_LADDER = [0.0, 0.25, 0.5, 1.0]


@query(HEADS + "," + lane_sql("b", 32) + f""", terms AS (SELECT lg.case_id, lg.gold, lg.opt, pr_b.p AS base, logit FROM lg JOIN pr_b ON pr_b.case_id = lg.case_id AND pr_b.opt = lg.opt),
    pk AS (SELECT scale, case_id, any_value(gold) AS gold, first(opt ORDER BY round(base + CASE WHEN scale = 0 THEN 0 ELSE 0.5 + scale * (1 / (1 + exp(-logit)) - 0.5) END, 9) DESC, opt) AS pick
        FROM terms, (SELECT unnest({HEAD_LADDER})::DOUBLE AS scale) GROUP BY ALL),
    rg AS (SELECT scale, avg((pick = gold)::INT) AS accuracy FROM pk GROUP BY scale), bs AS (SELECT accuracy AS base FROM rg WHERE scale = 0),
    tp AS (SELECT scale AS best FROM rg, bs WHERE scale > 0 AND accuracy >= base + 0.05 ORDER BY accuracy DESC, scale LIMIT 1)
    SELECT scale, round(accuracy, 6) AS accuracy, (scale = coalesce((SELECT best FROM tp), 0))::INT AS selected FROM rg""")
def head_scale_selection(spark, sf_dir):
    """The ladder of head scales over answers that see half of the dimensions."""
    routed = items(spark, sf_dir, 32).select(F.col("case_id"), F.inline(F.arrays_zip("labels", "probs"))).select("case_id", F.col("labels").alias("opt"), F.col("probs").alias("base"))
    return r6(heads.scale_ladder(head_rows(spark, sf_dir).join(routed, ["case_id", "opt"]), HEAD_LADDER))


COMPONENTS, PROJECTED, STEPS, SEED = 4, 16, 6, 7
# one recursion step is one step of every mixture: 2 folds x (labels and the pooled one, -1)
DENSITY = f"""WITH RECURSIVE sg AS (SELECT i, j, CASE WHEN (xor(x, x >> 16) * 73244475 % 4294967296 >> 15) & 1 = 1 THEN 0.25 ELSE -0.25 END AS s
        FROM (SELECT i, j, ((i * {PROJECTED} + j + {SEED}) * 2654435761 % 4294967296)::UBIGINT AS x FROM range(64) a(i), range({PROJECTED}) b(j))),
    vx AS (SELECT vec_id, label, (vec_id % 2)::INT AS fold, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
    un AS (SELECT vec_id, label, fold, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM vx),
    pj AS (SELECT vec_id, label, fold, j, sum(v * s) AS x FROM un JOIN sg USING (i) GROUP BY ALL),
    px AS (SELECT vec_id, label, fold, list(x ORDER BY j) AS x FROM pj GROUP BY ALL), pl AS (SELECT DISTINCT label FROM px),
    lg AS (SELECT vec_id, 1 - fold AS f, unnest([-1, label]) AS model, x, vec_id * 2654435761 % 4294967296 AS o FROM px),
    vr AS (SELECT 1 - fold AS f, unnest([-1, label]) AS model, j, x FROM pj), sp AS (SELECT f, model, list(v ORDER BY j) AS var FROM (SELECT f, model, j, greatest(var_pop(x), {density.VAR_FLOOR}) AS v FROM vr GROUP BY ALL) GROUP BY ALL),
    st AS (SELECT f, model, k, x AS mean FROM (SELECT *, row_number() OVER (PARTITION BY f, model ORDER BY o, vec_id) AS k FROM lg) WHERE k <= {COMPONENTS}),
    em AS (SELECT 0 AS t, f, model, k, 1.0::DOUBLE / count(*) OVER (PARTITION BY f, model) AS w, mean, var, NULL::DOUBLE AS ll FROM st JOIN sp USING (f, model) UNION ALL
        SELECT t + 1, f, model, k, c / n, CASE WHEN c >= {density.LEAST_COUNT} THEN m ELSE mean END,
            CASE WHEN c >= {density.LEAST_COUNT} THEN list_transform(list_zip(m, s2), lambda z: greatest(z[2] - z[1] * z[1], {density.VAR_FLOOR})) ELSE var END, ll
        FROM (SELECT any_value(t) AS t, f, model, k, any_value(mean) AS mean, any_value(var) AS var, any_value(c) AS c, any_value(n) AS n, any_value(ll) AS ll,
                list(sx / greatest(c, {density.LEAST_COUNT}) ORDER BY j) AS m, list(sxx / greatest(c, {density.LEAST_COUNT}) ORDER BY j) AS s2
            FROM (SELECT any_value(t) AS t, f, model, k, any_value(mean) AS mean, any_value(var) AS var, sum(r) AS c, any_value(n) AS n, any_value(ll) AS ll, j, sum(r * xj) AS sx, sum(r * xj * xj) AS sxx
                FROM (SELECT *, unnest(x) AS xj, unnest(range({PROJECTED})) AS j
                    FROM (SELECT t, f, model, k, mean, var, x, exp(lp - tot) AS r, count(*) OVER (PARTITION BY f, model, k) AS n, sum(tot) OVER (PARTITION BY f, model, k) / count(*) OVER (PARTITION BY f, model, k) AS ll
                        FROM (SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY f, model, vec_id)) AS tot
                            FROM (SELECT *, max(lp) OVER (PARTITION BY f, model, vec_id) AS top
                                FROM (SELECT em.*, vec_id, x, ln(w) - 0.5 * list_sum(list_transform(list_zip(x, mean, var), lambda z: ln(2 * pi() * z[3]) + (z[1] - z[2]) * (z[1] - z[2]) / z[3])) AS lp
                                    FROM em JOIN lg USING (f, model) WHERE t < {STEPS})))))
                GROUP BY f, model, k, j)
            GROUP BY f, model, k)),
    ff AS (SELECT f, model, k, w, mean, var FROM em WHERE t = {STEPS}),
    ld AS (SELECT vec_id, model, max(lp) + ln(sum(exp(lp - top))) AS ll
        FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id, model) AS top FROM (SELECT vec_id, model, ln(w) - 0.5 * list_sum(list_transform(list_zip(x, mean, var), lambda z: ln(2 * pi() * z[3]) + (z[1] - z[2]) * (z[1] - z[2]) / z[3])) AS lp
            FROM px JOIN ff ON f = fold)) GROUP BY vec_id, model)"""
PICKED = DENSITY + "," + lane_sql("a", 64) + """, dc AS (SELECT case_id, gold, pick, conf, ok, a.ll - b.ll AS support, 1 / (1 + exp(-(a.ll - b.ll))) AS confidence
        FROM items_a JOIN ld a ON a.vec_id = case_id AND a.model = pick JOIN ld b ON b.vec_id = case_id AND b.model = -1)"""


def gated(spark: SparkSession, sf_dir: str) -> tuple[density.Gates, DataFrame]:
    """Gates fitted on the other fold, and the answers with their density confidence."""
    rows = density.projected(vectors_folded(spark, sf_dir), ["key", "label", "fold"], 64, PROJECTED, SEED)
    gates = density.fit(rows, COMPONENTS, STEPS)
    answers = items(spark, sf_dir).select(F.col("case_id").alias("key"), "gold", "pick", "conf", "ok")
    joined = rows.select("key", "fold", "x").join(answers, "key")
    return gates, density.confidences(joined, gates, ["key", "gold", "pick", "conf", "ok"]).withColumnRenamed("key", "case_id")


@query(DENSITY + " SELECT f AS fold, model, (t - 1)::INT AS step, round(any_value(ll), 6) AS mean_loglik FROM em WHERE t > 0 GROUP BY f, model, t")
def density_loglik(spark, sf_dir):
    """Mean log-likelihood of every mixture before each of its steps; -1 is the pooled one."""
    gates, _ = gated(spark, sf_dir)
    # labels are numbers here; a row a mixture and step
    rows = [(f, -1 if m < 0 else int(gates.labels[m]), step, float(ll)) for f, m, step, ll in gates.history]
    return r6(spark.createDataFrame(rows, "fold int, model int, step int, mean_loglik double"))


@query(PICKED + " SELECT case_id, pick, round(support, 6) AS support, round(confidence, 6) AS confidence FROM dc")
def density_confidence(spark, sf_dir):
    return r6(gated(spark, sf_dir)[1].select("case_id", "pick", "support", "confidence"))


@query(PICKED + """, th AS (SELECT (SELECT t FROM (SELECT conf AS t, row_number() OVER (ORDER BY conf) - 1 AS i, count(*) OVER () AS n FROM dc) WHERE i = least(floor(n * 0.3), n - 1)) AS ts,
        (SELECT t FROM (SELECT round(confidence, 6) AS t, row_number() OVER (ORDER BY round(confidence, 6)) - 1 AS i, count(*) OVER () AS n FROM dc) WHERE i = least(floor(n * 0.3), n - 1)) AS td),
    ar AS (SELECT 'shipped' AS arm, (conf < ts)::INT AS declined, conf, ok FROM dc, th UNION ALL SELECT 'density', (round(confidence, 6) < td)::INT, conf, ok FROM dc, th
        UNION ALL SELECT 'both', (conf < ts OR round(confidence, 6) < td)::INT, conf, ok FROM dc, th),
    ab AS (SELECT arm, least(14, ceil(conf * 15)::INT - 1) AS bin, count(*) AS c, avg(conf) AS m, avg(ok) AS a FROM ar WHERE declined = 0 AND conf > 0 GROUP BY ALL),
    ec AS (SELECT arm, sum(c * abs(m - a)) / sum(c) AS answered_ece FROM ab GROUP BY arm)
    SELECT arm, count(*) AS n, round(avg(declined), 6) AS abstain_rate, sum((declined = 0)::INT)::BIGINT AS selective_n, round(coalesce(avg(ok) FILTER (declined = 0), 0), 6) AS selective_accuracy,
        round(any_value(answered_ece), 6) AS answered_ece FROM ar LEFT JOIN ec USING (arm) GROUP BY arm""")
def density_arms(spark, sf_dir):
    """The confidence gate, the density gate and both, each at the thirtieth percentile of its own observations."""
    scored = Workspace(spark, "density_arms").save(gated(spark, sf_dir)[1].withColumn("confidence", F.round("confidence", 6)), "scored")
    at = lambda c, name: ranking.percentiles(scored.select(F.col(c).alias("x")), [0.3]).select(F.col("threshold").alias(name))
    rows = scored.crossJoin(F.broadcast(at("conf", "ts"))).crossJoin(F.broadcast(at("confidence", "td")))  # one row each
    low, thin = F.col("conf") < F.col("ts"), F.coalesce(F.col("confidence") < F.col("td"), F.lit(False))
    arms = F.array(*(F.struct(F.lit(name).alias("arm"), gate.cast("int").alias("declined")) for name, gate in (("shipped", low), ("density", thin), ("both", low | thin))))
    return r6(density.arm_stats(rows.select("conf", "ok", F.inline(arms))))


# a candidate has the first half of its source and the second half of the label's next vector
KERNEL = """WITH e AS (SELECT vec_id, label, lead(vec_id) OVER w AS nx, first(vec_id) OVER w AS fs, embedding::DOUBLE[] AS v FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    c AS (SELECT e.vec_id, e.label, e.v[1:32] || o.v[33:64] AS v FROM e JOIN e o ON o.vec_id = coalesce(e.nx, e.fs)),
    u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e), cu AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM c),
    pr AS (SELECT a.vec_id, b.vec_id AS other, a.label, list_dot_product(a.u, b.u) AS cos FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id),
    tau AS (SELECT label, greatest(1 - avg(cos), 1e-6) AS tau FROM pr GROUP BY label),
    loo AS (SELECT vec_id, label, ln(sum(exp((cos - 1) / tau))) + 1 / any_value(tau) - ln(count(*)) AS loo, first(other ORDER BY round(cos, 12) DESC, other) AS near FROM pr JOIN tau USING (label) GROUP BY vec_id, label)"""


def pool(spark: SparkSession, sf_dir: str):
    return kernels.densities(table(spark, sf_dir, "embeddings"), block_rows=64)


@query(KERNEL + " SELECT vec_id, label, round(loo, 6) AS loo, near FROM loo")
def kernel_densities(spark, sf_dir):
    """Every vector's density under the other vectors of its label, and the nearest of them."""
    loo = pool(spark, sf_dir)[0]
    return r6(loo.select(F.col("key").alias("vec_id"), "label", "loo", "near"))


@query(KERNEL + """, cd AS (SELECT cu.vec_id, cu.label, ln(sum(exp((list_dot_product(cu.u, u.u) - 1) / tau))) + 1 / any_value(tau) - ln(count(*)) - any_value(loo) AS delta
        FROM cu JOIN u ON u.label = cu.label JOIN tau ON tau.label = cu.label JOIN loo ON loo.vec_id = cu.vec_id GROUP BY cu.vec_id, cu.label),
    ct AS (SELECT a.label, quantile_cont(abs(a.loo - b.loo), 0.5) AS e50, quantile_cont(abs(a.loo - b.loo), 0.75) AS e75, quantile_cont(abs(a.loo - b.loo), 0.9) AS e90 FROM loo a JOIN loo b ON b.vec_id = a.near GROUP BY a.label)
    SELECT label, count(*) AS candidates, round(avg((abs(delta) <= e50)::INT), 6) AS accept_50, round(avg((abs(delta) <= e75)::INT), 6) AS accept_75, round(avg((abs(delta) <= e90)::INT), 6) AS accept_90,
        round(avg((delta > 0)::INT), 6) AS ascent, round(quantile_cont(delta, 0.5), 6) AS delta_median, round(any_value(e50), 6) AS eps_50, round(abs(quantile_cont(delta, 0.5)) / any_value(e50), 6) AS deviation FROM cd JOIN ct USING (label) GROUP BY label""")
def kernel_ladder(spark, sf_dir):
    """How many transplants (half of a vector, half of the label's next one) deviate no more than neighbours do."""
    loo, packed, shape = pool(spark, sf_dir)
    w = W.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings")
    after = rows.withColumn("other", F.coalesce(F.lead("embedding").over(w), F.first("embedding").over(w)))
    mixed = F.concat(F.slice("embedding", 1, 32), F.slice("other", 33, 32))
    cands = after.select(F.col("vec_id").alias("key"), "label", F.col("vec_id").alias("src"), mixed.alias("vector"))
    return r6(kernels.ladder(kernels.candidate_deltas(cands, loo, packed, shape, block_rows=64), kernels.controls(loo)))
