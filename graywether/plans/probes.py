"""Queries of probes: permutations, neighbours, discriminants, drift, option tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions import maths
from graywether.functions import text as T
from graywether.operators import events, probes, ranking, vectors
from graywether.plans.lanes import A, AB, items, paired, r6
from graywether.plans.registry import query
from graywether.plans.texts import HASHES, docs
from graywether.sources.tables import table

UNITS = A + """, sims AS (SELECT a.vec_id AS case_id, b.vec_id AS row_id, b.label, round(sum(a.x * b.x), 6) AS sim FROM u_a a JOIN u_a b ON a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY ALL),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC, row_id) AS rank FROM sims) WHERE rank <= 10)"""


@query(UNITS + " SELECT case_id, row_id, label, sim, rank::INT AS rank FROM near")
def nearest_neighbours(spark, sf_dir):
    return probes.neighbours(table(spark, sf_dir, "embeddings"), 10)


@query(UNITS + """, m AS (SELECT case_id, label, round(sum(1 / (1 + exp(-20 * (sim - 0.3)))), 6) AS mass FROM near GROUP BY ALL)
    SELECT case_id, label, mass FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mass DESC, label) AS r FROM m) WHERE r = 1""")
def knn_label_smoothing(spark, sf_dir):
    return probes.smooth_labels(probes.neighbours(table(spark, sf_dir, "embeddings"), 10))


LDA = """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
    mu AS (SELECT label, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM x GROUP BY ALL), pv AS (SELECT dim, sum(v * n) / sum(n) AS v FROM mu GROUP BY dim),
    sv AS (SELECT dim, 0.99 * v + 0.01 * (SELECT avg(v) FROM pv) AS v FROM pv),
    d AS (SELECT vec_id AS case_id, x.label AS gold, mu.label AS opt, sum(x * m / sv.v) - sum(m * m / (2 * sv.v)) AS delta FROM x JOIN mu USING (dim) JOIN sv USING (dim) GROUP BY ALL)"""


def deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return probes.discriminants(rows, probes.label_means(rows), probes.pooled_variance(rows))


@query(LDA + " SELECT case_id, gold, opt, round(delta, 6) AS delta FROM d")
def lda_deltas(spark, sf_dir):
    return r6(deltas(spark, sf_dir))


@query(LDA + """, c AS (SELECT *, 1 / (1 + exp(-(delta - avg(delta) OVER (PARTITION BY case_id)))) AS s FROM d), p AS (SELECT case_id, gold, opt, round(s / sum(s) OVER (PARTITION BY case_id), 6) AS p FROM c)
    SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY p DESC, opt) AS pick, max(p) AS conf FROM p GROUP BY case_id""")
def lda_posterior(spark, sf_dir):
    w = W.partitionBy("case_id")
    rows = deltas(spark, sf_dir).withColumn("s", maths.sigmoid(F.col("delta") - F.avg("delta").over(w)))
    rows = rows.withColumn("p", F.round(F.col("s") / F.sum("s").over(w), 6))
    best = F.min(F.struct((-F.col("p")).alias("o"), F.col("opt").alias("opt")))
    return rows.groupBy("case_id", "gold").agg(best.alias("b"), F.max("p").alias("conf")).select("case_id", "gold", F.col("b.opt").alias("pick"), "conf")


@query(LDA + """, r AS (SELECT case_id, delta, row_number() OVER (PARTITION BY case_id ORDER BY delta DESC, opt) AS k FROM d)
    SELECT case_id, round(max(CASE WHEN k = 1 THEN delta END) - max(CASE WHEN k = 2 THEN delta END), 6) AS margin FROM r GROUP BY case_id""")
def learnability_margins(spark, sf_dir):
    top = deltas(spark, sf_dir).groupBy("case_id").agg(F.sort_array(F.collect_list("delta"), asc=False).alias("d"))  # one a label
    return r6(top.select("case_id", (F.get("d", F.lit(0)) - F.get("d", F.lit(1))).alias("margin")))


@query(A + """, k AS (SELECT label, dim, sum(x) AS s, count(*) AS n FROM u_a GROUP BY ALL) SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0::DOUBLE)), 6) AS mean_cos FROM k GROUP BY label""")
def label_kernel(spark, sf_dir):
    return r6(probes.pair_kernel(table(spark, sf_dir, "embeddings")))


@query(AB + """, runs AS (SELECT case_id, pick, conf FROM items_a UNION ALL SELECT case_id, pick, conf FROM items_b)
    SELECT case_id, round(max(conf) - min(conf), 6) AS swing, (count(DISTINCT pick) > 1)::INT AS flip, round(avg(conf), 7) AS mean_conf FROM runs GROUP BY case_id""")
def spread_per_case(spark, sf_dir):
    runs = items(spark, sf_dir, 64).select("case_id", "pick", "conf").union(items(spark, sf_dir, 32).select("case_id", "pick", "conf"))
    return probes.spread(runs).select("case_id", F.round("swing", 6).alias("swing"), "flip", F.round("mean_conf", 7).alias("mean_conf"))


@query(A + " SELECT case_id, pick, CASE WHEN pick >= 9 - pick THEN 0 ELSE 9 END::INT AS far FROM items_a")
def far_class_flip(spark, sf_dir):
    return probes.far_class(items(spark, sf_dir))


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, min(value) AS least, max(value) AS most, max(CASE WHEN i = ceil(n * 0.05) - 1 THEN value END) AS p05, max(CASE WHEN i = ceil(n * 0.5) - 1 THEN value END) AS p50, max(CASE WHEN i = ceil(n * 0.9) - 1 THEN value END) AS p90, count(*) AS n FROM e GROUP BY event_type""")
def drift_summary(spark, sf_dir):
    return probes.drift(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS size FROM documents) SELECT doc_id, place FROM p WHERE place IN (SELECT floor(i * size / 40)::BIGINT FROM (SELECT unnest(range(40)) AS i), (SELECT any_value(size) AS size FROM p))""")
def stride_sample(spark, sf_dir):
    return probes.stride(table(spark, sf_dir, "documents"), "doc_id", 40).select("doc_id", F.col("place").cast("long").alias("place"))


OC = f"WITH {HASHES}" + """,
    oe AS (SELECT d.lang AS qid, (CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END) AS option, (e.h % 131072)::INT AS tok FROM ev e JOIN documents d USING (doc_id) JOIN labels l USING (doc_id) WHERE NOT e.is_bigram),
    own AS (SELECT qid, option, tok, count(*) AS n_in FROM oe GROUP BY ALL), al AS (SELECT qid, tok, sum(n_in) AS n_all FROM own GROUP BY ALL)"""


def option_events(spark, sf_dir):
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    keyed = rows.select(F.struct(F.col("lang").alias("qid"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("option")).alias("k"), "text")
    found = events.token_events(keyed, "k").where("not is_bigram")
    return found.select("k.qid", "k.option", F.col("h").bitwiseAND(F.lit(T.BUCKETS - 1)).cast("int").alias("tok"))


@query(OC + " SELECT qid, option, tok, n_in, (n_all - n_in)::BIGINT AS n_out FROM own JOIN al USING (qid, tok)")
def option_conditioned_tables(spark, sf_dir):
    return probes.option_table(option_events(spark, sf_dir))


@query(A + """, o AS (SELECT conf, ok, row_number() OVER (ORDER BY conf, case_id) - 1 AS i, count(*) OVER () AS n FROM items_a)
    SELECT (CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN 1 ELSE 2 END)::INT AS tercile, count(*) AS n, round(avg(ok), 6) AS acc FROM o GROUP BY 1""")
def difficulty_terciles(spark, sf_dir):
    rows = items(spark, sf_dir)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    from graywether.operators.metrics import risk_coverage

    curve = risk_coverage(rows.select("case_id", (-F.col("conf")).alias("conf"), "ok")).select("case_id", (F.col("rank") - 1).alias("i"))
    placed = rows.join(curve, "case_id").crossJoin(n)
    tercile = F.when(F.col("i") < F.floor(F.col("n") / 3), 0).when(F.col("i") < F.floor(2 * F.col("n") / 3), 1).otherwise(2)
    return r6(placed.groupBy(tercile.cast("int").alias("tercile")).agg(F.count("*").alias("n"), F.avg("ok").alias("acc")))


@query(AB + """, d AS (SELECT a.case_id, max(abs(a.p - b.p)) AS most, sum(abs(a.p - b.p)) / 2 AS tv FROM pr_a a JOIN pr_b b ON a.case_id = b.case_id AND a.opt = b.opt GROUP BY a.case_id)
    SELECT round(avg(tv), 6) AS mean_tv, round(max(most), 6) AS max_shift, count(*) AS n FROM d""")
def probability_drift(spark, sf_dir):
    a, b = items(spark, sf_dir, 64), items(spark, sf_dir, 32)
    rows = a.select("case_id", F.col("probs").alias("pa")).join(b.select("case_id", F.col("probs").alias("pb")), "case_id")
    gaps = rows.select(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)).alias("g"))
    return r6(gaps.agg(F.avg(maths.total(F.col("g")) / 2).alias("mean_tv"), F.max(F.array_max("g")).alias("max_shift"), F.count("*").alias("n")))


@query(A + """, c AS (SELECT max(n) / sum(n) AS chance FROM (SELECT count(*) AS n FROM items_a GROUP BY gold)) SELECT round(avg(ok), 6) AS accuracy, round(any_value(chance), 6)::DOUBLE AS chance, round(greatest(0, least(1, (avg(ok) - any_value(chance)) / (1 - any_value(chance)))), 6)::DOUBLE AS skill FROM items_a, c""")
def chance_corrected_skill(spark, sf_dir):
    rows = items(spark, sf_dir)
    counts = rows.groupBy("gold").agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    one = counts.agg((F.sum("k") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("chance"))
    return r6(one.select("accuracy", "chance", maths.skill(F.col("accuracy"), F.col("chance")).alias("skill")))


@query(AB + """, pair AS (SELECT a.case_id, a.ok AS x, b.ok AS y FROM items_a a JOIN items_b b USING (case_id)), r AS (SELECT unnest([8, 16, 32, 64, 128, 256]) AS rung),
    o AS (SELECT *, row_number() OVER (ORDER BY case_id) AS i FROM pair)
    SELECT rung::INT AS rung, sum((i <= rung AND x > y)::INT)::BIGINT AS wins, sum((i <= rung AND x < y)::INT)::BIGINT AS losses FROM o, r GROUP BY rung""")
def prefix_rung_feed(spark, sf_dir):
    rungs = [8, 16, 32, 64, 128, 256]
    rows = paired(spark, sf_dir).orderBy("case_id").limit(max(rungs)).withColumn("i", F.row_number().over(W.orderBy("case_id")))  # 256 rows at most
    long = rows.withColumn("rung", F.explode(F.array(*map(F.lit, rungs)))).where("i <= rung")
    return long.groupBy("rung").agg(F.sum((F.col("ok_a") > F.col("ok_b")).cast("long")).alias("wins"), F.sum((F.col("ok_a") < F.col("ok_b")).cast("long")).alias("losses"))


@query(A + """, r AS (SELECT case_id, first(opt ORDER BY round(dot, 9) DESC, opt) AS pick, max(dot) AS d FROM dots_a GROUP BY case_id)
    SELECT pick, count(*) AS n, sum((d < 0.5)::INT)::BIGINT AS n_below, round(avg((d < 0.5)::INT), 6) AS share FROM r GROUP BY pick""")
def abstain_split(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    routed = vectors.route(rows, vectors.centroids(rows)).select("pick", (F.array_max("dots") < 0.5).cast("int").alias("below"))
    return r6(routed.groupBy("pick").agg(F.count("*").alias("n"), F.sum(F.col("below").cast("long")).alias("n_below"), F.avg("below").alias("share")))


@query(A + """, s AS (SELECT conf, ok FROM items_a), c AS (SELECT conf AS t, (SELECT avg(ok) FROM s WHERE s.conf >= q.conf) AS acc FROM (SELECT DISTINCT conf FROM s) q) SELECT round(max(acc), 6) AS best_accuracy, count(*) AS n_thresholds FROM c""")
def best_threshold_accuracy(spark, sf_dir):
    return r6(ranking.curve_points(items(spark, sf_dir)).agg(F.max("accuracy").alias("best_accuracy"), F.count("*").alias("n_thresholds")))
