"""Queries of verdicts: routers, calibration claims, stability, hygiene, resamples."""

from __future__ import annotations

from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.operators import probes, verdicts
from graywether.plans.lanes import A, AB, PAIR_SQL, items, paired, r6, routed
from graywether.plans.registry import query
from graywether.plans.texts import CROSSED, FOLDS, PLAIN, crossed, docs
from graywether.sources.tables import table


@query(AB + """, s AS (SELECT sum(a.ok - b.ok) AS gap, count(*) AS n FROM items_a a JOIN items_b b USING (case_id)),
    w AS (SELECT a.case_id, 1 / (1 + exp(-((gap - (a.ok - b.ok)) / ((n - 1) * 0.01::DOUBLE)))) AS g FROM items_a a JOIN items_b b USING (case_id), s),
    q AS (SELECT a.case_id, a.gold, a.opt, round(g * a.p + (1 - g) * b.p, 9) AS q FROM w JOIN pr_a a USING (case_id) JOIN pr_b b ON b.case_id = a.case_id AND b.opt = a.opt),
    r AS (SELECT case_id, any_value(gold) AS gold, first(opt ORDER BY q DESC, opt) AS pick FROM q GROUP BY case_id)
    SELECT round(avg((gold = pick)::INT), 6) AS accuracy, count(*) AS n FROM r""")
def loo_router_accuracy(spark, sf_dir):
    return r6(verdicts.loo_routed(items(spark, sf_dir, 64), items(spark, sf_dir, 32)))


ECE_BY = """e AS (SELECT {by}, least(14, ceil(conf * 15)::INT - 1) AS bin, count(*) AS c, avg(conf) AS m, avg(ok) AS a FROM l WHERE conf > 0 AND conf <= 1 GROUP BY ALL),
    ece AS (SELECT {by}, sum(c * abs(m - a)) / sum(c) AS ece FROM e GROUP BY {by})"""


@query(A + """, h AS (SELECT case_id, max(p) AS m, 1 - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) AS i FROM pr_a GROUP BY case_id),
    c AS (SELECT * FROM h JOIN items_a USING (case_id)),
    l AS (SELECT 'dispatch' AS mode, round(m, 6) AS conf, ok FROM c UNION ALL SELECT 'max_prob', round(m, 6), ok FROM c UNION ALL SELECT 'inv_entropy', round(i, 6), ok FROM c),
    """ + ECE_BY.format(by="mode") + " SELECT mode, round(ece, 6) AS ece FROM ece")
def readout_report(spark, sf_dir):
    return r6(verdicts.readout_report(items(spark, sf_dir)))


@query(A + """, cal AS (SELECT * FROM items_a WHERE case_id % 2 = 0), fit AS (SELECT least(14, ceil(conf * 15)::INT - 1) AS bin, avg(ok) AS fit FROM cal WHERE conf > 0 AND conf <= 1 GROUP BY 1),
    t AS (SELECT i.case_id, conf, ok, fit, (1 + (SELECT count(*) FROM cal c WHERE c.conf <= i.conf)) / ((SELECT count(*) FROM cal) + 1.0::DOUBLE) AS fl
        FROM items_a i LEFT JOIN fit ON fit.bin = least(14, ceil(conf * 15)::INT - 1) WHERE i.case_id % 2 = 1),
    l AS (SELECT 'raw' AS arm, conf, ok FROM t UNION ALL SELECT 'cal', round(coalesce(fit, conf), 6), ok FROM t UNION ALL SELECT 'floor', round(fl, 6), ok FROM t),
    """ + ECE_BY.format(by="arm") + """, o AS (SELECT max(CASE WHEN arm = 'raw' THEN ece END) AS r, max(CASE WHEN arm = 'cal' THEN ece END) AS c, max(CASE WHEN arm = 'floor' THEN ece END) AS f FROM ece)
    SELECT round(r, 6) AS ece_raw, round(c, 6) AS ece_cal, round(f, 6) AS ece_floor, CASE WHEN (SELECT count(*) FROM cal) < 64 THEN 'no_claim' WHEN c < r AND c < f THEN 'pass' ELSE 'fail' END AS verdict FROM o""")
def g1_verdict_cell(spark, sf_dir):
    rows, even = items(spark, sf_dir), F.col("case_id") % 2 == 0
    return r6(verdicts.g1_cell(rows.where(even), rows.where(~even)))


@query(A + """, d AS (SELECT case_id, floor(round(max(dot), 6) * 32)::INT AS depth FROM dots_a GROUP BY case_id), r AS (SELECT depth, ok FROM d JOIN items_a USING (case_id)), m AS (SELECT max(depth) AS most FROM r),
    e AS (SELECT least(9, floor((depth - 1) * 10 / most)) AS bin, count(*) AS c, avg(depth / most) AS m, avg(ok) AS a FROM r, m WHERE depth > 0 GROUP BY 1)
    SELECT round(sum(c * abs(m - a)) / sum(c), 6) AS ece, sum(c)::BIGINT AS n FROM e""")
def depth_ece(spark, sf_dir):
    depth = routed(spark, sf_dir).select("case_id", F.floor(F.round(F.array_max("dots"), 6) * 32).cast("int").alias("depth"))
    return r6(verdicts.depth_ece(items(spark, sf_dir).join(depth, "case_id").select("depth", "ok")))


@query(CROSSED + """, v AS (SELECT d.doc_id, coalesce(n, 0) AS total, coalesce((SELECT max(seen) FROM sc WHERE sc.doc_id = d.doc_id), 0) AS seen FROM documents d LEFT JOIN t USING (doc_id)), o AS (SELECT *, row_number() OVER (ORDER BY seen) AS i, count(*) OVER () AS m FROM v)
    SELECT min(seen) AS least, max(CASE WHEN i = ceil(m * 0.25) THEN seen END) AS p25, max(CASE WHEN i = ceil(m * 0.5) THEN seen END) AS p50, max(CASE WHEN i = ceil(m * 0.75) THEN seen END) AS p75, max(seen) AS most,
    count(*) AS n, round(avg(seen), 6) AS mean_seen, round(avg((seen < 4)::INT), 6) AS rumor_share, round(avg((seen = 0)::INT), 6) AS zero_share, round(avg(CASE WHEN total = 0 THEN 0 ELSE seen / total END), 6) AS mean_share FROM o""")
def evidence_density_stats(spark, sf_dir):
    return r6(verdicts.evidence_stats(crossed(spark, sf_dir).select(F.col("n").alias("total"), "seen")))


@query(AB + """, runs AS (SELECT case_id, pick, conf FROM items_a UNION ALL SELECT case_id, pick, conf FROM items_b),
    s AS (SELECT case_id, round(round(max(conf) - min(conf), 6) * 100, 6) AS pt, (count(DISTINCT pick) > 1)::INT AS flip FROM runs GROUP BY case_id), o AS (SELECT *, row_number() OVER (ORDER BY pt) AS i, count(*) OVER () AS m FROM s)
    SELECT count(*) AS n, max(CASE WHEN i = ceil(m * 0.5) THEN pt END) AS median, max(pt) AS largest, sum(flip)::BIGINT AS flips, round(avg(flip), 6) AS flip_rate, CASE WHEN max(CASE WHEN i = ceil(m * 0.5) THEN pt END) > 2 THEN 'RED' ELSE 'PASS' END AS verdict FROM o""")
def spread_verdict(spark, sf_dir):
    runs = items(spark, sf_dir, 64).select("case_id", "pick", "conf").union(items(spark, sf_dir, 32).select("case_id", "pick", "conf"))
    spreads = probes.spread(runs).select(F.round("swing", 6).alias("swing"), "flip")
    return r6(verdicts.spread_stats(spreads))


@query(A + """, i AS (SELECT case_id, opt, p, row_number() OVER (PARTITION BY case_id ORDER BY opt) AS i FROM pr_a), v AS (SELECT *, i * ((1 + sqrt(5.0::DOUBLE)) / 2) AS x FROM i),
    s AS (SELECT case_id, sum(p) AS q, sum(p * i) AS s1, sum(p * (i * 10.0::DOUBLE)) AS t1, sum(p * (i + 7.0::DOUBLE)) AS u1, sum(p * ((x - floor(x)) * 100)) AS s2, sum(p * ((x - floor(x)) * 100 * 10)) AS t2,
        sum(p * ((x - floor(x)) * 100 + 7)) AS u2, first(opt ORDER BY p DESC, opt) AS top FROM v GROUP BY case_id)
    SELECT round(max(greatest(abs(t1 - 10 * s1), abs(t2 - 10 * s2))), 6) AS scale, round(max(greatest(abs(u1 - s1 - 7 * q), abs(u2 - s2 - 7 * q))), 6) AS shift, round(max(abs(q - 1)), 6) AS total,
    sum((top <> pick)::INT)::BIGINT AS disagreements FROM s JOIN items_a USING (case_id)""")
def rubric_identities(spark, sf_dir):
    return r6(verdicts.rubric_residuals(items(spark, sf_dir)))


@query("""WITH s AS (SELECT n.n_nationkey AS case_id, n.n_name AS gold, list(m.n_name) AS labels FROM nation n JOIN nation m USING (n_regionkey) GROUP BY 1, 2),
    g AS (SELECT n_name AS l, list_distinct(list_transform(range(1, greatest(strlen(n_name) - 2, 1) + 1), lambda i: substr(hex(encode(lower(n_name))), (2 * i - 1)::INT, 6))) AS g FROM nation),
    c AS (SELECT case_id, o.l AS o, round(len(list_intersect(o.g, x.g)) / len(list_distinct(list_concat(o.g, x.g))), 9) AS sim FROM s JOIN g x ON x.l = s.gold, g o WHERE NOT list_contains(labels, o.l)),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC, o) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM c)
    SELECT case_id, list(o ORDER BY i) AS decoys FROM r WHERE i IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1) GROUP BY case_id""")
def graded_decoys(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    labels = rows.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("labels"))  # a region's nations
    slots = rows.join(labels, "n_regionkey").select(F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("gold"), "labels")
    return verdicts.graded_decoys(slots, 4)


@query(f"""WITH r AS (SELECT doc_id, coalesce(doc_id % 5, 0)::INT AS fold, {PLAIN} AS ws FROM documents), k AS (SELECT w, count(DISTINCT fold) AS folds, any_value(fold) AS own FROM (SELECT fold, unnest(ws) AS w FROM r) GROUP BY w),
    h AS (SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, fold, unnest(ws) AS w FROM r) JOIN k USING (w) WHERE folds > 1 OR own <> fold GROUP BY doc_id),
    t AS (SELECT doc_id, fold, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM r WHERE len(ws) > 2),
    x AS (SELECT DISTINCT doc_id FROM t JOIN (SELECT g FROM t GROUP BY g HAVING count(DISTINCT fold) > 1) USING (g)),
    o AS (SELECT fold, CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(hits, 0) / len(ws) END AS share, (x.doc_id IS NOT NULL)::INT AS walled FROM r LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id))
    SELECT fold, count(*) AS n, round(avg(share), 6) AS mean_overlap, round(max(share), 6) AS max_overlap, sum(walled)::BIGINT AS trigram_hits FROM o GROUP BY fold""")
def slice_hygiene(spark, sf_dir):
    """Each of five folds held against the other four."""
    fold = F.coalesce(F.pmod("doc_id", F.lit(FOLDS)), F.lit(0)).cast("int").alias("fold")
    return r6(verdicts.hygiene(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), fold, "text")))


BANS = ["license", "email", "phone", "password"]


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({PLAIN}) AS token FROM documents) WHERE token IN {tuple(BANS)} GROUP BY ALL")
def label_token_bans(spark, sf_dir):
    return verdicts.banned_tokens(docs(spark, sf_dir), BANS)


DRAW = " + ".join(f"(u >= {t})::INT" for t in verdicts.POISSON)


@query(A + f""", d AS (SELECT ok, b, ('0x' || substr(md5(case_id::VARCHAR || ':' || b::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM items_a, (SELECT unnest(range(200)) AS b)),
    w AS (SELECT b, ok, {DRAW} AS w FROM d), e AS (SELECT sum(w * ok) / sum(w) AS x FROM w GROUP BY b HAVING sum(w) > 0), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM e)
    SELECT round(min(CASE WHEN i = floor(n * 0.025) THEN x END), 6) AS low, round(max(CASE WHEN i = floor(n * 0.975) THEN x END), 6) AS high, round(avg(x), 6) AS mean FROM o""")
def bootstrap_accuracy_ci(spark, sf_dir):
    return r6(verdicts.bootstrap_accuracy(items(spark, sf_dir)))


@query("""SELECT event_type, first(value ORDER BY ts, event_id) AS first, max(value) AS most, first(event_id ORDER BY value DESC, ts, event_id) AS most_at, count(*) AS n FROM events GROUP BY event_type""")
def latency_extremes(spark, sf_dir):
    return verdicts.extremes(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


@query(A + " SELECT case_id, probs AS restored, (case_id % 10)::INT AS k FROM items_a")
def label_space_restored(spark, sf_dir):
    k = (F.col("case_id") % 10).cast("int")
    order = F.transform("probs", lambda _, i: (i + k) % F.size("probs"))
    shown = items(spark, sf_dir).select("case_id", k.alias("k"), order.alias("order"), "probs")
    shown = shown.withColumn("shown", F.transform("order", lambda i: F.get("probs", i)))
    return shown.select("case_id", verdicts.label_space(F.col("shown"), F.col("order")).alias("restored"), "k")


@query("""WITH f AS (SELECT doc_id, CASE WHEN len(l) > 8 THEN l[1:6] || [array_to_string(l[7:], chr(10)), l[8]] ELSE l END AS f FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)) SELECT doc_id, len(f)::INT AS n_fields, f[1] AS first_field, f[len(f)] AS last_field, coalesce(length(f[len(f) - 1]), 0)::INT AS n_before FROM f""")
def field_lines(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.array(verdicts.fields(F.col("text")))).alias("f"))
    return rows.select("doc_id", F.size("f").alias("n_fields"), F.get("f", F.lit(0)).alias("first_field"), F.get("f", F.size("f") - 1).alias("last_field"), F.coalesce(F.char_length(F.get("f", F.size("f") - 2)), F.lit(0)).alias("n_before"))


@query(PAIR_SQL + """, m AS (SELECT count(*) AS n, avg(ok_b) AS b, avg(ok_a) AS a FROM pair WHERE conf_a < 0.15)
    SELECT n, round(b, 6) AS acc_b, round(a, 6) AS acc_a, round(b - a, 6) AS delta, round(b - a - 1.644934 * sqrt((b * (1 - b) + a * (1 - a)) / n), 6) AS lcb95, CASE WHEN n >= 20 THEN b - a < 0.05 END AS disarmed FROM m""")
def worthiness_probe(spark, sf_dir):
    return r6(verdicts.worthiness(paired(spark, sf_dir), at=0.15, least=20, delta=0.05))


@query(A + """, o AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS i, count(*) OVER () AS n FROM items_a), s AS (SELECT conf AS t FROM o WHERE i = least(floor(n * 0.5), n - 1)),
    p AS (SELECT k AS place, t + k * 0.02::DOUBLE AS threshold, avg(CASE WHEN conf >= t + k * 0.02::DOUBLE THEN ok END) AS accuracy, avg((conf >= t + k * 0.02::DOUBLE)::INT) AS pass_rate FROM items_a, s, (SELECT unnest([-1, 0, 1]) AS k) GROUP BY k, t),
    z AS (SELECT accuracy AS sa, pass_rate AS sp FROM p WHERE place = 0)
    SELECT place, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, round(pass_rate, 6) AS pass_rate,
    CASE WHEN place = 0 THEN 'none' WHEN pass_rate > 0 AND sp >= 2 * pass_rate THEN 'pass_rate' WHEN accuracy > 0 AND sa >= 2 * accuracy THEN 'accuracy' ELSE 'none' END AS edge FROM p, z""")
def threshold_knife_edge(spark, sf_dir):
    return r6(verdicts.knife_edge(items(spark, sf_dir), 0.5))


def hist_sql(lane: str) -> str:
    return f"""h_{lane} AS (SELECT least(9, floor(h * 10)) AS b, count(*) AS n FROM (SELECT greatest(0, least(1, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)))) AS h FROM pr_{lane} GROUP BY case_id) GROUP BY 1),
    s_{lane} AS (SELECT b.b, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER () + 10.0::DOUBLE) AS s FROM (SELECT unnest(range(10)) AS b) b LEFT JOIN h_{lane} h ON h.b = b.b)"""


@query(AB + f", {hist_sql('a')}, {hist_sql('b')}, k AS (SELECT sum(x.s * ln(x.s / y.s)) AS kl FROM s_a x JOIN s_b y USING (b)) SELECT round(kl, 6) AS kl, kl <= 0.05 AS passes FROM k")
def entropy_hist_kl(spark, sf_dir):
    a, b = (items(spark, sf_dir, d).select(maths.normalised_entropy(F.col("probs")).alias("x")) for d in (64, 32))
    return r6(verdicts.histogram_kl(a, b))
