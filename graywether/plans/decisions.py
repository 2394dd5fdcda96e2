"""Queries of the decision core: a choice, a score and a yes or no about every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.functions import text as T
from graywether.operators import bayes, decisions, features, options, pairs
from graywether.plans.cases import LANGS
from graywether.plans.lanes import r6
from graywether.plans.registry import query
from graywether.plans.texts import CROSSED, FOLDS, docs
from graywether.sources.steps import Workspace

POSTURE = decisions.Posture(route=4.0, nb=1.0, nb_pair=0.25, option=0.5, yes_domain="en", threshold=0.02)
LEVELS = ["0", "1", "2"]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, fold, level, vector, toks, times, n of every document, written once. A null id is in fold 0."""
    fold = F.coalesce(F.pmod("doc_id", F.lit(FOLDS)), F.lit(0)).cast("int").alias("fold")
    size = F.coalesce(F.char_length("text"), F.lit(0))
    level = ((size >= 300).cast("int") + (size >= 1500).cast("int")).cast("string").alias("level")
    rows = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label"), fold, level, "text")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # one file may hold most of the texts
    carry = ["doc_id", "label", "fold", "level"]
    held = features.embedded(dealt, [*carry, "text"])
    return Workspace(spark, "states").save(pairs.view_rows(held, [*carry, "vector"], "bag").drop("runs"), "rows")


def questions() -> list:
    """The questions of a row: qid, kind, options, gold."""
    ask = lambda qid, kind, opts, gold: F.struct(F.lit(qid).alias("qid"), F.lit(kind).alias("kind"), F.array(*map(F.lit, opts)).alias("options"), gold.alias("gold"))
    english = F.when(F.col("row.label").eqNullSafe(F.lit("en")), "yes").otherwise("no")
    return [ask("lang", "choice", LANGS, F.col("row.label")), ask("length", "score", LEVELS, F.col("row.level")), ask("english", "noul", decisions.YES_NO, english)]


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gold, qid, kind, options, probs, pick, conf, cause of every document's three questions, by the folds it isn't in.

    Events are counted once, by all that the questions' answers depend on; both kinds of tables are sums of these counts. A text's
    events are written once and multiplied by its questions in the task that answers them only.
    """
    ws = Workspace(spark, "decisions")
    rows = states(spark, sf_dir)
    cells = rows.select("fold", "label", "level", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("times").alias("t"))))
    joint = ws.save(cells.groupBy("fold", "label", "level", "tok").agg(F.sum("t").alias("n_in")), "joint")
    counts = ws.save(joint.where("label is not null").groupBy("fold", "label", "tok").agg(F.sum("n_in").alias("n_in")), "counts")
    answers = joint.select("fold", "tok", "n_in", F.struct("label", "level").alias("row")).select("fold", "tok", "n_in", F.inline(F.array(*questions())))
    answers = answers.where("gold is not null").groupBy("fold", "qid", F.col("gold").alias("option"), "tok").agg(F.sum("n_in").alias("n_in"))
    tables = ws.save(answers, "options")
    keyed = rows.select(F.struct("doc_id", "label", "fold", "level", "vector", "toks", "times").alias("row"), "fold", "toks", "times", "n")
    scored = bayes.scores(keyed, counts, ["row"]).select("row", F.col("row.fold").alias("fold"), F.col("row.vector").alias("vector"), "n", F.col("scores").alias("nb"))
    routed = decisions.cosines(scored, ws.save(decisions.fold_centroids(rows), "centroids"))  # written, so that its size is known
    asked = routed.select("row.doc_id", "fold", "row.toks", "row.times", "n", "cosines", "nb", F.inline(F.array(*questions())))
    conditioned = options.scores(asked, tables, ["doc_id", "gold", "kind", "cosines", "nb"], FOLDS)
    return decisions.decide(conditioned, ["doc_id", "gold"], POSTURE)


P = POSTURE
LIST = "[" + ", ".join(f"'{x}'" for x in LANGS) + "]"
DECISIONS = CROSSED + f""",
    ew AS (SELECT doc_id, (h % 256)::INT AS b, sum((CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END) * (CASE WHEN is_bigram THEN 0.5::DOUBLE ELSE 1 END)) AS w FROM ev GROUP BY ALL),
    em AS (SELECT doc_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM ew WHERE w <> 0),
    cs AS (SELECT folds.fold, lang, b, sum(x) AS s FROM em JOIN placed USING (doc_id) JOIN folds ON placed.fold <> folds.fold GROUP BY ALL),
    cd AS (SELECT fold, lang, b, s / sqrt(sum(s * s) OVER (PARTITION BY fold, lang)) AS s FROM cs),
    co AS (SELECT em.doc_id, c.lang, sum(em.x * c.s) AS c FROM em JOIN placed p USING (doc_id) JOIN cd c ON c.fold = p.fold AND c.b = em.b GROUP BY ALL),
    st AS (SELECT p.doc_id, z.lang AS domain, coalesce(co.c, 0) AS c, coalesce(sc.score, 0) AS s, coalesce(t.n, 0) AS n FROM placed p JOIN sz z ON z.fold = p.fold LEFT JOIN co ON co.doc_id = p.doc_id AND co.lang = z.lang
        LEFT JOIN sc ON sc.doc_id = p.doc_id AND sc.domain = z.lang LEFT JOIN t ON t.doc_id = p.doc_id),
    sm AS (SELECT a.*, a.s - coalesce((SELECT max(b.s) FROM st b WHERE b.doc_id = a.doc_id AND b.domain <> a.domain), 0) AS m, a.s - coalesce((SELECT max(b.s) FROM st b WHERE b.doc_id = a.doc_id AND b.domain <> a.domain AND b.domain IN {tuple(LANGS)}), 0) AS mo FROM st a),
    nt AS (SELECT *, CASE WHEN n = 0 THEN {P.nb / 2}::DOUBLE ELSE {P.nb}::DOUBLE / (1 + exp(-m / n)) END AS term FROM sm),
    sz3 AS (SELECT doc_id, coalesce(length(text), 0) AS k FROM documents),
    qs AS (SELECT doc_id, fold, 'lang' AS qid, 'choice' AS kind, lang AS gold, {LIST} AS opts FROM placed UNION ALL SELECT doc_id, fold, 'length', 'score', ((k >= 300)::INT + (k >= 1500)::INT)::VARCHAR, ['0', '1', '2'] FROM placed JOIN sz3 USING (doc_id)
        UNION ALL SELECT doc_id, fold, 'english', 'noul', CASE WHEN lang IS NOT DISTINCT FROM 'en' THEN 'yes' ELSE 'no' END, ['yes', 'no'] FROM placed),
    qe AS (SELECT q.doc_id, q.fold, q.qid, q.gold, te.tok FROM qs q JOIN te USING (doc_id)), qf AS (SELECT fold AS own, qid, gold, tok, count(*) AS n FROM qe GROUP BY ALL),
    qc AS (SELECT fold, qid, gold, tok, sum(n) AS n_in FROM qf JOIN folds ON own <> fold GROUP BY ALL), qo AS (SELECT fold, count(DISTINCT tok)::DOUBLE AS m FROM qc GROUP BY fold),
    qa AS (SELECT fold, qid, tok, sum(n_in) AS n_all FROM qc GROUP BY ALL), qz AS (SELECT fold, qid, gold, sum(n_in) AS size_in FROM qc GROUP BY ALL), qt AS (SELECT fold, qid, sum(size_in) AS size_all FROM qz GROUP BY ALL),
    ql AS (SELECT fold, qid, z.gold AS opt, a.tok, log2((coalesce(c.n_in, 0) + m / {T.BUCKETS}) / (z.size_in + m)) - log2((a.n_all - coalesce(c.n_in, 0) + m / {T.BUCKETS}) / (qt.size_all - z.size_in + m)) AS score
        FROM qa a JOIN qz z USING (fold, qid) JOIN qt USING (fold, qid) JOIN qo USING (fold) LEFT JOIN qc c USING (fold, qid, gold, tok)),
    qg AS (SELECT qe.doc_id, qe.qid, l.opt, sum(l.score) AS score FROM qe JOIN ql l USING (fold, qid, tok) GROUP BY ALL),
    lo AS (SELECT q.doc_id, q.fold, q.qid, q.kind, q.gold, unnest(opts) AS opt, unnest(range(len(opts))) AS i FROM qs q),
    ls AS (SELECT lo.*, coalesce(t.n, 0) AS n, CASE WHEN z.size_in IS NOT NULL THEN coalesce(g.score, 0) END AS s FROM lo LEFT JOIN qz z ON z.fold = lo.fold AND z.qid = lo.qid AND z.gold = lo.opt LEFT JOIN qg g ON g.doc_id = lo.doc_id AND g.qid = lo.qid AND g.opt = lo.opt LEFT JOIN t ON t.doc_id = lo.doc_id),
    lt AS (SELECT a.*, CASE WHEN s IS NULL THEN 0 WHEN n = 0 THEN {P.option / 2}::DOUBLE ELSE {P.option}::DOUBLE / (1 + exp(-(s - coalesce((SELECT max(b.s) FROM ls b WHERE b.doc_id = a.doc_id AND b.qid = a.qid AND b.i <> a.i), 0)) / n)) END AS own FROM ls a),
    su AS (SELECT lt.*, own + CASE kind WHEN 'choice' THEN 1 / (1 + exp(-{P.route}::DOUBLE * d.c)) + d.term + {P.nb_pair}::DOUBLE / (1 + exp(-d.mo)) WHEN 'noul' THEN CASE opt WHEN 'yes' THEN y.term ELSE {P.nb}::DOUBLE - y.term END ELSE 0 END AS sum
        FROM lt LEFT JOIN nt d ON d.doc_id = lt.doc_id AND d.domain = lt.opt LEFT JOIN nt y ON y.doc_id = lt.doc_id AND y.domain = '{P.yes_domain}'),
    pr AS (SELECT *, round(sum / sum(sum) OVER (PARTITION BY doc_id, qid), 6) AS p FROM su),
    de AS (SELECT doc_id, qid, any_value(kind) AS kind, any_value(gold) AS gold, first(opt ORDER BY p DESC, i) AS pick, round(1 - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)), 6) AS conf FROM pr GROUP BY doc_id, qid)"""


@query(DECISIONS + f" SELECT doc_id, qid, kind, gold, pick, conf, CASE WHEN conf < {P.threshold} THEN 'score_gate' ELSE 'answered' END AS cause FROM de")
def decisions_by_question(spark, sf_dir):
    """Every document's language (a choice), length (a score) and whether it is English (yes or no)."""
    return decided(spark, sf_dir).select("doc_id", "qid", "kind", "gold", "pick", "conf", "cause")


@query(DECISIONS + f""" SELECT qid, kind, count(*) AS n, sum((conf >= {P.threshold})::INT)::BIGINT AS answered, round(avg((pick IS NOT DISTINCT FROM gold)::INT), 6) AS accuracy,
    round(avg(CASE WHEN conf >= {P.threshold} THEN (pick IS NOT DISTINCT FROM gold)::INT END), 6) AS accuracy_answered FROM de GROUP BY qid, kind""")
def decision_report(spark, sf_dir):
    """Coverage and accuracy of each question."""
    ok, answered = F.col("pick").eqNullSafe(F.col("gold")).cast("int"), F.col("cause") == "answered"
    rows = decided(spark, sf_dir).groupBy("qid", "kind")
    return r6(rows.agg(F.count("*").alias("n"), F.sum(answered.cast("long")).alias("answered"), F.avg(ok).alias("accuracy"), F.avg(F.when(answered, ok)).alias("accuracy_answered")))
