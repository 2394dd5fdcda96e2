"""Queries of typed decisions, self-training and basis certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.operators import basis, bayes, features, typed
from graywether.plans.lanes import r6
from graywether.plans.registry import query
from graywether.plans.texts import HASHES, answers, docs
from graywether.sources.steps import Workspace
from graywether.sources.tables import table

QUESTIONS = (
    """'{"lang": {"type": "choice", "instructions": "Which language?", "criteria": {"fr": null, "en": "English", "de": "German"}}, "toxic": {"type": "noul", "instructions": ' """
    """|| CASE WHEN d.doc_id % 3 = 0 THEN '5' ELSE '"Is it toxic?"' END || '}, "quality": {"type": "score", "instructions": "How good?", "criteria": ["poor", "good"]}, "odd": {"type": "free"}, "spare": 1}'"""
)
GOLD = (
    """'{"lang": {"label": "' || coalesce(lang, '') || '", "probabilities": {"' || coalesce(lang, '') || '": 0.875}}, "toxic": {"label": ' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END """
    """|| CASE WHEN d.doc_id % 2 = 0 THEN ', "noul": 0.75' ELSE '' END || '}, "odd": {}, "quality": {' || coalesce('"label": "' || quality || '"', '') || '}}'"""
)
# the same JSON texts in both engines; a seventh of the rows have broken questions, an eleventh no workflow
TYPED_ROWS = f"""SELECT d.doc_id AS id, CASE WHEN d.doc_id % 11 <> 0 THEN source END AS workflow, 'about ' || d.doc_id AS state, CASE WHEN d.doc_id % 7 = 0 THEN '{{broken' ELSE {QUESTIONS} END AS questions, {GOLD} AS gold
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
TYPED = f"""WITH rw AS ({TYPED_ROWS}), ok AS (SELECT * FROM rw WHERE workflow IS NOT NULL AND state IS NOT NULL AND json_valid(questions)),
    ks AS (SELECT *, unnest(json_keys(questions)) AS qid, unnest(range(len(json_keys(questions)))) AS pos FROM ok),
    qs AS (SELECT id, workflow, pos, qid, json_extract(questions, '$.' || qid) AS d, json_extract(gold, '$.' || qid) AS a FROM ks),
    ty AS (SELECT *, json_extract_string(d, '$.type') AS kind, json_extract_string(a, '$.label') AS label FROM qs),
    op AS (SELECT *, CASE kind WHEN 'choice' THEN json_keys(d, '$.criteria') WHEN 'noul' THEN ['false', 'true'] WHEN 'score' THEN list_transform(range(json_array_length(d, '$.criteria')::BIGINT), lambda i: i::VARCHAR) END AS opts FROM ty),
    gi AS (SELECT *, CASE kind WHEN 'choice' THEN nullif(list_position(opts, label), 0) - 1 WHEN 'noul' THEN (lower(label) = 'true')::INT WHEN 'score' THEN try_cast(label AS INT) END AS gold_idx FROM op),
    st AS (SELECT *, CASE WHEN a IS NULL THEN 'gold' WHEN kind IS NULL OR kind NOT IN ('choice', 'noul', 'score') THEN 'kind' WHEN coalesce(json_type(d, '$.instructions'), '') <> 'VARCHAR' THEN 'instructions' WHEN gold_idx IS NULL THEN 'answer' ELSE 'ok' END AS status FROM gi),
    al AS (SELECT id, workflow, pos, qid, kind, opts, label, a, gold_idx, status FROM st UNION ALL SELECT id, workflow, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'row' FROM rw WHERE id NOT IN (SELECT id FROM ok))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = docs(spark, sf_dir).alias("d"), table(spark, sf_dir, "labels").alias("l")
    joined = d.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    rows = joined.select(
        F.col("d.doc_id").alias("id"), F.expr("case when d.doc_id % 11 <> 0 then source end").alias("workflow"), F.expr("'about ' || d.doc_id").alias("state"),
        F.expr(f"case when d.doc_id % 7 = 0 then '{{broken' else {QUESTIONS} end").alias("questions"), F.expr(GOLD).alias("gold"),
    )
    return typed.exploded(rows)


@query(TYPED + """ SELECT id, workflow, pos::INT AS pos, qid, CASE WHEN status = 'ok' THEN kind END AS kind, CASE WHEN status = 'ok' THEN gold_idx::INT END AS gold_idx,
    CASE WHEN status = 'ok' THEN CASE kind WHEN 'noul' THEN [1 - coalesce(json_extract(a, '$.noul')::DOUBLE, 0.5), coalesce(json_extract(a, '$.noul')::DOUBLE, 0.5)] ELSE list_transform(opts, lambda o: coalesce(json_extract(a, '$.probabilities.' || o)::DOUBLE, 0)) END END AS soft,
    CASE WHEN status = 'ok' AND kind = 'score' THEN label::DOUBLE END AS gold_score, status FROM al""")
def typed_questions(spark, sf_dir):
    """Every question of every row with its gold answer, or with what it lacks."""
    return questions(spark, sf_dir).drop("instructions", "options")


@query(TYPED + " SELECT status, count(*) AS n FROM al GROUP BY status")
def typed_validity(spark, sf_dir):
    return typed.validity(questions(spark, sf_dir))


# tables of the labelled documents, then those and the other half's own decisions
def odds_sql(events: str, tag: str) -> str:
    return f"""
    c{tag} AS (SELECT half, lang, tok, count(*) AS n_in FROM {events} GROUP BY ALL), a{tag} AS (SELECT half, tok, sum(n_in) AS n_all FROM c{tag} GROUP BY ALL), z{tag} AS (SELECT half, lang, sum(n_in) AS size_in FROM c{tag} GROUP BY ALL), y{tag} AS (SELECT half, sum(size_in) AS size_all FROM z{tag} GROUP BY half),
    s{tag} AS (SELECT u.doc_id, z.lang AS domain, sum(log2((coalesce(c.n_in, 0) + 1.0::DOUBLE) / (size_in + 131072)) - log2((n_all - coalesce(c.n_in, 0) + 1.0::DOUBLE) / (size_all - size_in + 131072))) AS score
        FROM un u JOIN a{tag} a ON a.half = u.half AND a.tok = u.tok JOIN z{tag} z ON z.half = u.half JOIN y{tag} y ON y.half = u.half LEFT JOIN c{tag} c ON c.half = u.half AND c.lang = z.lang AND c.tok = u.tok GROUP BY ALL),
    g{tag} AS (SELECT doc_id, domain, 1 / (1 + exp(-8 * score / n)) AS s FROM s{tag} JOIN sz USING (doc_id)), q{tag} AS (SELECT doc_id, domain, round(s / sum(s) OVER (PARTITION BY doc_id), 6) AS p FROM g{tag}),
    d{tag} AS (SELECT doc_id, first(domain ORDER BY p DESC, domain) AS pick FROM q{tag} GROUP BY doc_id)"""


TRANSDUCTIVE = f"WITH {HASHES}" + """, tk AS (SELECT doc_id, (h % 131072)::INT AS tok FROM ev), sz AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY doc_id), lb AS (SELECT DISTINCT doc_id FROM labels),
    un AS (SELECT doc_id, (doc_id % 2)::INT AS half, tok FROM tk WHERE doc_id NOT IN (SELECT doc_id FROM lb)), hv AS (SELECT unnest([0, 1])::INT AS half),
    e0 AS (SELECT half, d.lang, tok FROM tk JOIN documents d USING (doc_id), hv WHERE doc_id IN (SELECT doc_id FROM lb)),""" + odds_sql("e0", "0") + """,
    e1 AS (SELECT * FROM e0 UNION ALL SELECT 1 - half, pick, tok FROM un JOIN d0 USING (doc_id)),""" + odds_sql("e1", "1")


def self_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that labels lists are the labelled pool; the others are two halves by number."""
    pool = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = docs(spark, sf_dir).join(pool, "doc_id", "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = F.coalesce("known", F.lit(False))
    rows = rows.select("doc_id", F.col("lang").alias("gold"), F.when(known, F.col("lang")).alias("label"), F.when(known, 2).otherwise(F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))).cast("int").alias("fold"), known.alias("known"), "text")
    counted = Workspace(spark, "self_trained").save(features.bucket_rows(rows, ["doc_id", "gold", "label", "fold", "known"]), "rows")
    return bayes.transductive(counted, lambda found: answers(found))


@query(TRANSDUCTIVE + " SELECT d.doc_id, d.lang AS gold, d0.pick AS honest, d1.pick AS pick FROM documents d LEFT JOIN d0 USING (doc_id) LEFT JOIN d1 USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM lb)")
def transductive_picks(spark, sf_dir):
    """Two-fold self-training: the picks by the labelled documents, and by those with the other half's own picks."""
    return self_trained(spark, sf_dir).select("doc_id", "gold", "honest", "pick")


@query(TRANSDUCTIVE + """ SELECT count(*) AS n, round(avg(coalesce((d1.pick = d.lang)::INT, 0)), 6) AS accuracy, round(avg(coalesce((d0.pick = d.lang)::INT, 0)), 6) AS honest_accuracy, count(d0.pick) AS n_pseudo
    FROM documents d LEFT JOIN d0 USING (doc_id) LEFT JOIN d1 USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM lb)""")
def transductive_report(spark, sf_dir):
    right = lambda c: F.avg(F.coalesce((F.col(c) == F.col("gold")).cast("int"), F.lit(0)))
    return r6(self_trained(spark, sf_dir).agg(F.count("*").alias("n"), right("pick").alias("accuracy"), right("honest").alias("honest_accuracy"), F.count("honest").alias("n_pseudo")))


@query()
def basis_spectrum(spark, sf_dir):
    """place, value, verdict, k, leakage: what swapping the halves of a conversation's text does to its hashed embedding, in the space whitened by
    the documents' embeddings; conversations of odd number are held out. tests/test_typed.py holds the solves against NumPy."""
    dims = 64
    rows = table(spark, sf_dir, "conversations")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    swapped = F.array_join(F.concat(F.slice(words, half + 1, F.size(words)), F.slice(words, F.lit(1), half)), " ")
    both = rows.select("conv_id", F.monotonically_increasing_id().alias("i"), F.col("text").alias("a"), swapped.alias("b"))
    ws = Workspace(spark, "basis")
    both = ws.save(both, "texts")
    one = features.embedded(both.select("i", "conv_id", F.col("a").alias("text")), ["i", "conv_id"], dims)
    two = features.embedded(both.select("i", F.col("b").alias("text")), ["i"], dims).withColumnRenamed("vector", "other")
    family = F.when(F.col("conv_id") % 2 == 0, "fit").otherwise("held")
    pairs = one.join(two, "i").select(family.alias("family"), F.zip_with("other", "vector", lambda x, y: x - y).alias("vector"))
    cert = basis.certify(features.embedded(docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"], dims), pairs, dims)
    leak = (cert.leakage or {}).get("held")
    found = [(i, float(v), cert.verdict, cert.k, leak) for i, v in enumerate(cert.spectrum)]
    return r6(spark.createDataFrame(found, "place int, value double, verdict string, k int, leakage double"))
