"""Row generators: cases with questions and gold answers built from the tables, and their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.operators import cases
from graywether.plans.registry import query
from graywether.sources.tables import table

LANGS = ["de", "en", "es", "fr"]
BASE = """WITH choice AS (SELECT doc_id AS case_id, 'lang' AS qid, 'choice' AS kind, ['de', 'en', 'es', 'fr'] AS options, (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::INT AS gold_idx FROM documents)"""


def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.choice(table(spark, sf_dir, "documents"), "doc_id", "lang", LANGS)


@query(BASE + " SELECT * FROM choice")
def choice_cases(spark, sf_dir):
    return choice(spark, sf_dir)


@query("SELECT doc_id AS case_id, 'toxic' AS qid, 'noul' AS kind, ['yes', 'no'] AS options, (1 - toxic)::INT AS gold_idx FROM labels WHERE toxic IS NOT NULL")
def noul_cases(spark, sf_dir):
    return cases.noul(table(spark, sf_dir, "labels"), "doc_id", "toxic")


@query("""SELECT vec_id AS case_id, 'level' AS qid, 'score' AS kind, ['0', '1', '2', '3', '4'] AS options, (label // 2)::INT AS gold_idx,
    list_transform(range(5), lambda i: round(CASE WHEN i = label // 2 THEN 0.8 ELSE 0.05 END, 6)::DOUBLE) AS gold_soft, round(list_sum(list_transform(range(5), lambda i: i * (CASE WHEN i = label // 2 THEN 0.8 ELSE 0.05 END))), 6)::DOUBLE AS gold_score FROM embeddings""")
def score_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("level", F.floor(F.col("label") / 2).cast("int"))
    return cases.score(rows, "vec_id", "level", 5, weight=0.8)


@query("""WITH s AS (SELECT DISTINCT source FROM documents), d AS (SELECT doc_id, d.source AS gold, s.source AS opt, row_number() OVER (PARTITION BY doc_id ORDER BY md5(s.source || ':' || doc_id::VARCHAR), s.source) AS r FROM documents d JOIN s ON s.source <> d.source),
    o AS (SELECT doc_id, any_value(gold) AS gold, list(opt ORDER BY r) AS others FROM d WHERE r <= 4 GROUP BY doc_id)
    SELECT doc_id AS case_id, list_sort(list_append(others, gold)) AS options, (list_position(list_sort(list_append(others, gold)), gold) - 1)::INT AS gold_idx FROM o""")
def distractor_cases(spark, sf_dir):
    return cases.with_distractors(table(spark, sf_dir, "documents"), "doc_id", "source", 4)


ORDERS = "ord AS (SELECT unnest(range(3)) AS k)"


@query(BASE + f""", {ORDERS} SELECT case_id, k::INT AS k, list_transform(range(4), lambda i: options[((i + k) % 4) + 1]) AS options, ((gold_idx - k + 4) % 4)::INT AS gold_idx FROM choice, ord""")
def permuted_cases(spark, sf_dir):
    return cases.rotated(choice(spark, sf_dir), 3)


@query(BASE + " SELECT case_id, list_concat(options, ['it', 'nl']) AS options, gold_idx FROM choice")
def augmented_cases(spark, sf_dir):
    return cases.augmented(choice(spark, sf_dir), ["it", "nl"])


@query(BASE + " SELECT case_id, 'none' AS qid, 'noul' AS kind, ['yes', 'no'] AS options, 1 AS gold_idx FROM choice")
def null_cases(spark, sf_dir):
    return cases.null_twin(choice(spark, sf_dir))


@query(BASE + " SELECT case_id, list_transform(options, lambda o: CASE o WHEN 'de' THEN 'en' WHEN 'en' THEN 'es' WHEN 'es' THEN 'fr' ELSE 'de' END) AS options, gold_idx FROM choice")
def renamed_cases(spark, sf_dir):
    return cases.renamed(choice(spark, sf_dir), dict(zip(LANGS, LANGS[1:] + LANGS[:1])))


@query(BASE + " SELECT case_id, qid, (i - 1)::INT AS option_idx, options[i] AS option, (i - 1 = gold_idx)::INT AS is_gold FROM (SELECT *, unnest(range(1, 5)) AS i FROM choice)")
def exploded_options(spark, sf_dir):
    return cases.exploded(choice(spark, sf_dir))


@query(BASE + " SELECT qid, options[gold_idx + 1] AS option, count(*) AS n FROM choice WHERE gold_idx >= 0 GROUP BY ALL")
def gold_events(spark, sf_dir):
    rows = cases.exploded(choice(spark, sf_dir)).where("is_gold = 1")
    return rows.groupBy("qid", "option").agg(F.count("*").alias("n"))


@query("""SELECT conv_id AS case_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS state, count(*) AS n_turns, sum((role = 'user')::INT)::BIGINT AS n_user FROM conversations GROUP BY conv_id""")
def dialog_states(spark, sf_dir):
    return cases.dialogs(table(spark, sf_dir, "conversations"))


@query("""SELECT event_id AS case_id, event_type AS qid, json_extract(props, '$.k')::BIGINT AS k, value FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_state_casts(spark, sf_dir):
    return cases.json_number(table(spark, sf_dir, "events"), "props", "k")


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = ceil(n * 0.99) - 1 THEN value END) AS p99, max(value) AS most, count(*) AS n FROM e GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return cases.latencies(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, (event_type = 'purchase')::INT AS ok FROM events)
    SELECT user_id, count(*) AS n, sum(ok)::BIGINT AS wins, sum(CASE WHEN turn <= 8 THEN ok ELSE 0 END)::BIGINT AS wins_8 FROM f GROUP BY user_id""")
def prefix_rungs(spark, sf_dir):
    return cases.rungs(table(spark, sf_dir, "events"), 8)
